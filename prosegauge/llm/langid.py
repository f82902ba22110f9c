"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters are hashed into a fixed number of buckets.
Inverse document frequencies come from every learning document; the weights from
a bounded sample, by follow-the-regularised-leader with an elastic net; a
temperature, fitted on a part of the sample that was left out, calibrates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, unused

#: Buckets; learning rows of a language in the sample; passes over the sample.
BUCKETS, SAMPLE, EPOCHS = 1 << 16, 800, 3
#: FTRL's rate and smoothing, the elastic net's two parts, and the scale of a text's features.
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.02, 0.05, 20.0
_SLICE = 1 << 20
UND = "und"


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # bucket x language: IDF times weight
    bias: np.ndarray
    temperature: float
    nonzero: int


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """For every code point its lower-case letter, or a blank for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str | None) -> np.ndarray:
    """The buckets of a text's letter n-grams, words set between single blanks; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    x = _folds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    x = np.r_[np.uint32(32), x, np.uint32(32)]
    x = x[~((x == 32) & (np.r_[np.uint32(0), x[:-1]] == 32))]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    one, two = x * np.uint32(0x9E3779B1), x * np.uint32(0x85EBCA77)
    pair = one[:-1] ^ (two[1:] >> np.uint32(3))
    triple = pair[:-1] * np.uint32(0xC2B2AE3D) ^ (x[2:] * np.uint32(0x27D4EB2F))
    mixed = [((h ^ (h >> np.uint32(15))) * np.uint32(k)) >> np.uint32(16) for h, k in ((one[x != 32], 0x2C1B3C6D), (pair, 0x297A2D39), (triple, 0x1B56C4E9))]
    return np.concatenate(mixed).astype(np.int64) & (BUCKETS - 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is left out of learning: crc32 of its id as text, mod 5, is 0. Null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many of docs(text) have any letter, and how many each bucket is in; one partly aggregated sum."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                g = grams(text)
                if len(g):
                    mark = np.zeros(BUCKETS, bool)
                    mark[g] = True
                    total += mark
                    n += 1
        own = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.r_[-1, own], "n": np.r_[n, total[own]]})

    rows = docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    real = rows["bucket"] >= 0
    out[rows["bucket"][real]] = rows["n"][real]
    return int(rows["n"][~real].sum()), out


def drawn(keys: DataFrame, label: str, rows: int) -> DataFrame:
    """About `rows` of keys(h, label) of each label: those whose hash lies below the share that `rows` are of its count.

    Hashes are even, so a label's rows are `rows` give or take a few root
    deviations, however many it has; all of a label of fewer.
    """
    share = keys.groupBy(label).agg((F.lit(float(rows)) / F.count("*")).alias("_share"))
    at = F.shiftrightunsigned(F.xxhash64("h"), 11) / F.lit(float(1 << 53))
    return keys.join(F.broadcast(share), label).where(at < F.col("_share")).drop("_share")


def sample(learn: DataFrame, idf: np.ndarray, rows: int = SAMPLE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """About `rows` different texts of each language, or all it has: (lang, buckets, features), in the order of their hashes.

    A text comes to the driver as its buckets and their counts, of which there are BUCKETS at most, however long it is;
    they are written to the shared folder and read part by part.
    """
    keys = learn.select(F.xxhash64("text").alias("h"), "lang").groupBy("h").agg(F.min("lang").alias("lang"))
    keys = drawn(keys, "lang", rows).select("h", F.col("lang").alias("l"))
    texts = learn.select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(keys), "h").groupBy("h", "l").agg(F.min("text").alias("text"))

    @F.pandas_udf("at binary, n binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            own = [np.unique(grams(t), return_counts=True) for t in s]
            yield pd.DataFrame([(at.astype("<u2").tobytes(), n.astype("<u4").tobytes()) for at, n in own], columns=["at", "n"])

    found = []
    for r in settle(texts.select("h", "l", of("text").alias("f")).select("h", "l", "f.*"), "sample").toLocalIterator():
        at, n = np.frombuffer(r.at, "<u2").astype(np.int32), np.frombuffer(r.n, "<u4").astype(np.int64)
        found.append((r.h, r.l, at, SCALE * n / max(1, n.sum()) * idf[at]))
    return [x[1:] for x in sorted(found, key=lambda x: x[0])]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(learn: DataFrame, rows: int = SAMPLE) -> Model:
    """A model of learn(text, lang), whose langs are not null. Texts without letters teach nothing; no rows give no languages."""
    n_docs, df = document_frequencies(learn)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    texts = sample(learn, idf, rows)
    langs = sorted({lang for lang, _, _ in texts})
    xs = [((at, x), langs.index(lang)) for lang, at, x in texts]
    xs = [x for x in xs if len(x[0][0])]
    train, check = [x for i, x in enumerate(xs) if i % 5], xs[::5]
    z, n = np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs)))
    bias, bias_n = np.zeros(len(langs)), np.zeros(len(langs))

    def weights(at: np.ndarray) -> np.ndarray:
        free = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) <= L1, 0.0, free / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(train)):
            (at, x), y = train[i]
            w = weights(at)
            miss = _softmax(x @ w + bias)
            miss[y] -= 1
            g = x[:, None] * miss[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias_n += miss * miss
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * miss
    w = weights(np.arange(BUCKETS))
    logits = np.array([x @ w[at] + bias for (at, x), _ in check]).reshape(len(check), len(langs))
    right = np.array([y for _, y in check], int)
    return Model(langs, (SCALE * idf[:, None] * w).astype(np.float32), bias, _temperature(logits, right), int((w != 0).sum()))


def _temperature(logits: np.ndarray, right: np.ndarray) -> float:
    """Of 0.05 to 5, the one under which the left-out labels are likeliest."""
    if not len(right):
        return 1.0
    tried = np.geomspace(0.05, 5, 81)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def classify(text: str | None, m: Model) -> tuple[str, float]:
    g = grams(text)
    if not len(g) or not m.langs:
        return UND, 0.0
    total = np.zeros(len(m.langs))
    for a in range(0, len(g), _SLICE):
        total += m.table[g[a : a + _SLICE]].sum(axis=0, dtype=np.float64)
    p = _softmax((total / len(g) + m.bias) / m.temperature)
    k = int(np.argmax(p))
    return m.langs[k], float(p[k])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score: the likeliest language of each whole text and its calibrated probability.

    `und` and 0 where a text is null or has no letter. Ties go to the language
    first in order. Rows that repeat stay; extra columns stay, ones named
    lang_pred or score are replaced. The model's size is fixed by BUCKETS and
    the languages, so it is sent to every task.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([classify(t, held.value) for t in s], columns=["lang", "score"])

    (found,) = unused(docs.columns, "found")
    out = docs.withColumn(found, of("text"))
    return out.withColumn("lang_pred", F.col(f"{found}.lang")).withColumn("score", F.col(f"{found}.score")).drop(found)


def learn_and_predict(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """predict() on docs(doc_id, text, lang) with a model of those of them that are not held out; adds held_out."""
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    learn = docs.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    return predict(docs, fit(learn, rows))
