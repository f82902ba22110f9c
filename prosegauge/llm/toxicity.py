"""Toxicity scores of deobfuscated text.

The noisy channel: a writer's letters come out as look-alike signs, with signs
or blanks between them, or repeated. What could have been disguised is set out
as a lattice of letters for each sign, and Viterbi search under a character
trigram model of the whole corpus finds the likeliest restored word. Words,
plain and restored, then score against a lexicon of word and word-start weights
learnt from labelled documents, and a small logistic model turns a document's
hits into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, settle
from .langid import drawn, held_out

#: Learning rows of each label; documents that a lexicon entry is found in at least; its least cautious log-odds.
SAMPLE, SUPPORT, LEAST = 10_000, 3, 1.5
#: Tokens and runs that a worker remembers; characters that are split at once.
MEMO, LOT = 300_000, 8 << 20
#: The letters that each sign can stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou"}
#: Costs, in nats: reading a sign as a letter, dropping a sign, shortening a pair or a longer run of a letter.
READ, DROP, PAIR, RUN = 1.0, 3.0, 4.0, 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(LOOKS))
_ITEM = r"[^\W_](?![^\W_])"
_SPACED = re.compile(rf"(?<![^\W_])(?:[{_SIGNS}][\W_]+)?{_ITEM}(?:[\W_]+{_ITEM})+(?:[\W_]+[{_SIGNS}](?![^\W_]))?")
_DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]|([^\W\d_])\1")
_INSIDE = re.compile(r"[^\W_][\W_]+[^\W_]")
_ENDS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Letters between signs that are no look-alikes: nothing to restore but doubled letters.
_ALONE = rf"^[{re.escape(''.join(c for c in _ENDS if c not in LOOKS))}]*(?P<w>[a-z]+)[{re.escape(''.join(c for c in _ENDS if c not in LOOKS))}]*$"
_LATTICE = re.compile(rf"[\w{_SIGNS}]+")
_CODES = 28  # word edge, a to z, any other letter


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """The code of every code point's lower-case letter; 0 for what is no letter."""
    return np.array([_code(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], np.int64)


class CharModel:
    """-log P(letter | two before), interpolated, from trigram counts."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(_CODES, _CODES, _CODES).astype(float)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + _CODES)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()
        self.memo: dict[str, str] = {}
        self.features: dict[str, tuple[str, ...]] = {}

    def step(self, state: tuple[int, int], letters: str) -> tuple[float, tuple[int, int]]:
        cost, (a, b) = 0.0, state
        for c in letters:
            k = _code(c)
            cost += self.cost[a][b][k]
            a, b = b, k
        return cost, (a, b)

    def restore(self, sign: str) -> str:
        """What _restore finds, kept for a bounded number of short words and runs."""
        found = self.memo.get(sign)
        if found is None:
            found = self._restore(sign)
            if len(sign) <= 32:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[sign] = found
        return found

    def _restore(self, sign: str) -> str:
        """The likeliest letters behind a disguised, lower-cased word or run; words are parted by a blank where it holds separators.

        Signs and blanks that are no look-alikes are separators, and so is a sign
        that stands in each gap between the letters.
        """
        between = re.findall(r"(?<=[^\W_])[\W_]+(?=[^\W_])", sign)
        parting = set.intersection(*map(set, between)) if len(between) > 1 and len(between) == sum(c.isalnum() for c in sign) - 1 else set()
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for m in re.finditer(r"(.)\1*", sign, re.DOTALL):
            c, n = m[1], len(m[0])
            if c.isalpha():
                options = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, PAIR)] if n == 2 else [(c, RUN), (c * 2, RUN)]
            elif c in LOOKS:
                options = [("", 0.0 if c in parting else DROP)] + [(x * n, READ * n) for x in LOOKS[c] if n <= 2]
                options += [(" ", 0.0)] if c in parting else []
            else:
                options = [("", 0.0), (" ", 0.0)]
            if len(best) == 1 and len(options) == 1 and options[0][0] == c:  # nothing to choose
                (state, (cost, text)), = best.items()
                more, to = self.step(state, c)
                best = {to: (cost + more, (text, c))}
                continue
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for state, (cost, text) in best.items():
                for letters, price in options:
                    if letters == " ":
                        more, to = (self.cost[state[0]][state[1]][0], (0, 0)) if state != (0, 0) else (0.0, state)
                    else:
                        more, to = self.step(state, letters)
                    total = cost + price + more
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (text, letters) if letters else text)
            best = new
        _, _, at = min((cost + (self.cost[a][b][0] if b else 0.0), (a, b), text) for (a, b), (cost, text) in best.items())
        out = []
        while at:
            at, letters = at
            out.append(letters)
        return "".join(reversed(out)).strip()


def char_counts(docs: DataFrame) -> np.ndarray:
    """Letter trigrams within words of all docs(text), one partly aggregated sum of a fixed number of cells."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, total = _codes(), np.zeros(_CODES**3, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    x = np.r_[0, 0, codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], 0]
                    a = np.where(x[1:-1] == 0, 0, x[:-2])  # what lies before a word's edge doesn't matter
                    total += np.bincount((a * _CODES + x[1:-1]) * _CODES + x[2:], minlength=_CODES**3)
        own = np.flatnonzero(total)
        yield pd.DataFrame({"cell": own, "n": total[own]})

    rows = docs.select("text").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_CODES**3, np.int64)
    out[rows["cell"]] = rows["n"]
    return out


def token_words(token: str, lm: CharModel) -> list[str]:
    """Letter runs of a lower-cased token, and its restored words if it may be disguised: by signs, doubled letters or separators inside."""
    words = _LETTERS.findall(token)
    if _DISGUISED.search(token):
        words += [w for x in _LATTICE.findall(token) if _DISGUISED.search(x) for w in lm.restore(x).split()]
    if words and _INSIDE.search(token):
        words += lm.restore(token.strip(_ENDS)).split()
    return words


def run_words(run: str, lm: CharModel) -> list[str]:
    """Restored words of a run of single letters and signs, with and without the signs at its ends."""
    if not _LETTERS.search(run):
        return []
    return [w for x in {run, run.strip(_ENDS + BLANKS)} for w in lm.restore(x).split()]


def word_features(word: str) -> list[str]:
    """A word, and its start of four and of five letters if it is longer."""
    return [word, *(f"{word[:k]}~" for k in (4, 5) if len(word) > k)]


def lots(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray, pa.Array]]:
    """(lower-cased texts, (text, token) pairs, distinct tokens) of some texts at once, of about LOT characters or one text; each token of the lot is looked at once, however many texts hold it."""
    own: list[str] = []
    size = 0

    def split() -> tuple[list[str], np.ndarray, pa.Array]:
        parts = pc.utf8_split_whitespace(pa.array(own, pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        of, code = np.repeat(np.arange(len(own)), np.diff(parts.offsets.to_numpy())), coded.indices.to_numpy().astype(np.int64)
        return own, np.stack([of, code]), coded.dictionary

    for i, text in enumerate(texts):
        own.append((text or "").lower())
        size += len(own[-1])
        if size >= LOT or i + 1 == len(texts):
            yield split()
            own, size = [], 0


def text_features(texts: list[str | None], lm: CharModel) -> Iterator[set[str]]:
    """The features of all plain and restored words of each whole text; none for null or empty."""
    for lows, (of, code), tokens in lots(texts):
        own = []
        for t in tokens.to_pylist():
            f = lm.features.get(t)
            if f is None:
                if len(lm.features) >= MEMO:
                    lm.features.clear()
                f = lm.features[t] = tuple({f for w in token_words(t, lm) for f in word_features(w)})
            own.append(f)
        ends = np.searchsorted(of, np.arange(len(lows) + 1))
        for low, a, b in zip(lows, ends[:-1], ends[1:], strict=True):
            found = {f for c in set(code[a:b].tolist()) for f in own[c]}
            yield found | {f for m in _SPACED.finditer(low) for w in run_words(m[0], lm) for f in word_features(w)}


def _squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def _key(word: str) -> int:
    """The first eight bytes as a number."""
    return int.from_bytes(word.encode()[:8], "little")


class Model(NamedTuple):
    counts: np.ndarray
    lexicon: dict[str, float]
    weights: np.ndarray


class Scorer:
    def __init__(self, model: Model):
        self.lm, self.lexicon, self.weights = CharModel(model.counts), model.lexicon, model.weights
        self.memo: dict[str, float] = {}
        self.whole = {_squeezed(f) for f in self.lexicon if not f.endswith("~")}
        self.starts = {_squeezed(f[:-1]) for f in self.lexicon if f.endswith("~")}
        self.whole_keys = np.array([_key(w) for w in self.whole], np.uint64)
        self.start_keys = {k: np.array([_key(w) for w in self.starts if len(w) == k], np.uint64) for k in range(1, 6)}

    def _worth(self, tokens: pa.Array) -> np.ndarray:
        """Tokens that may have a weight: all but those of letters alone, and signs around them, that _known() rules out; by the first letters of all at once."""
        word = pc.struct_field(pc.extract_regex(tokens, _ALONE), "w")
        other = pc.is_null(word).to_numpy(zero_copy_only=False)
        word = pc.cast(word.fill_null(""), pa.large_string())
        ends = np.frombuffer(word.buffers()[1], np.int64)[word.offset : word.offset + len(word) + 1] if len(word) else np.zeros(1, np.int64)
        data = np.frombuffer(word.buffers()[2] or b"", np.uint8)
        fresh = np.r_[True, data[1:] != data[:-1]][: len(data)]
        fresh[ends[:-1][ends[:-1] < len(data)]] = True
        upto = np.r_[0, np.cumsum(fresh)]
        first, size, data = upto[ends[:-1]], np.diff(upto[ends]), data[fresh]
        key = np.zeros(len(word), np.uint64)
        for k in range(8):
            own = size > k
            key[own] |= data[first[own] + k].astype(np.uint64) << np.uint64(8 * k)
        known = np.isin(key, self.whole_keys)
        for k, keys in self.start_keys.items():
            known |= (size >= k) & np.isin(key & np.uint64((1 << 8 * k) - 1), keys)
        return other | known

    def _known(self, word: str) -> bool:
        """Some form of a word of letters, with repeats shortened or not, may be in the lexicon: both are compared without repeats."""
        own = _squeezed(word)
        return own in self.whole or any(own[:k] in self.starts for k in range(1, 6))

    def _of(self, words: list[str]) -> float:
        return max((self.lexicon.get(f, 0.0) for w in words for f in word_features(w)), default=0.0)

    def _token(self, t: str) -> float:
        w = self.memo.get(t)
        if w is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            # a token of letters alone is restored only if that can find an entry
            w = self.memo[t] = self._of(token_words(t, self.lm)) if not t.isalpha() or self._known(t) else 0.0
        return w

    def hits(self, texts: list[str | None]) -> Iterator[list[float]]:
        """For each text the weight of each distinct token, and disguise of several tokens, that the lexicon knows."""
        for lows, pairs, tokens in lots(texts):
            weights, worth = np.zeros(len(tokens)), self._worth(tokens)
            weights[worth] = [self._token(t) for t in tokens.filter(pa.array(worth)).to_pylist()]
            of, code = np.unique(pairs[:, weights[pairs[1]] > 0], axis=1)
            own = np.split(weights[code], np.searchsorted(of, np.arange(1, len(lows))))
            for low, w in zip(lows, own, strict=True):
                yield w.tolist() + [x for m in _SPACED.finditer(low) if (x := self._of(run_words(m[0], self.lm)))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(np.array([_summary(h) for h in self.hits(texts)]).reshape(len(texts), 4) @ self.weights)


def _summary(hits: list[float]) -> np.ndarray:
    return np.array([1.0, max(hits, default=0.0), np.log1p(len(hits)), np.log1p(sum(hits))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(h, toxic, text): about `rows` different texts of each label, or all it has.

    From docs(doc_id, text) and labels(doc_id, toxic) that are not held out; a
    text labelled both ways is toxic; null labels and texts teach nothing.
    """
    own = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    marked = own.select("doc_id", F.xxhash64("text").alias("h")).join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id")
    keys = marked.groupBy("h").agg(F.max("toxic").alias("toxic"))
    keys = drawn(keys, "toxic", rows)
    texts = own.select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(keys), "h")
    return texts.groupBy("h", "toxic").agg(F.min("text").alias("text"))


def _lexicon(table: pd.DataFrame, tox: int, clean: int) -> dict[str, float]:
    """Cautious log-odds (a standard error below the estimate) of the entries that speak for toxicity."""
    t, c = table["toxic"].to_numpy(float), table["clean"].to_numpy(float)
    odds = np.log((t + 0.5) / (tox + 1)) - np.log((c + 0.5) / (clean + 1)) - np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) * 0.5
    keep = (t >= SUPPORT) & (odds >= LEAST)
    return dict(zip(table["feature"][keep], odds[keep], strict=True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Character counts of all docs, and lexicon and weights from the sample.

    The sample is cut in two by hash: each half's documents are summed up under
    the other half's lexicon to fit the weights, so that these don't trust
    entries that only their own documents support. Without toxic or without
    clean rows every score is the share of toxic ones (0 if there are none).
    """
    counts = char_counts(docs)
    texts = settle(sample(docs, labels, rows).withColumn("half", F.pmod("h", F.lit(2)).cast("int")), "toxic-sample")
    sizes = {(r.half, r.toxic): r.n for r in texts.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    tox, clean = (sum(n for (_, y), n in sizes.items() if (y == 1) == side) for side in (True, False))
    if not tox or not clean:
        base = tox / max(1, tox + clean)
        return Model(counts, {}, np.array([np.log((base + 1e-9) / (1 - base + 1e-9)), 0, 0, 0]))
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, n = CharModel(held.value), Counter()
        for pdf in batches:
            for features, half, y in zip(text_features(pdf["text"].tolist(), lm), pdf["half"], pdf["toxic"], strict=True):
                n.update((f, half, y == 1) for f in features)
        yield pd.DataFrame([(f, h, k * y, k * (1 - y)) for (f, h, y), k in n.items()], columns=["feature", "half", "toxic", "clean"])

    spread = texts.repartition("h").mapInPandas(tally, "feature string, half int, toxic long, clean long")
    table = spread.groupBy("feature").agg(*[F.sum(F.when(F.col("half") == h, F.col(y)).otherwise(0)).alias(f"{y}{h}") for h in (0, 1) for y in ("toxic", "clean")])
    table = table.where(F.col("toxic0") + F.col("toxic1") >= SUPPORT).toPandas()

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        own = pd.DataFrame({"feature": table["feature"], "toxic": sum(table[f"toxic{h}"] for h in halves), "clean": sum(table[f"clean{h}"] for h in halves)})
        return _lexicon(own, sum(sizes.get((h, 1), 0) for h in halves), sum(n for (h, y), n in sizes.items() if h in halves and y != 1))

    other = docs.sparkSession.sparkContext.broadcast((counts, {0: lexicon((1,)), 1: lexicon((0,))}))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {h: Scorer(Model(other.value[0], lex, np.zeros(4))) for h, lex in other.value[1].items()}
        for pdf in batches:
            for h, some in pdf.groupby("half"):
                yield pd.DataFrame({"x": [_summary(x) for x in own[h].hits(some["text"].tolist())], "toxic": some["toxic"]})

    seen = texts.repartition("h").mapInPandas(summed, "x array<double>, toxic int").toPandas()
    x = np.stack(seen["x"].to_numpy())
    return Model(counts, lexicon((0, 1)), _logistic(x, (seen["toxic"] == 1).to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised maximum likelihood by Newton's steps."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[0.1] * (x.shape[1] - 1)])
    for _ in range(30):
        p = _sigmoid(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score, the probability (0 to 1) that each whole text is toxic.

    Null, empty and wordless texts get the score of a text without hits. Equal
    texts score alike; rows that repeat stay; extra columns stay, one named
    score is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(held.value)
        for s in batches:
            yield pd.Series(own.scores(s.tolist()), dtype="float64")

    return docs.withColumn("score", of("text"))
