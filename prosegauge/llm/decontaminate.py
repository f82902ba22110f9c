"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

The automaton holds each item's windows of consecutive words, set between
single blanks. A document is normalised the same way, scanned once, and every
hit is carried back to word numbers and to code-point offsets of the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, unused

#: A word: letters and digits, and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_A_TO_Z = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
HITS = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"


def fold(text: str) -> str:
    """A-Z lower-cased, all else kept, so that offsets hold."""
    return text.lower() if text.isascii() else text.translate(_A_TO_Z)


def windows(text: str | None, width: int) -> set[str]:
    """All runs of `width` words; the whole text if it has fewer; nothing if it has none."""
    words = WORD.findall(fold(text)) if text else []
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def automaton(items: list[tuple[str, str | None]], width: int) -> tuple[ahocorasick.Automaton, list[str]]:
    """The automaton of (item_id, text), with the items by number; a window shared by items is held once."""
    of: dict[str, list[int]] = {}
    for k, (_, text) in enumerate(items):
        for w in windows(text, width):
            of.setdefault(w, []).append(k)
    trie = ahocorasick.Automaton()
    for w, ks in of.items():
        trie.add_word(f" {w} ", (w.count(" ") + 1, ks))
    trie.make_automaton()
    return trie, [i for i, _ in items]


def scan(text: str | None, trie: ahocorasick.Automaton, names: list[str]) -> tuple:
    """A row of HITS: words, words inside any window found, items found, and the original spans of the hit words."""
    low = fold(text) if text else ""
    words = WORD.findall(low)
    found = list(trie.iter(f" {' '.join(words)} ")) if words and len(trie) else []
    if not found:
        return len(words), 0, 0, [], []
    spans = [m.span() for m in WORD.finditer(low)]
    sizes = np.fromiter((e - s + 1 for s, e in spans), np.int64, len(spans))
    last = np.searchsorted(np.cumsum(sizes), np.array([at for at, _ in found]), "left")
    edges = np.zeros(len(spans) + 1, np.int64)
    np.add.at(edges, last - np.array([n for _, (n, _) in found]) + 1, 1)
    np.add.at(edges, last + 1, -1)
    hit = np.r_[0, (np.cumsum(edges[:-1]) > 0).view(np.int8), 0]
    runs = np.flatnonzero(np.diff(hit)).reshape(-1, 2)
    items = sorted({names[k] for _, (_, ks) in found for k in ks})
    return len(spans), int(hit.sum()), len(items), items, [(spans[a][0], spans[b - 1][1]) for a, b in runs]


def _blocks(benchmark: DataFrame, most: int) -> list[list[tuple[str, str | None]]]:
    """The items in lists of at most `most` characters (a longer item alone), read one after the other."""
    blocks: list[list] = [[]]
    size = 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        if blocks[-1] and size + len(r.text) > most:
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, r.text))
        size += len(r.text)
    return blocks


def _finder(held: Broadcast):
    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie, names = automaton(*held.value)
        for texts in batches:
            yield pd.DataFrame([scan(t, trie, names) for t in texts], columns=["n_words", "n_hit", "n_items", "items", "spans"])

    return find


def overlaps(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = BROADCAST_BYTES >> 4) -> DataFrame:
    """docs with a struct column `hits` (HITS): words, hit words, items that occur, and hit spans in the original.

    benchmark(item_id, text) is sent to the tasks as one automaton; beyond
    block_chars it becomes several, each scanning the documents once, whose
    findings are joined per document. Null and empty texts have no words and no
    hits; null items, and items without words, match nothing; an empty
    benchmark hits nothing. Rows that repeat stay; extra columns stay, one
    named `hits` is replaced.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.drop("hits")
    parts = []
    for block in _blocks(benchmark, block_chars):
        parts.append(_finder(sc.broadcast((block, width)))("text"))
    if len(parts) == 1:
        return out.withColumn("hits", parts[0])
    (name,) = unused(out.columns, "parts")
    return _joined(out.withColumn(name, F.array(*parts)), name)


def _joined(out: DataFrame, name: str) -> DataFrame:
    """One struct of HITS from those of several automata over the same text, in the column `name`."""

    @F.pandas_udf(HITS)
    def join(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, ps in zip(texts, parts, strict=True):
            low = fold(text) if text else ""
            spans: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for p in ps for x in p["spans"]):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            # Neighbouring hit words of two automata touch only through what lies between words.
            merged: list[list[int]] = []
            for s, e in spans:
                if merged and not WORD.search(low, merged[-1][1], s):
                    merged[-1][1] = e
                else:
                    merged.append([s, e])
            items = sorted({i for p in ps for i in p["items"]})
            rows.append((int(ps[0]["n_words"]), sum(len(WORD.findall(low, s, e)) for s, e in merged), len(items), items, [tuple(x) for x in merged]))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items", "spans"])

    return out.withColumn("hits", join("text", name)).drop(name)
