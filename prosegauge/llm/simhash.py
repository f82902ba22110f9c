"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most 2r bits apart share a variant that is at most r
bits from both, so emitting every variant within r and grouping on variants
finds all of them. Conversely all fingerprints that emit one variant are within
2r of each other, so a bucket needs no pairs: linking each member to the first
loses no component.

A fingerprint has 2,081 variants for r = 2. They are not shuffled one by one: a
cell is the set of variants with one prefix, a fingerprint is sent to each cell
that has any of its variants (37 cells for 8 prefix bits), and the variants are
formed, sorted and compared inside the cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import lookup, settle
from .components import components

#: Variants that one cell is planned to hold, and that one sort may hold.
CELL, SORT = 1 << 20, 1 << 22
_SLICE = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of word shingles; zero for a text with no words (null, empty, blank)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[width - 1 :], strict=False)) if len(words) >= width else [(0, len(joined))]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(spans), _SLICE):
        h = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in spans[at : at + _SLICE]], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(spans), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text); extra columns are left out, repeated rows stay."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([fingerprint(t, width) for t in s], dtype="int64")

    return docs.select("doc_id", of("text").alias("fp"))


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(bits), r)]


def _variants(low: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants of low within left[i] of its lowest bits, and the index that each comes from."""
    out, of = [], []
    for r in range(int(left.max(initial=0)) + 1):
        own = np.flatnonzero(left >= r)
        masks = np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)], np.uint64)
        out.append((low[own][:, None] ^ masks[None, :]).ravel())
        of.append(np.repeat(own, len(masks)))
    return np.concatenate(out), np.concatenate(of)


def _meet(low: np.ndarray, left: np.ndarray, who: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (first, other) of the fingerprints who that share a variant, in sorts of bounded size."""
    if len(who) < 2:
        return
    if bits and sum(int((left == r).sum()) * sum(math.comb(bits, i) for i in range(r + 1)) for r in range(int(left.max()) + 1)) > SORT:
        top = (low >> np.uint64(bits - 1)) & np.uint64(1)
        rest = low & np.uint64((1 << (bits - 1)) - 1)
        for side in (0, 1):
            stay = left - (top != side)
            keep = stay >= 0
            yield from _meet(rest[keep], stay[keep], who[keep], bits - 1)
        return
    v, of = _variants(low, left, bits)
    order = np.argsort(v, kind="stable")
    v, of = v[order], who[of[order]]
    first = np.r_[True, v[1:] != v[:-1]]
    heads = of[first][np.cumsum(first) - 1]
    apart = heads != of
    if apart.any():
        pairs = np.unique(np.stack([heads[apart], of[apart]], 1), axis=0)
        yield pairs[:, 0], pairs[:, 1]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n by the links a-b."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _cell_links(prefix: int, radius: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        bits = 64 - prefix - int(pdf["deep"].iloc[0])
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        low = fp & np.uint64((1 << bits) - 1)
        left = pdf["left"].to_numpy(np.int64)
        root = np.arange(len(pdf))
        for a, b in _meet(low, left, np.arange(len(pdf)), bits):
            apart = fp[a] ^ fp[b]
            assert (np.bitwise_count(apart) <= 2 * radius).all()
            root = root[_forest(len(pdf), root[a], root[b])][root] if len(a) else root
        ids = pdf["id"].to_numpy()
        far = root != np.arange(len(pdf))
        return pd.DataFrame({"a": ids[root[far]], "b": ids[far]})

    return links


def ball_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between the ids of fps(id long, fp long), each fp once, enough to connect all within distance (even).

    Each cell returns a spanning forest of its links, so links grow with the
    fingerprints and not with pairs. Cells that own many fingerprints (many near
    copies) are cut by further bits until each is planned to hold CELL variants.
    """
    radius = distance // 2
    n = fps.count()
    each = sum(math.comb(56, r) for r in range(radius + 1))
    prefix = min(20, max(2, math.ceil(math.log2(max(n, 1) * each / CELL)))) if n else 2
    at = F.shiftrightunsigned("fp", 64 - prefix)
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(prefix, radius)])
    hot = fps.groupBy(at.alias("cell")).count().where(F.col("count") * each > 4 * CELL)
    hot = hot.select("cell", F.least(F.lit(12), F.ceil(F.log2(F.col("count") * each / CELL))).cast("int").alias("deep"))
    rows = fps.select("id", "fp", F.explode(F.transform(masks, lambda m: F.struct(at.bitwiseXOR(m).alias("cell"), (F.lit(radius) - F.bit_count(m)).alias("left")))).alias("c"))
    rows = rows.select("id", "fp", "c.cell", "c.left").join(hot, "cell", "left").withColumn("deep", F.coalesce("deep", F.lit(0)))
    # The next `deep` bits of a hot cell's variants: every value that can still be reached.
    own = F.expr(f"shiftrightunsigned(fp, {64 - prefix} - deep) & (shiftleft(1L, deep) - 1L)")
    near = F.filter(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, deep) - 1L")), lambda m: F.bit_count(m) <= F.col("left"))
    cut = F.transform(near, lambda m: F.struct(own.bitwiseXOR(m).alias("sub"), (F.col("left") - F.bit_count(m)).alias("left")))
    rows = rows.select("id", "fp", "cell", "deep", F.explode(F.when(F.col("deep") == 0, F.array(F.struct(F.lit(0).cast("long").alias("sub"), F.col("left").alias("left")))).otherwise(cut)).alias("c"))
    rows = rows.select("id", "fp", "cell", "deep", "c.sub", "c.left")
    return rows.groupBy("cell", "sub").applyInPandas(_cell_links(prefix, radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs(doc_id, text).

    Fingerprints at most `distance` bits apart link; component_id is the
    smallest doc_id reachable. Texts without words have fingerprint zero and
    link like any other. Rows with a null doc_id keep a null component unless
    linked to others; an empty table gives an empty result; a repeated row
    gives its row again.
    """
    marked = settle(fingerprints(docs, width), "fingerprints")
    heads = settle(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "heads")
    found = components(settle(ball_links(heads, distance), "links"))
    of = heads.join(found, heads.id == found.node, "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return lookup(marked, "fp", of).select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
