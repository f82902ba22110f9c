"""Near copies by the Jaccard similarity of word shingles.

Candidates come from SimHash balls and from MinHash bands, which reach the
similarities that four of 64 bits don't. Every candidate is verified by its
shingle sets before it links, and no two candidates are left apart unheld:

1. All members of a bucket (those that share a band) are held against its smallest.
2. Components are contracted. In buckets that hold several, one member, drawn by
   hash, is held against those of the other components, as long as that joins
   a good part of what is apart.
3. What is still apart in a bucket is held against all others of it, in blocks
   that a task can hold; each pair in one bucket only, the first that it shares.

Sets travel as sorted hashes of 40 bits, one set a node and block, never as texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import BROADCAST_BYTES, lookup, settle
from .components import components
from .simhash import ball_links, fingerprint

#: 20 bands of 5 minima meet at similarity 0.8 but for (1 - 0.8**5)**20 = 0.04 % of pairs.
BANDS, ROWS = 20, 5
#: Step 2 goes on while it joins this share of the nodes that are apart.
WORTH = 0.25
#: Nodes planned for a block: of those apart, and of all in the bucket; places where hashes meet that are counted at once.
APART, ALL, MEET = 256, 1024, 1 << 22
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_SLICE = 1 << 11


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of word shingles; one of all words for a shorter text, none for one without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[width - 1 :], strict=False) if len(words) >= width else [(0, len(joined))]
    return np.unique(np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in spans), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def packed(own: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes as differences, byte by byte: about four bytes a hash when compressed."""
    top = np.unique(own >> np.uint64(24))
    gaps = np.diff(top, prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.zeros((len(data) // 5, 8), np.uint8)
    gaps[:, :5] = np.frombuffer(data, np.uint8).reshape(5, -1).T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _SLICE):
        low = np.minimum(low, ((own[None, at : at + _SLICE] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    return np.array([xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def overlaps(few: list[np.ndarray], many: list[np.ndarray]) -> np.ndarray:
    """(len(few), len(many)): how many elements each two sets share, counted where they meet in an inverted list of few."""
    sizes = np.array([len(x) for x in few])
    flat, who = np.concatenate(few), np.repeat(np.arange(len(few)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    out = np.zeros((len(many), len(few)), np.int64)
    for j, x in enumerate(many):
        low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = high - low
        for at in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(n) // MEET)) + 1):
            k = n[at]
            places = np.repeat(low[at] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
            out[j] += np.bincount(who[places], minlength=len(few))
    return out.T


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs(a, b) whose sets(node, own) are similar enough. b's set travels with the pair, a's once a task that asks for it."""

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([similarity(unpacked(s), unpacked(t)) >= least for s, t in zip(x, y, strict=True)], dtype=bool)

    rows = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")).hint("merge"), "b")
    rows = lookup(rows, "a", sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "inner", by=["b"])
    return rows.where(alike("x", "y")).select("a", "b")


def _held_apart(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components of members(band, node, root, keys): in each bucket, all nodes outside its largest component are held against all of other components.

    Returns a spanning forest of the components of each block.
    """
    per = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    per = per.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"))
    plan = per.select("band", "main", F.ceil((F.col("n") - F.col("n_main")) / APART).cast("int").alias("rows"), F.ceil(F.col("n") / ALL).cast("int").alias("columns"))
    own = lookup(members, "band", plan, "inner", by=["node"])
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    few = own.where("root <> main").select("band", at("rows").alias("i"), F.explode(spread("columns")).alias("j"), F.lit(True).alias("few"), "node", "root", "keys")
    many = own.select("band", F.explode(spread("rows")).alias("i"), at("columns").alias("j"), F.lit(False).alias("few"), "node", "root", "keys")
    rows = few.unionByName(many).join(sets.hint("merge"), "node")

    def of(table: pa.Table) -> pa.Table:
        band = table.column("band")[0].as_py()
        side = [table.filter(x) for x in (table.column("few"), pa.compute.invert(table.column("few")))]
        root, node = [s.column("root").to_numpy() for s in side], [s.column("node").to_numpy() for s in side]
        keys = [np.array(s.column("keys").to_pylist(), np.int64).reshape(-1, BANDS) for s in side]
        a, b = [], []
        if len(node[0]) and len(node[1]):
            own = [[unpacked(x) for x in s.column("own").to_pylist()] for s in side]
            sizes = [np.array([len(x) for x in o]) for o in own]
            same = np.zeros((len(node[0]), len(node[1])), bool)  # whether they share an earlier band
            for k in range(BANDS):
                here = keys[0][:, k] == band
                if here.any():
                    break
                same |= keys[0][:, k][:, None] == keys[1][:, k][None, :]
            both = overlaps(*own)
            near = (both >= least * (sizes[0][:, None] + sizes[1][None, :] - both)) & (root[0][:, None] != root[1][None, :]) & ~same
            top: dict[int, int] = {}

            def find(x: int) -> int:
                while top.get(x, x) != x:
                    x = top[x]
                return x

            for i, j in zip(*np.nonzero(near), strict=True):
                x, y = find(int(root[0][i])), find(int(root[1][j]))
                if x != y:
                    top[max(x, y)] = min(x, y)
                    a.append(int(node[0][i]))
                    b.append(int(node[1][j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("band", "i", "j").applyInArrow(of, "a long, b long")


def _sets(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(node, own) of asked(rep, node), each taken from one document."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([packed(shingles(t, width)) for t in s], dtype=object)

    rows = docs.select(F.xxhash64("doc_id", "text").alias("rep"), "text")
    small = asked.count() * 32 <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(asked), "rep") if small else lookup(rows, "rep", asked, "inner", by=["text"])
    return rows.select("node", of("text").alias("own")).groupBy("node").agg(F.min("own").alias("own"))


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of docs(doc_id, text): component_id is the smallest doc_id that links of similarity `least` or more reach.

    Equal shingle sets are one node, so exact copies need no pairs. Two nodes
    that share a band are in the same component, or have been held against each
    other; only a pair that shares none (0.04 % at 0.8, less above) can be missed.
    Rows with a null doc_id get a component only where another row is like them.
    """
    held = "struct<node:long,fp:long,bands:array<long>>"

    @F.pandas_udf(held)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for text in s:
                own = shingles(text, width)
                node = int(np.uint64(xxh64_intdigest(own.tobytes(), 7)).view(np.int64))
                rows.append((node, fingerprint(text, width), bands(own)))
            yield pd.DataFrame(rows, columns=["node", "fp", "bands"])

    marked = settle(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rep"), signed("text").alias("s")).select("doc_id", "rep", "s.*"), "signatures")
    nodes = settle(marked.groupBy("node").agg(F.min("rep").alias("rep"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "nodes")
    cells = nodes.select("node", F.explode(F.array_distinct("bands")).alias("band"))
    heads = nodes.groupBy("fp").agg(F.min("node").alias("id"))
    same = lookup(nodes.select("node", "fp"), "fp", heads, "inner", by=["node"]).select(F.col("id").alias("a"), F.col("node").alias("b"))
    firsts = cells.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    buckets = settle(lookup(cells, "band", firsts, "inner", by=["node"]), "buckets")  # of two nodes or more
    stars = buckets.select("a", F.col("node").alias("b"))
    near = settle(same.union(stars).union(ball_links(settle(heads, "heads"))).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    asked = buckets.select("node").union(near.select("a")).union(near.select("b")).distinct()
    sets = settle(_sets(docs, asked.join(nodes.hint("merge"), "node").select("rep", "node"), width), "sets")
    roots = settle(asked.join(components(settle(_verified(near, sets, least), "links")).hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    open_, turn = buckets.select("band", "node"), 0
    while True:
        # Buckets that hold several components; the others are done.
        own = lookup(open_, "node", roots, "inner", by=["band"])
        first = own.groupBy("band").agg(F.min_by(F.struct("root", "node"), F.xxhash64("root", F.lit(turn), "node")).alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        own = settle(lookup(own, "band", first.select("band", F.col("c.root").alias("c_root"), F.col("c.node").alias("c_node")), "inner", by=["node"]), "open")
        open_, apart = own.select("band", "node"), own.select("root").distinct().count()
        if not apart:
            break
        pairs = own.where("root <> c_root").select(F.col("c_node").alias("a"), F.col("node").alias("b")).distinct()
        joined = _joined(roots, settle(_verified(pairs, sets, least), "links"))
        left = joined.join(open_.select("node").distinct().hint("merge"), "node", "left_semi").select("root").distinct().count()
        roots, turn = joined, turn + 1
        if apart - left < WORTH * apart:
            own = lookup(open_, "node", roots, "inner", by=["band"])
            several = own.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
            own = lookup(own, "band", several, "inner", by=["node"]).join(nodes.select("node", F.col("bands").alias("keys")).hint("merge"), "node")
            roots = _joined(roots, settle(_held_apart(settle(own, "apart"), sets, least), "links"))
            break
    of = settle(lookup(marked.select("doc_id", "node"), "node", roots, "left").select("doc_id", F.coalesce("root", "node").alias("root")), "roots")
    return lookup(of, "root", of.groupBy("root").agg(F.min("doc_id").alias("component_id"))).select("doc_id", "component_id")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots(node, root) after links(a, b) between nodes."""
    if links.isEmpty():
        return roots
    at = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    found = components(links.join(at("a").hint("merge"), "a").join(at("b").hint("merge"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    out = lookup(roots, "root", found.select(F.col("node").alias("root"), F.col("root").alias("up")), by=["node"])
    return settle(out.select("node", F.coalesce("up", "root").alias("root")), "roots")
