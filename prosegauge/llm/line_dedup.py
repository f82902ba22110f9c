"""Reversible line dedup: exact reference counts of line keys, behind sharded cuckoo filters.

A key is the stripped, A-Z-lower-cased line. The exact tables say which
documents hold a key and how many; each shard's cuckoo filter holds the keys
that at least two documents share, so nearly all lines of a batch are cleared
without looking into the tables. Documents can be inserted and deleted: counts
go up and down, and keys enter and leave the filters. A key's shard follows
from its hash; there are as many shards as the counted shared keys ask for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_BYTES, lower_ascii, settle, unused

KEY_BYTES, SLOTS, KICKS = 16, 4, 200
#: Shared keys that one shard is planned for, and parts that a shard's lines are dealt into where its filter comes to them.
SHARD_KEYS, PARTS = 1 << 17, 64
_COUNTS = "key binary, n_docs long, owner long"
_FILTERS = "shard int, slots binary"


class LineIndex(NamedTuple):
    """postings(key, doc_id), counts(key, n_docs, owner), filters(shard, slots) of n_shards shards; lines of at least `least` code points."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    least: int


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets, either found from the other."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots.reshape(-1, SLOTS)
        self.mask = np.uint64(len(self.slots) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(3, (max(keys, 1) * 10 // (9 * SLOTS)).bit_length())
        return cls(np.zeros(buckets * SLOTS, "<u2"))

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(h >> np.uint64(48), np.uint64(1))
        one = h & self.mask
        return mark.astype("<u2"), one.astype(np.int64), (one ^ self._jump(mark)).astype(np.int64)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & self.mask

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(h)
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(axis=1)

    def _fill(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the marks found a free slot in their bucket, and now have it."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(order) else np.zeros(0, np.int64)
        rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.r_[heads, len(order)]))
        free = self.slots[bucket] == 0
        fits = rank < free.sum(axis=1)
        slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        self.slots[bucket[fits], slot] = mark[order][fits]
        out = np.zeros(len(mark), bool)
        out[order[fits]] = True
        return out

    def insert(self, h: np.ndarray) -> bool:
        """False if a key found no place: the caller then builds a larger filter from the exact table.

        All keys go to a free slot of their first bucket, the rest to their
        second; then each full bucket gives one mark away to that mark's other
        bucket, round by round.
        """
        mark, one, two = self._places(h)
        rest = ~self._fill(mark, one)
        mark, at = mark[rest], two[rest]
        rest = ~self._fill(mark, at)
        mark, at = mark[rest], at[rest]
        for kick in range(KICKS):
            if not len(mark):
                break
            _, head = np.unique(at, return_index=True)
            wait = np.ones(len(mark), bool)
            wait[head] = False
            seat = (mark[head].astype(np.int64) + kick) % SLOTS
            out = self.slots[at[head], seat]
            self.slots[at[head], seat] = mark[head]
            mark, at = np.r_[out, mark[wait]], np.r_[at[head] ^ self._jump(out).astype(np.int64), at[wait]]
            rest = ~self._fill(mark, at)
            mark, at = mark[rest], at[rest]
        return not len(mark)

    def delete(self, h: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in self._places(h)), strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.slots[at] == mark)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break


def line_keys(text: Column, least: int) -> Column:
    """The distinct keys of at least `least` code points, as the first half of their SHA-256."""
    lines = F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1)
    long = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: F.char_length(x) >= least)
    return F.array_distinct(F.transform(long, lambda x: F.unhex(F.substring(F.sha2(x, 256), 1, 2 * KEY_BYTES))))


def _postings(docs: DataFrame, least: int) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(line_keys(F.col("text"), least)).alias("key"))


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")


def _hashes(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8")


def empty(spark: SparkSession, planned_keys: int = 1, least: int = 10) -> LineIndex:
    """An index of no documents, with shards for about planned_keys shared keys at first."""
    table = lambda schema: spark.createDataFrame([], schema)
    return LineIndex(table("key binary, doc_id long"), table(_COUNTS), table(_FILTERS), max(1, -(-planned_keys // SHARD_KEYS)), least)


def _refilter(index: LineIndex, risen: DataFrame, fallen: DataFrame) -> LineIndex:
    """The index with filters after keys have come to be shared, or ceased to be; its counts are the new ones.

    Where the shared keys have outgrown the shards, all filters are built anew
    with twice as many shards as they ask for; a full one alone is built anew
    as well. A shard's keys, which one task takes, are bounded by that.
    """

    def change(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if len(old) and not len(keys):
            return old
        up = _hashes(keys.loc[keys["up"], "key"])
        f = CuckooFilter(np.frombuffer(old["slots"].iloc[0], "<u2").copy()) if len(old) else CuckooFilter.sized(len(up))
        f.delete(_hashes(keys.loc[~keys["up"], "key"]))
        shard = int(keys["shard"].iloc[0])
        whole = f.insert(up)
        return pd.DataFrame({"shard": [shard], "slots": [f.slots.tobytes() if whole else None]})

    def anew(keys: pd.DataFrame) -> pd.DataFrame:
        h, size = _hashes(keys["key"]), len(keys)
        while not (f := CuckooFilter.sized(size)).insert(h):
            size *= 2
        return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "slots": [f.slots.tobytes()]})

    shared = index.counts.where("n_docs >= 2")
    n_keys, filters = shared.count(), index.filters
    if n_keys > 2 * SHARD_KEYS * index.n_shards:
        index = index._replace(n_shards=-(-2 * n_keys // SHARD_KEYS))
        risen, fallen, filters = shared, fallen.where("false"), filters.where("false")
    shard = _shard(index.n_shards).alias("shard")
    keys = risen.select(shard, "key", F.lit(True).alias("up")).union(fallen.select(shard, "key", F.lit(False).alias("up")))
    out = settle(filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(change, _FILTERS), "line-filters")
    full = out.where("slots IS NULL").select("shard")
    if not full.isEmpty():
        again = shared.select(shard, "key").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(anew, _FILTERS)
        out = settle(out.where("slots IS NOT NULL").union(again), "line-filters")
    return index._replace(filters=out)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with docs(doc_id, text) added; (document, line) pairs that it has already change nothing.

    Rows with a null doc_id are not counted; null and empty texts have no key;
    extra columns are not read. A key's count and smallest holder are partly
    aggregated before the shuffle, so a line that a third of all documents share
    is one row from each task.
    """
    new = _postings(docs, index.least).distinct()
    if not index.postings.isEmpty():
        new = settle(new.join(index.postings, ["key", "doc_id"], "left_anti"), "line-postings")
    delta = new.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("owner"))
    both = index.counts.withColumn("was", F.col("n_docs")).unionByName(delta.withColumn("was", F.lit(0).cast("long")))
    both = both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("owner").alias("owner"), F.sum("was").alias("was"))
    both = settle(both, "line-counts")
    index = index._replace(postings=index.postings.unionByName(new), counts=both.drop("was"))
    return _refilter(index, both.where("n_docs >= 2 AND was < 2"), both.where("false"))


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index as if doc_ids(doc_id) had never been inserted; unknown, repeated and null ids change nothing."""
    ids = doc_ids.select("doc_id").distinct()
    gone = index.postings.join(ids, "doc_id", "left_semi")
    rest = settle(index.postings.join(ids, "doc_id", "left_anti"), "line-postings")
    minus = settle(gone.groupBy("key").agg(F.count("*").alias("minus")), "line-minus")
    heirs = rest.join(minus, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("heir"))
    both = index.counts.join(minus, "key", "left").join(heirs, "key", "left")
    both = both.select("key", (F.col("n_docs") - F.coalesce("minus", F.lit(0))).alias("n_docs"), F.when(F.col("minus").isNull(), F.col("owner")).otherwise(F.col("heir")).alias("owner"), F.col("n_docs").alias("was"))
    both = settle(both, "line-counts")
    index = index._replace(postings=rest, counts=both.where("n_docs > 0").drop("was"))
    return _refilter(index, both.where("false"), both.where("n_docs < 2 AND was >= 2"))


def save(index: LineIndex, path: str) -> LineIndex:
    """Write the index's tables to path, which all executors reach, and read them back."""
    spark = index.counts.sparkSession
    for name in ("postings", "counts", "filters"):
        getattr(index, name).write.parquet(f"{path}/{name}")
    return index._replace(**{name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "counts", "filters")})


def maybe_shared(index: LineIndex, rows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Those of rows(key, doc_id) whose key is in its shard's filter: all shared keys, and one in some thousands of others.

    Filters of at most `most` bytes together go to every task. Larger ones come
    to the rows: these are dealt by shard and part, each filter goes before the
    rows of each part of its shard, and a task holds one filter at a time.
    """
    size = index.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
    marked = rows.select(_shard(index.n_shards).alias("shard"), "key", "doc_id")
    if size > most:
        return _streamed(index.filters, marked)
    held = index.filters.sparkSession.sparkContext.broadcast({r.shard: r.slots for r in index.filters.toLocalIterator()})

    @F.pandas_udf("boolean")
    def test(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        filters = {k: CuckooFilter(np.frombuffer(v, "<u2")) for k, v in held.value.items()}
        for shard, key in batches:
            out, h = np.zeros(len(key), bool), _hashes(key)
            which = shard.to_numpy()
            order = np.argsort(which, kind="stable")
            starts = np.flatnonzero(np.r_[True, which[order][1:] != which[order][:-1]]) if len(order) else []
            for own in np.split(order, starts[1:]):
                if len(own) and (f := filters.get(int(which[own[0]]))):
                    out[own] = f.contains(h[own])
            yield pd.Series(out)

    return marked.where(test("shard", "key")).select("key", "doc_id")


def _streamed(filters: DataFrame, marked: DataFrame) -> DataFrame:
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    first = filters.select("shard", part, "slots", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
    then = marked.select("shard", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"), F.lit(None).cast("binary").alias("slots"), "key", "doc_id")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for pdf in batches:
            place = pdf["shard"].to_numpy(np.int64) * PARTS + pdf["part"].to_numpy(np.int64)
            cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(pdf) else []
            for some in np.split(np.arange(len(pdf)), cuts[1:]):
                if len(some) == 0:
                    continue
                rows = pdf.iloc[some]
                if place[some[0]] != at:
                    at, own = place[some[0]], None
                if rows["slots"].iloc[0] is not None:
                    own, rows = CuckooFilter(np.frombuffer(rows["slots"].iloc[0], "<u2")), rows.iloc[1:]
                if own is not None and len(rows):
                    yield rows.loc[own.contains(_hashes(rows["key"])), ["key", "doc_id"]]

    dealt = first.unionByName(then).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("slots").isNull())
    return dealt.mapInPandas(test, "key binary, doc_id long")


def _without(text: str, drops: set[bytes], least: int) -> tuple[str, int]:
    lines = text.split("\n")
    keep = []
    for line in lines:
        key = line.encode("utf-8", "surrogatepass").strip(BLANKS.encode()).lower()
        # Bytes bound code points from above, so short keys need no decoding.
        if len(key) < least or hashlib.sha256(key).digest()[:KEY_BYTES] not in drops:
            keep.append(line)
    return "\n".join(keep), len(lines) - len(keep)


def drop_repeats(index: LineIndex, docs: DataFrame) -> DataFrame:
    """docs with each shared line kept only in the smallest doc_id of the index that holds it.

    All columns stay; text is replaced, n_lines (before dropping) and n_dropped
    are added or replaced. A document that loses every line has an empty text.
    Null texts stay null and count one empty line; a row with a null doc_id
    keeps its lines; rows that repeat a doc_id are treated as one document.
    """
    cand = maybe_shared(index, _postings(docs, index.least))
    shared = index.counts.where("n_docs >= 2").select("key", "owner")
    found, kept = unused(docs.columns, "drops", "kept")
    drops = cand.join(shared, "key").where("owner <> doc_id").groupBy("doc_id").agg(F.collect_set("key").alias(found))
    least = index.least

    @F.pandas_udf("kept string, dropped long")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, keys in batches:
            out = [(None, 0) if t is None or k is None else _without(t, set(k), least) for t, k in zip(text, keys, strict=True)]
            yield pd.DataFrame(out, columns=["kept", "dropped"])

    hit = F.col(found).isNotNull()
    out = docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"))
    out = out.join(drops, "doc_id", "left").withColumn(kept, without(F.when(hit, F.col("text")), found))
    out = out.withColumn("text", F.when(hit, F.col(f"{kept}.kept")).otherwise(F.col("text"))).withColumn("n_dropped", F.coalesce(f"{kept}.dropped", F.lit(0)).cast("long"))
    return out.drop(found, kept)


def dedup(docs: DataFrame, least: int = 10) -> DataFrame:
    """drop_repeats of docs against themselves: one batch inserted into an empty index."""
    index = insert(empty(docs.sparkSession, least=least), docs)
    return drop_repeats(index, docs)
