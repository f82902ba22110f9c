"""Token-id files: canonical length-limited Huffman codes in independent blocks.

The code comes from global id counts. Documents are laid out in ascending
doc_id; a block holds whole documents until it is full, or a piece of a huge
one, with the bit offset of every CHECK-th id, so that decoding starts at all
of these places at once, through one lookup table. A file set is three Parquet
tables: codes(id, length), blocks(...) and parts(part, base).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import stretch_ids
from .common import settle, small_batches
from .packing import binaries, numbers
from .words import per_document, spread, word_tokenizer

#: Longest code, ids between checkpoints, ids after which a block ends, ids at most in one.
LONGEST, CHECK, FULL, MOST = 18, 256, 1 << 15, 1 << 17
#: Ids below this are counted and looked up by plain arrays.
DENSE = 1 << 21
_BLOCKS = "part int, block int, before long, n_ids long, docs array<struct<doc_id:long,at:long,n:int,piece:int,pieces:int>>, checks binary, bits binary"
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("piece", pa.int32()), ("pieces", pa.int32())]))
_ROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("docs", _DOCS), ("checks", pa.binary()), ("bits", pa.binary())])
_PIECES = "part int, at long, doc_id long, piece int, pieces int, ids "


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The length for each of counts (all positive) in an optimal prefix code of at most `longest` bits, by package-merge."""
    n = len(counts)
    if n > 1 << longest:
        raise ValueError(f"{n} ids don't fit codes of {longest} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    packs, kinds = np.zeros(0, np.int64), []
    for _ in range(longest):
        both = np.concatenate([leaves, packs])
        rank = np.argsort(both, kind="stable")
        kinds.append(rank < n)
        both = both[rank]
        packs = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(kinds):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, longest: int = LONGEST):
        order = np.lexsort((ids, lengths))
        self.longest, self.ids, self.lengths = longest, ids[order].astype(np.int64), lengths[order].astype(np.int64)
        spans = np.int64(1) << (longest - self.lengths)
        first = np.r_[0, np.cumsum(spans)[:-1]] if len(order) else np.zeros(0, np.int64)
        self.codes = first >> (longest - self.lengths)
        self.by_id = np.argsort(self.ids, kind="stable")
        self.dense = None
        if len(self.ids) and self.ids.max() < DENSE:
            self.dense = np.zeros((2, self.ids.max() + 1), np.uint64)
            self.dense[:, self.ids] = self.lengths, self.codes
        self.symbol = np.zeros(1 << longest, np.int32)
        self.length = np.ones(1 << longest, np.uint8)
        self.symbol[: spans.sum()] = np.repeat(self.ids, spans)
        self.length[: spans.sum()] = np.repeat(self.lengths, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, checkpoints) of ids that all have codes."""
        if not len(ids):
            return b"", b""
        if self.dense is None:
            at = self.by_id[np.searchsorted(self.ids[self.by_id], ids)]
            size, code = self.lengths[at].astype(np.uint64), self.codes[at].astype(np.uint64)
        else:
            size, code = self.dense[0][ids], self.dense[1][ids]
        ends = np.cumsum(size)
        starts = ends - size
        word, spill = (starts >> np.uint64(6)).view(np.int64), (starts & np.uint64(63)) + size
        over = np.flatnonzero(spill > 64)  # codes that reach into the next word
        here = code << ((np.uint64(64) - spill) & np.uint64(63))
        here[spill == 64] = code[spill == 64]
        here[over] = code[over] >> (spill[over] - np.uint64(64))
        out = np.zeros(int(ends[-1] + np.uint64(63)) // 64 + 1, np.uint64)
        edge = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[edge]] = np.add.reduceat(here, edge)
        out[word[over] + 1] |= code[over] << (np.uint64(128) - spill[over])
        return out.astype(">u8").tobytes()[: int(ends[-1] + np.uint64(7)) // 8], starts[::CHECK].astype("<u4").tobytes()

    def decode(self, blocks: list[tuple[bytes, bytes, int]]) -> list[np.ndarray]:
        """The ids of each (bits, checkpoints, number of ids), all lanes of all blocks step by step."""
        data = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), np.uint8)
        checks = [np.frombuffer(c, "<u4").astype(np.int64) for _, c, _ in blocks]
        base = np.r_[0, np.cumsum([len(b) for b, _, _ in blocks])]
        lanes = [len(c) for c in checks]
        pos = np.concatenate([c + 8 * b for c, b in zip(checks, base, strict=False)] or [np.zeros(0, np.int64)])
        left = np.concatenate([np.minimum(CHECK, n - CHECK * np.arange(k)) for k, (_, _, n) in zip(lanes, blocks, strict=True)] or [np.zeros(0, np.int64)])
        out = np.zeros((len(pos), CHECK), np.int32)
        drop = np.uint32(32 - self.longest)
        for step in range(int(left.max(initial=0))):
            live = slice(None) if step < left.min() else np.flatnonzero(left > step)
            p = pos[live]
            i = p >> 3
            window = (data[i].astype(np.uint32) << np.uint32(24)) | (data[i + 1].astype(np.uint32) << np.uint32(16)) | (data[i + 2].astype(np.uint32) << np.uint32(8)) | data[i + 3]
            look = (window << (p & 7).astype(np.uint32)) >> drop
            out[live, step] = self.symbol[look]
            pos[live] = p + self.length[look]
        rows = np.split(out, np.cumsum(lanes)[:-1])
        return [r.ravel()[:n] for r, (_, _, n) in zip(rows, blocks, strict=True)]


class Packed(NamedTuple):
    """rows(doc_id long, ids binary): the bytes of a document's ids, of numpy's type `kind`."""

    rows: DataFrame
    kind: str = "<u4"


def packed(docs_ids: DataFrame) -> Packed:
    """Packed rows of (doc_id, ids array<int>); null ids are none."""

    @F.pandas_udf("binary")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray([] if x is None else x, "<u4").tobytes() for x in s], dtype=object)

    return Packed(docs_ids.select(F.col("doc_id").cast("long").alias("doc_id"), of("ids").alias("ids")))


def write(packed_ids: Packed, path: str, longest: int = LONGEST) -> None:
    """Write ids, settled, to a new folder at path, in ascending doc_id.

    Null doc_ids come first; rows that share a doc_id follow each other in an
    order that their ids fix; documents without ids stay. Ids are 0 to 2^31-1,
    of at most 2^longest different values: that also bounds the counts that
    reach the driver.
    """
    tokens, kind = packed_ids
    spark = tokens.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(DENSE, np.int64), Counter()
        for batch in batches:
            ids = numbers(batch.column("ids"), kind)[1]
            if ids.itemsize > 2:
                high.update(ids[ids >= DENSE].tolist())
                ids = ids[ids < DENSE]
            n = np.bincount(ids)
            low[: len(n)] += n
        own = np.flatnonzero(low)
        yield pa.RecordBatch.from_pydict({"id": np.r_[own, np.array([*high], np.int64)], "n": np.r_[low[own], np.array([*high.values()], np.int64)]})

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).limit((1 << longest) + 1).toPandas().sort_values("id")
    ids, lengths = counts["id"].to_numpy(np.int64), code_lengths(counts["n"].to_numpy(np.int64), longest)
    spark.createDataFrame(pd.DataFrame({"id": ids, "length": lengths}), "id long, length long").coalesce(1).write.parquet(f"{path}/codes")
    held = spark.sparkContext.broadcast((ids, lengths, longest))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(*held.value), TaskContext.get().partitionId()
        docs, own, size, before, number = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs, own, size, before, number
            bits, checks = code.encode(np.concatenate(own)) if size else (b"", b"")
            row = {"part": part, "block": number, "before": before, "n_ids": size, "docs": docs, "checks": checks, "bits": bits}
            docs, own, size, before, number = [], [], 0, before + size, number + 1
            return pa.RecordBatch.from_pylist([row], _ROW)

        for batch in batches:
            starts, flat = numbers(batch.column("ids"), kind)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                pieces = max(1, -(-(b - a) // MOST))
                at = before + size
                for k in range(pieces):
                    piece = flat[a + k * MOST : min(b, a + (k + 1) * MOST)]
                    if docs and (pieces > 1 or size + len(piece) > MOST):
                        yield close()  # a piece of a huge document has its block to itself
                    docs.append({"doc_id": doc_id, "at": at, "n": len(piece), "piece": k, "pieces": pieces})
                    own.append(piece)
                    size += len(piece)
                    if pieces > 1 or size >= FULL or len(docs) >= FULL:
                        yield close()
        if docs:
            yield close()

    laid = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids")
    laid.mapInArrow(blocks, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a part: the only thing that is summed in order.
    sizes.select("part", base.alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, packed_ids: bool = False) -> DataFrame:
    """(doc_id, start, ids array<int>) of a folder that write() made; start counts the ids of all documents before.

    packed_ids: ids are binary, little-endian unsigned 32-bit integers.
    """
    small_batches(spark)
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").toPandas()
    held = spark.sparkContext.broadcast((codes["id"].to_numpy(np.int64), codes["length"].to_numpy(np.int64), int(max(LONGEST, codes["length"].max() if len(codes) else 0))))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*held.value)
        for batch in batches:
            for a in range(0, len(batch), 64):
                some = batch.slice(a, 64)
                columns = (some.column(c).to_pylist() for c in ("bits", "checks", "n_ids"))
                ids = np.concatenate(code.decode(list(zip(*columns, strict=True))))
                docs = some.column("docs")
                of = pc.list_parent_indices(docs)
                docs = docs.flatten()
                out = {"part": some.column("part").take(of)} | {c: docs.field(c) for c in ("at", "doc_id", "piece", "pieces")}
                starts = np.r_[0, np.cumsum(docs.field("n").to_numpy())]
                lists = binaries(ids, starts) if packed_ids else pa.ListArray.from_arrays(starts.astype(np.int32), ids)
                yield pa.RecordBatch.from_pydict(out | {"ids": lists})

    schema = _PIECES + ("binary" if packed_ids else "array<int>")
    blocks, cut = spark.read.parquet(f"{path}/blocks"), F.col("docs")[0]["pieces"] > 1
    whole = blocks.where(~cut).mapInArrow(pieces, schema).select("part", "at", "doc_id", "ids")
    # Only documents of several blocks are put together.
    apart = blocks.where(cut).mapInArrow(pieces, schema).groupBy("part", "at", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p.ids", F.hex), "")) if packed_ids else F.flatten("p.ids")
    found = whole.unionByName(apart.select("part", "at", "doc_id", joined.alias("ids")))
    parts = spark.read.parquet(f"{path}/parts")  # one short row for each task that wrote
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")


def token_ids(docs: DataFrame, path: str, end: int) -> Packed:
    """Settled ids of each whole text of docs(doc_id, text), as the tokenizers library gives them, and the end id.

    One read: a task encodes the distinct words of a chunk of its documents
    once and lays their ids out. A table of the corpus's words, as bpe.encode()
    makes it, would need the documents twice. Null and empty texts have the end id alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    kind = "<u2" if max(word_tokenizer(path).n_ids, end + 1) <= 1 << 16 else "<u4"

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        for c in tok.chunks(batches):
            starts, ids = tok.encode_words(c.words)
            starts, ids = stretch_ids(c, ids, np.diff(starts))
            last = len(starts) - 1  # a stretch more, of the end id
            starts, ids = np.r_[starts, starts[-1] + 1], np.r_[ids, end].astype(kind)
            for doc_ids, sizes, places in c.slices():
                own, k = spread(starts, ids, np.insert(places, np.cumsum(sizes), last))
                yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "ids": binaries(own, np.r_[0, np.cumsum(per_document(sizes + 1, k))])})

    return Packed(settle(docs.mapInArrow(ids_of, "doc_id long, ids binary"), "token-ids"), kind)
