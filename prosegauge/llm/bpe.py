"""BPE encoding by a distinct-word table, and decoding by an id-to-piece join.

Documents are split into words, every distinct word of the corpus is encoded
once, and the ids are joined back to the words' places. Tasks count their own
distinct words before anything is shuffled. For the join, the most frequent
words go to every task, as many as fit a fixed size; where that is not the
whole table, the places of the rarer words stay open and meet their ids in a
shuffle of each chunk's distinct rarer words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import settle, small_batches
from .packing import binaries, pack, unpack
from .words import Chunk, per_document, spread, word_tokenizer

#: Bytes of the table that every task gets.
HEAD_BYTES = 96 << 20
#: Stretches planned for a chunk; all words of a chunk are in a worker's memory, with the head.
STRETCHES = 500_000
#: Stretches whose ids are put in order at once, or one document's: their places take eight bytes an id, three times over.
AT_ONCE = 100_000
#: Words of the head whose ids are put in place at once: their places take eight bytes an id, three times over.
ORDERED = 1 << 16
#: Bytes of the head planned for a part that comes to the driver.
PART_BYTES = 4 << 20
_BUNDLES = "chunk long, mark long, doc_ids array<long>, sizes array<long>, places binary"
_TAIL = "chunk long, mark long, at int, word string"


class Head(NamedTuple):
    """The sent part of the table: word hashes in order, where each word's ids start, all ids, and whether no word is missing."""

    hashes: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    whole: bool


def _kind(path: str) -> str:
    return "<u2" if word_tokenizer(path).n_ids <= 1 << 16 else "<u4"


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """(word, n, ids binary) of all distinct words of docs(doc_id, text), each encoded once; in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(path, batches):
            of_stretch = np.bincount(c.places, minlength=len(c.starts) - 1)
            n = np.bincount(c.inner, np.repeat(of_stretch, np.diff(c.starts)), len(c.words))
            yield pa.RecordBatch.from_arrays([c.words, pa.array(n.astype(np.int64))], ["word", "n"])

    kind = _kind(path)

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            starts, ids = word_tokenizer(path).encode_words(pa.array(s, pa.string()))
            yield pd.Series(binaries(ids.astype(kind), starts).to_pandas(), dtype=object)

    words = docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return settle(words.withColumn("ids", encoded("word")), "word-table")


def _head(table: DataFrame, kind: str, most: int) -> Head:
    """The words of at least some count, the smallest under which hashes and ids take at most `most` bytes.

    Words whose hash another word of the table has are not sent: they are found by themselves.
    """
    step = np.dtype(kind).itemsize
    table = table.withColumn("h", F.xxhash64("word"))
    twice = [r.h for r in table.groupBy("h").count().where("count > 1").select("h").toLocalIterator()]  # 64 bits: hardly ever any
    sizes = table.groupBy("n").agg(F.sum(F.length("ids") + 12).alias("bytes"), F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    fits = sizes["bytes"].cumsum() <= most
    least = int(sizes["n"][fits].min()) if fits.any() else None

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sizes = np.array([len(x) // step for x in pdf["ids"]], "<u4")
                yield pd.DataFrame({"h": [pdf["h"].to_numpy("<i8").tobytes()], "k": [sizes.tobytes()], "ids": [b"".join(pdf["ids"])]})

    own = table.where(F.col("n") >= least) if least is not None else table.where("false")
    n, most_ids = int(sizes["words"][fits].sum()), int(sizes["bytes"][fits].sum() - 12 * sizes["words"][fits].sum()) // step
    h, starts, ids = np.empty(n, "<i8"), np.zeros(n + 1, np.int32 if most_ids < 1 << 31 else np.int64), np.empty(most_ids, kind)
    at = at_ids = 0
    # Spark orders them; a part at a time comes into its place, so that the driver never holds the words twice.
    parts = 1 + int(sizes["bytes"][fits].sum()) // PART_BYTES
    for r in own.select("h", "ids").repartitionByRange(parts, "h").sortWithinPartitions("h").mapInPandas(packed, "h binary, k binary, ids binary").toLocalIterator():
        own_h, own_ids = np.frombuffer(r.h, "<i8"), np.frombuffer(r.ids, kind)
        own_starts = np.r_[0, np.cumsum(np.frombuffer(r.k, "<u4"), dtype=np.int64)]
        alone = np.flatnonzero(~np.isin(own_h, np.array(twice, np.int64))) if twice else np.arange(len(own_h))
        for i in range(0, len(alone), ORDERED):
            some = alone[i : i + ORDERED]
            part, k = spread(own_starts, own_ids, some)
            h[at : at + len(some)], starts[at + 1 : at + len(some) + 1], ids[at_ids : at_ids + len(part)] = own_h[some], at_ids + np.cumsum(k), part
            at, at_ids = at + len(some), at_ids + len(part)
    return Head(h[:at], starts[: at + 1], ids[:at_ids], bool(fits.all()) and at == n)


def _found(head: Head, words: pa.StringArray) -> tuple[np.ndarray, list[str]]:
    """Each word's place in the head, or the head's size plus its number among those that aren't there; and these."""
    words = words.to_numpy(zero_copy_only=False)
    h = np.fromiter((xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)
    at = np.searchsorted(head.hashes, h)
    there = at < len(head.hashes)
    there[there] = head.hashes[at[there]] == h[there]
    at[~there] = len(head.hashes) + np.arange((~there).sum())
    return at, words[~there].tolist()


def _chunks(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of documents; what Arrow keeps of one goes back to the system before the next."""
    for c in word_tokenizer(path).chunks(batches, STRETCHES):
        yield c
        del c
        pa.default_memory_pool().release_unused()


def _encoded(path: str, head: Head, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, how many each has) of some documents each, by a head that holds all words."""
    for c in _chunks(path, batches):
        at, tail = _found(head, c.words)
        if tail:
            raise RuntimeError("the documents changed between two passes; write them to a table first")
        starts, ids = stretch_ids(c, *spread(head.starts, head.ids, at))
        for doc_ids, sizes, places in c.slices(AT_ONCE):
            own, k = spread(starts, ids, places)
            yield doc_ids, own, per_document(sizes, k)
        del c  # before the next one is made


def encode(docs: DataFrame, path: str, head_bytes: int = HEAD_BYTES, pieces: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids array<int>) per row of docs(doc_id, text), as the tokenizers library gives them without added tokens.

    With pieces(id, piece), also a column decoded as decode() makes it, joined
    in the same pass, which spares a second Python process for each task.

    path is the tokenizer's file, found at the same place on every executor.
    Null and empty texts have no ids; rows that repeat stay, and a null doc_id
    stays null; extra columns are left out. docs must give the same rows in the
    same partitions when computed again, as tables read from files do: chunks
    carry a digest of their rarer words, and differing digests raise an error.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    table = word_table(docs, path)
    kind = _kind(path)
    head = _head(table, kind, head_bytes)
    whole, held = head.whole, docs.sparkSession.sparkContext.broadcast(head)
    del head  # the driver needs it no more; asking held for its value would read it back
    schema = "doc_id long, ids array<int>" + ("" if pieces is None else ", decoded string")
    vocab = _held_pieces(pieces) if pieces is not None else None

    def rows(doc_ids: pa.Array, ids: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(k)].astype(np.int32), ids.astype(np.int32))
        out = {"doc_id": doc_ids, "ids": lists}
        return pa.RecordBatch.from_pydict(out if vocab is None else out | {"decoded": _texts(vocab.value, lists)})

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, own, k in _encoded(path, held.value, batches):
            yield rows(doc_ids, own, k)

    if whole:
        return docs.mapInArrow(direct, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[str], np.ndarray, Chunk]]:
        """(number, digest, rarer words, places of all words, chunk) of each chunk of a task."""
        part = TaskContext.get().partitionId()
        for seq, c in enumerate(_chunks(path, batches)):
            at, tail = _found(held.value, c.words)
            yield (part << 24) + seq, _digest(tail), tail, at, c

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, mark, words, _, _ in cut(batches):
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.repeat(chunk, n), pa.repeat(mark, n), pa.array(np.arange(n, dtype=np.int32)), pa.array(words, pa.string())], ["chunk", "mark", "at", "word"])

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, mark, _, at, c in cut(batches):
            for doc_ids, sizes, places in c.slices(AT_ONCE):
                own, k = spread(c.starts, at[c.inner], places)
                row = {"chunk": chunk, "mark": mark, "doc_ids": doc_ids.to_pylist(), "sizes": per_document(sizes, k).tolist(), "places": pack(own)}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.int64()), ("mark", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("places", pa.binary())]))

    def laid_out(bundles: pa.Table, tail: pa.Table) -> pa.Table:
        if len({*bundles["mark"].to_pylist(), *tail["mark"].to_pylist()}) > 1:
            raise RuntimeError("the documents changed between two passes; write them to a table first")
        head, own = held.value, tail.sort_by("at")["ids"].to_pylist()
        k = np.array([len(x) for x in own], np.int64) // np.dtype(kind).itemsize
        starts = np.r_[head.starts, head.starts[-1] + np.cumsum(k)].astype(np.int64)
        ids = np.concatenate([head.ids, np.frombuffer(b"".join(own), kind)])
        out = []
        for r in bundles.to_pylist():
            flat, k = spread(starts, ids, unpack(r["places"]))
            out.append(rows(pa.array(r["doc_ids"], pa.int64()), flat, per_document(np.array(r["sizes"], np.int64), k)))
        return pa.Table.from_batches(out)

    tail = docs.mapInArrow(tails, _TAIL).join(table.select("word", "ids"), "word").select("chunk", "mark", "at", "ids")
    return docs.mapInArrow(bundled, _BUNDLES).groupBy("chunk").cogroup(tail.groupBy("chunk")).applyInArrow(laid_out, schema)


def stretch_ids(c: Chunk, word_ids: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids) of a chunk's stretches, from all ids of its words and how many each has."""
    ids, n = spread(np.r_[0, np.cumsum(k)], word_ids, c.inner)
    return np.r_[0, np.cumsum(per_document(np.diff(c.starts), n))], ids


def _digest(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the tokenizer's whole vocabulary."""
    return spark.createDataFrame(word_tokenizer(path).pieces(), "id int, piece string")


def _held_pieces(pieces: DataFrame):
    """The pieces by id, for every task: a vocabulary bounds them."""
    rows = sorted((r.id, r.piece) for r in pieces.toLocalIterator())
    table: list[str | None] = [None] * (rows[-1][0] + 1 if rows else 0)
    for i, piece in rows:
        table[i] = piece
    return pieces.sparkSession.sparkContext.broadcast(table)


def _texts(pieces: list[str | None], ids: pa.ListArray) -> pa.StringArray:
    found = pa.array(pieces, pa.string()).take(ids.values)
    if found.null_count:
        raise ValueError("an id without a piece")
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, found), " ")


def decode(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """encoded with a column decoded: the pieces of its ids (array<int>) joined by blanks.

    A map-side join with pieces(id, piece), which a vocabulary bounds and every
    task gets whole. No ids give an empty text, null gives null; an unknown id
    raises an error. Extra columns stay, one named decoded is replaced.
    """
    held = _held_pieces(pieces)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            there = s.notna().to_numpy()
            own = s[there].tolist()
            flat = np.concatenate([np.zeros(0, np.int32), *own]).astype(np.int32)
            out = pd.Series([None] * len(s), dtype=object)
            out[there] = _texts(held.value, pa.ListArray.from_arrays(np.cumsum([0, *map(len, own)]).astype(np.int32), flat)).to_numpy(zero_copy_only=False)
            yield out

    return encoded.withColumn("decoded", text("ids"))
