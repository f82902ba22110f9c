"""Exact token counts, huge documents by overlapping chunks spliced where they must agree.

A place in a text is a stable boundary if no piece of the vocabulary occurs
across it: then no merge can ever cross it, whatever lies further away, and both
sides are encoded independently. The few characters around a place decide that.
Chunks of a huge document overlap; each takes the first stable boundary inside
an overlap that its own encoding also has, and counts its tokens between its two
boundaries. Where a document has an overlap without one, or neighbours don't
take the same, its overlaps are widened and it is counted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle, small_batches, union_all, unused

#: Characters of a chunk, and of the first overlap.
CHUNK, OVERLAP = 32_768, 512
_CHUNK_ROW = "left int, right int, n long"


class PieceCounter:
    """A sentencepiece BPE model, with what is needed to place its tokens in a text."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.bytes_of = np.ones(size, np.int64)
        self.bytes_of[plain] = [len(pieces[i].replace("▁", " ").encode()) for i in plain]
        self.longer = {pieces[i] for i in plain if len(pieces[i]) > 1}
        self.reach = max(map(len, self.longer), default=1)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def stable(self, text: str, at: int) -> bool:
        """No piece occurs across at, given text with its blanks escaped and reaching far enough to both sides."""
        for s in range(max(0, at - self.reach + 1), at):
            for e in range(at + 1, min(len(text), s + self.reach) + 1):
                if text[s:e] in self.longer:
                    return False
        return True

    def boundaries(self, chunk: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Code-point places where a token of the chunk ends, and how many tokens end up to each; None if they can't be told."""
        ids = np.array(self.sp.encode(chunk), np.int64)
        raw = np.frombuffer(chunk.encode(), np.uint8)
        ends = np.cumsum(self.bytes_of[ids]) - 1  # the blank put before the text
        if not len(ids) or ends[-1] != len(raw):
            return None
        starts = np.r_[(raw & 0xC0) != 0x80, True]
        whole = np.flatnonzero(starts[np.maximum(ends, 0)] & (ends >= 0))
        chars = np.cumsum(starts) - 1
        return chars[ends[whole]], whole + 1

    def chunk_row(self, chunk: str, overlap: int, first: bool, last: bool) -> tuple[int | None, int | None, int | None]:
        """(left, right, n): the chunk's boundaries in the overlaps at its start and end, from the start of each, and its tokens between them.

        0 stands for the document's own start and end. All three are null where an overlap has no boundary.
        """
        if first and last:
            return 0, 0, self.count([chunk])[0]
        found = self.boundaries(chunk)
        if found is None:
            return None, None, None
        places, upto = found
        escaped = chunk.replace(" ", "▁")

        def place(base: int) -> tuple[int | None, int]:
            a, b = np.searchsorted(places, [base + self.reach, base + overlap - self.reach])
            for k in range(a, b):
                if self.stable(escaped, int(places[k])):
                    return int(places[k]) - base, int(upto[k])
            return None, 0

        left, before = (0, 0) if first else place(0)
        right, to = (0, int(upto[-1])) if last else place(len(chunk) - overlap)
        return (None, None, None) if left is None or right is None else (left, right, to - before)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One a worker process."""
    return PieceCounter(path)


def _long_counts(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) per row of long(key, text), keys all different; n_tokens is null where some overlap has no boundary."""

    @F.pandas_udf(_CHUNK_ROW)
    def row(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for texts, firsts, lasts in batches:
            rows = [own.chunk_row(t, overlap, f, e) for t, f, e in zip(texts, firsts, lasts, strict=True)]
            yield pd.DataFrame(rows, columns=["left", "right", "n"]).astype("Int64")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A text's chunks, one slice after the other: each part of a text is read once, or twice in an overlap."""
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                # The last chunk is at least an overlap long, so that its left boundary can lie anywhere in it.
                last = max(0, (len(text) - overlap - 1) // chunk)
                for a in range(0, last + 1, 64):
                    own = range(a, min(last + 1, a + 64))
                    parts = [text[i * chunk :] if i == last else text[i * chunk : (i + 1) * chunk + overlap] for i in own]
                    yield pd.DataFrame({"key": key, "i": [*own], "last": last, "part": parts})

    rows = long.mapInPandas(cut, "key string, i int, last int, part string").repartition("key", "i")
    rows = rows.withColumn("r", row("part", F.col("i") == 0, F.col("i") == F.col("last"))).select("key", "i", "last", "r.*")
    one = rows.groupBy("key", "last").agg(F.array_sort(F.collect_list(F.struct("i", "left", "right", "n"))).alias("c"))
    agree = F.forall(F.sequence(F.lit(0), F.col("last")), lambda i: F.col("c")[i]["n"].isNotNull() & ((i == 0) | (F.col("c")[F.greatest(i - 1, F.lit(0))]["right"] == F.col("c")[i]["left"])))
    return one.select("key", F.when(agree, F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with columns n_bytes and n_tokens: the sentencepiece tokens of each whole text, no begin or end added.

    Texts of at most 2 * chunk characters are encoded as they are. Longer ones
    become chunk rows, dealt over the cluster; equal texts are counted once.
    Null texts count as empty: 0 bytes, 0 tokens. Rows that repeat stay; extra
    columns stay, ones named n_bytes or n_tokens are replaced.
    """

    @F.pandas_udf("long")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(counter(path).count(s.tolist()), dtype="int64")

    limit = 2 * chunk
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("n_bytes", F.octet_length(text).cast("long"))
    short = docs.where(F.char_length(text) <= limit).withColumn("n_tokens", whole(text))
    long = docs.where(F.char_length(text) > limit)
    small_batches(docs.sparkSession)
    # Each task hands on one of the equal texts that it has.
    todo = long.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("text").alias("text"))
    done = []
    while True:
        counts = settle(_long_counts(todo, path, chunk, overlap), "chunk-counts")
        done.append(counts.where("n_tokens IS NOT NULL"))
        failed = counts.where("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            break
        todo = todo.join(failed, "key", "left_semi")
        overlap *= 4
        chunk = max(chunk, 2 * overlap)
    key, n = unused(short.columns, "key", "n")
    counts = union_all(done).select(F.col("key").alias(key), F.col("n_tokens").alias(n))
    found = lookup(long.withColumn(key, F.sha2("text", 256)), key, counts, by=["doc_id"])
    return short.unionByName(found.withColumn("n_tokens", F.col(n)).select(*short.columns))
