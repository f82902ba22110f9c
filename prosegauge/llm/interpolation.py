"""Documents scored by an n-gram model with deleted interpolation.

The probability of a token is mixed of maximum-likelihood estimates, the longest
context first: p_k = w_k(b) * count(context, token) / count(context) + (1 - w_k(b)) * p_(k-1),
where b is the bucket of the context's frequency (its binary length) and p_0 is
uniform over the known tokens and one unknown one. The weights are learnt by
expectation-maximisation on a deleted part: counts of the rest of the training
documents, held against the tokens of that part. The final estimates count all
training documents.

Documents are cut into lots of bounded size, each of one part only. A lot keeps
its distinct n-grams once: it sends their keys and counts to the shards that own
them, a shard sums up what all lots have sent and answers each lot with the sums
of its own keys, in order. So counts cross the network once a lot, whatever is
frequent is one entry a lot and no task's burden, and no model table is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import settle

#: Tokens planned for a lot, keys planned for a shard, bytes of a text that are split at once.
LOT, SHARD, SEGMENT = 1 << 21, 1 << 22, 1 << 23
#: Buckets of context frequencies; rounds of learning at most, and the gain in log10 a token below which they stop.
BUCKETS, ROUNDS, GAIN = 65, 20, 1e-5
HELD, COUNTED, DELETED = 0, 1, 2
_END = xxh64_intdigest(b"", 1)  # a word is never empty
_START = [np.uint64(xxh64_intdigest(bytes([k]), 2)) for k in range(16)]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def planes(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: what is mostly zero compresses to nothing."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel() if data else np.zeros(0, kind)


def narrow(a: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(a) or int(a.max()) < 1 << 8 * int(k[1]))
    return kind[1].encode() + a.astype(f"<{kind}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int64)


def pieces(text: str | None, order: int) -> Iterator[tuple[int, list[bytes], bool]]:
    """(lead, words, last) of a text's segments, cut at blanks; lead: how many words of the segment before are repeated, as context."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    at, before = 0, []
    while True:
        end = at + SEGMENT
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            nxt = min((i for i in (raw.find(bytes([c]), end, end + SEGMENT) for c in b" \t\n\x0b\x0c\r") if i >= 0), default=-1)
            end = nxt if nxt >= 0 else min(len(raw), end + SEGMENT)
        words = raw[at:end].split()
        last = end >= len(raw)
        yield len(before), before + words, last
        if last:
            return
        before = (before + words)[-(order - 1) :] if order > 1 else []
        at = end


class _Lot:
    """The pieces of documents of one part, with ids of their own for words."""

    def __init__(self, part: int):
        self.part, self.ids, self.tokens, self.rows = part, _Ids({None: 0}), [], []  # id 0: the end

    def add(self, uid: int, doc_id: object, lead: int, words: list[bytes], last: bool) -> None:
        own = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.tokens.append(np.append(own, np.int32(0)) if last else own)
        self.rows.append((uid, doc_id, len(self.tokens[-1]), lead))


def lots(docs: DataFrame, order: int) -> DataFrame:
    """Lots of docs(doc_id, text, part): one row each, with its documents, word hashes and token ids."""
    kind = docs.schema["doc_id"].dataType
    schema = f"lot long, part int, uids array<long>, doc_ids array<{kind.simpleString()}>, sizes array<int>, leads array<int>, n long, n_docs long, words binary, tokens binary"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n_lots, n_docs = TaskContext.get().partitionId(), 0, 0
        opened: dict[int, _Lot] = {}
        sizes: dict[int, int] = {}

        def row(lot: _Lot) -> pa.RecordBatch:
            nonlocal n_lots
            uids, ids, size, lead = (list(x) for x in zip(*lot.rows, strict=True))
            hashes = np.fromiter((_END if w is None else xxh64_intdigest(w) for w in lot.ids), np.uint64, len(lot.ids))
            n_lots += 1
            values = [(place << 32) + n_lots, lot.part, uids, ids, size, lead, sum(size) - sum(lead), sum(not x for x in lead), hashes.tobytes(), planes(np.concatenate(lot.tokens))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for b in batches:
            id_type = b.schema.field("doc_id").type
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["lot", "part", "uids", "doc_ids", "sizes", "leads", "n", "n_docs", "words", "tokens"]
            for doc_id, text, part in zip(*(b.column(c) for c in ("doc_id", "text", "part")), strict=True):
                n_docs += 1
                part = part.as_py()
                for lead, words, last in pieces(text.as_py(), order):
                    lot = opened.setdefault(part, _Lot(part))
                    lot.add((place << 40) + n_docs, doc_id.as_py(), lead, words, last)
                    sizes[part] = sizes.get(part, 0) + len(words) + 1
                    if sizes[part] >= LOT:
                        yield row(opened.pop(part))
                        del sizes[part]
        for lot in opened.values():
            yield row(lot)

    return docs.select("doc_id", "text", "part").mapInArrow(of, schema)


def _mixed(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for add in (b, None):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
        x = x + add if add is not None else x
    return x


class Grams:
    """A lot's n-grams: for each order the sorted distinct keys, and which of them ends at each token."""

    def __init__(self, words: bytes, tokens: bytes, sizes: list[int], leads: list[int], order: int):
        hashes, ids = np.frombuffer(words, np.uint64), unplanes(tokens, "<i4")
        sizes, leads = np.asarray(sizes, np.int64), np.asarray(leads, np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.first = self.begins[leads == 0]  # where a document begins
        self.own = np.ones(len(ids), bool)  # not repeated as context
        for at, lead in zip(self.begins[leads > 0], leads[leads > 0], strict=True):
            self.own[at : at + lead] = False
        rank = np.empty(len(hashes), np.int64)
        sort = np.argsort(hashes)
        rank[sort] = np.arange(len(hashes))
        self.keys, self.at = [hashes[sort]], [rank[ids]]
        long = hashes[ids]
        for k in range(2, order + 1):
            before = np.empty_like(long)
            before[1:], before[self.begins] = long[:-1], _START[k]
            long = _mixed(before, hashes[ids], k)
            keys, at = np.unique(long, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at.ravel())

    def counts(self) -> list[np.ndarray]:
        return [np.bincount(a[self.own], minlength=len(k)) for k, a in zip(self.keys, self.at, strict=True)]

    def of_tokens(self, answers: list[np.ndarray], n_docs: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each order, the count of the n-gram that ends at each own token, and of its context; answers: a count a key."""
        counts, contexts = [], []
        for k, (a, at) in enumerate(zip(answers, self.at, strict=True)):
            c = a[at]
            if k:
                x = np.empty_like(c)
                x[1:] = counts[-1][:-1]
                x[self.first] = n_docs
            else:
                x = np.full(len(c), n, np.int64)
            counts.append(c)
            contexts.append(x)
        return [c[self.own] for c in counts], [x[self.own] for x in contexts]


def _asked(table: DataFrame, order: int, shards: int) -> DataFrame:
    """A row a lot and shard: keys of each order and, where the lot teaches, their counts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                g = Grams(r["words"], r["tokens"], r["sizes"], r["leads"], order)
                counts = g.counts() if r["part"] != HELD else None
                # A shard is a range of keys.
                edges = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
                cuts = [np.r_[0, np.searchsorted(k, edges), len(k)] for k in g.keys]
                rows = []
                for s in range(shards):
                    spans = [slice(c[s], c[s + 1]) for c in cuts]
                    sizes = [x.stop - x.start for x in spans]
                    if any(sizes):
                        keys = np.concatenate([np.diff(k[x], prepend=np.uint64(0)) for k, x in zip(g.keys, spans, strict=True)])
                        rows.append((s, r["lot"], r["part"], sizes, planes(keys), narrow(np.concatenate([c[x] for c, x in zip(counts, spans, strict=True)])) if counts else b""))
                types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["shard", "lot", "part", "sizes", "keys", "counts"])

    return table.select("lot", "part", "sizes", "leads", "words", "tokens").mapInArrow(of, "shard int, lot long, part int, sizes array<int>, keys binary, counts binary")


def _sections(sizes: list[int]) -> list[slice]:
    ends = np.cumsum(sizes)
    return [slice(int(e) - n, int(e)) for e, n in zip(ends, sizes, strict=True)]


def _answered(asked: DataFrame, order: int) -> DataFrame:
    """For each row of _asked() the sums over all lots, and (for the deleted part) over the counted part alone, of its keys; types: distinct known tokens, and of the counted part, on a shard's first row."""
    schema = "shard int, lot long, part int, sizes array<int>, every binary, counted binary, types array<long>"

    def of(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        every, counted = [[] for _ in rows], [[] for _ in rows]
        types = [0, 0]
        split = [_sections(r["sizes"]) for r in rows]
        keys, counts = [unplanes(r["keys"], "<u8") for r in rows], [wide(r["counts"]) if r["counts"] else None for r in rows]
        for k in range(order):
            own = [np.cumsum(x[s[k]], dtype=np.uint64) for x, s in zip(keys, split, strict=True)]
            distinct, at = np.unique(np.concatenate(own), return_inverse=True)
            at, cuts = at.ravel(), np.cumsum([len(x) for x in own])[:-1]
            sums = np.zeros((2, len(distinct)), np.int64)
            for r, c, s, a in zip(rows, counts, split, np.split(at, cuts), strict=True):
                if c is not None:
                    sums[0, a] += c[s[k]]  # a lot's keys are distinct
                    if r["part"] == COUNTED:
                        sums[1, a] += c[s[k]]
            if not k:
                types = [int((x > 0).sum()) for x in sums]
            for i, a in enumerate(np.split(at, cuts)):
                every[i].append(sums[0, a])
                if rows[i]["part"] == DELETED:
                    counted[i].append(sums[1, a])
        out = {
            "shard": [r["shard"] for r in rows], "lot": [r["lot"] for r in rows], "part": [r["part"] for r in rows], "sizes": [r["sizes"] for r in rows],
            "every": [narrow(np.concatenate(x)) for x in every], "counted": [narrow(np.concatenate(x)) if x else b"" for x in counted], "types": [types if not i else [0, 0] for i in range(len(rows))],
        }
        return pa.table(out, pa.schema([("shard", pa.int32()), ("lot", pa.int64()), ("part", pa.int32()), ("sizes", pa.list_(pa.int32())), ("every", pa.binary()), ("counted", pa.binary()), ("types", pa.list_(pa.int64()))]))

    return asked.groupBy("shard").applyInArrow(of, schema)


def _answers(table: pa.Table, column: str, order: int) -> list[np.ndarray]:
    rows = sorted(table.select(["shard", "sizes", column]).to_pylist(), key=lambda r: r["shard"])
    parts = [(wide(r[column]), _sections(r["sizes"])) for r in rows]
    return [np.concatenate([x[s[k]] for x, s in parts]) for k in range(order)]


def buckets(contexts: np.ndarray) -> np.ndarray:
    """The binary length of a frequency; 0 of none."""
    return np.frexp(contexts.astype(np.float64))[1]


def mixture(counts: list[np.ndarray], contexts: list[np.ndarray], weights: np.ndarray, uniform: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(p_0 .. p_n, each order's weight a token): p_n is the probability."""
    p, ws = [np.full(len(counts[0]), uniform)], []
    for k, (c, x) in enumerate(zip(counts, contexts, strict=True)):
        w = np.where(x > 0, weights[k, buckets(x)], 0.0)
        p.append(w * (c / np.maximum(x, 1)) + (1 - w) * p[-1])
        ws.append(w)
    return p, ws


def expectations(counts: list[np.ndarray], contexts: list[np.ndarray], weights: np.ndarray, uniform: float) -> np.ndarray:
    """(2, orders, BUCKETS): how many tokens each order's bucket is expected to have generated, and how many reached it; the last bucket of order 0 takes the sum of log10 p."""
    p, ws = mixture(counts, contexts, weights, uniform)
    out = np.zeros((2, len(counts) + 1, BUCKETS))
    reach = np.ones(len(counts[0]))  # the share of a token that comes from this order or below
    for k in range(len(counts) - 1, -1, -1):
        b, below = buckets(contexts[k]), (1 - ws[k]) * p[k] / p[k + 1]
        seen = contexts[k] > 0
        out[0, k] = np.bincount(b[seen], (reach * (1 - below))[seen], BUCKETS)
        out[1, k] = np.bincount(b[seen], reach[seen], BUCKETS)
        reach = reach * below
    out[0, -1, 0], out[1, -1, 0] = np.log10(p[-1]).sum(), len(p[-1])
    return out


def _events(table: DataFrame, answers: DataFrame, order: int, n_docs: int, n: int) -> DataFrame:
    """The tokens of the deleted part: their n-grams' and contexts' counts in the counted part."""

    def of(lot: pa.Table, own: pa.Table) -> pa.Table:
        (r,) = lot.to_pylist()
        g = Grams(r["words"], r["tokens"], r["sizes"], r["leads"], order)
        counts, contexts = g.of_tokens(_answers(own, "counted", order), n_docs, n)
        return pa.table({"counts": [[narrow(c) for c in counts]], "contexts": [[narrow(x) for x in contexts]]}, pa.schema([("counts", pa.list_(pa.binary())), ("contexts", pa.list_(pa.binary()))]))

    both = table.where(F.col("part") == DELETED).select("lot", "sizes", "leads", "words", "tokens").groupBy("lot").cogroup(answers.where(F.col("part") == DELETED).groupBy("lot"))
    return both.applyInArrow(of, "counts array<binary>, contexts array<binary>")


def learn(events: DataFrame, order: int, uniform: float) -> np.ndarray:
    """(order, BUCKETS) weights by expectation-maximisation over the events; a bucket without events keeps a half."""
    weights, last = np.full((order, BUCKETS), 0.5), -math.inf
    for _ in range(ROUNDS):

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, order + 1, BUCKETS))
            for b in batches:
                for r in b.to_pylist():
                    total += expectations([wide(c) for c in r["counts"]], [wide(x) for x in r["contexts"]], weights, uniform)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["e"])

        sums = events.mapInArrow(of, "e array<double>").select(F.posexplode("e").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        flat = np.zeros(2 * (order + 1) * BUCKETS)
        for r in sums.collect():  # a row a bucket
            flat[r.i] = r.v
        made, reached = flat.reshape(2, order + 1, BUCKETS)
        if not reached[-1, 0]:
            break
        weights = np.where(reached[:-1] > 0, made[:-1] / np.maximum(reached[:-1], 1e-300), weights)
        now = made[-1, 0] / reached[-1, 0]
        if now - last < GAIN:
            break
        last = now
    return weights


def score(docs: DataFrame, order: int = 2, folds: int = 10) -> DataFrame:
    """One row for each of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words of the text, A-Z lower-cased, and one end. Documents
    whose crc32(doc_id as text) modulo folds is 0 are held out: nothing is learnt
    from them. Those of remainder folds - 1 are the deleted part. base_score sums
    log10((count + 0.1) / (N + 0.1 (V + 1))), score log10 of the model's
    probability. Null texts are empty; a null doc_id is learnt from; rows that
    repeat a doc_id are documents of their own; extra columns are left out; an
    empty table gives none. Without any training document all tokens are
    unknown; without a deleted or a counted part all weights are a half. Words
    and n-grams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(1))
    part = F.when(fold == 0, HELD).when(fold == folds - 1, DELETED).otherwise(COUNTED)
    table = settle(lots(docs.select("doc_id", "text", part.alias("part")), order), "lots")
    sizes = {r.part: (r.n, r.n_docs) for r in table.groupBy("part").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")).collect()}
    n, n_docs = (sum(sizes.get(p, (0, 0))[i] for p in (COUNTED, DELETED)) for i in (0, 1))
    counted_n, counted_docs = sizes.get(COUNTED, (0, 0))
    every_token = sum(x[0] for x in sizes.values())
    answers = settle(_answered(_asked(table, order, max(1, math.ceil(every_token * order / SHARD))), order), "answers")
    known = answers.select(F.sum(F.get("types", F.lit(0))).alias("every"), F.sum(F.get("types", F.lit(1))).alias("counted")).first()
    v, counted_v = known.every or 0, known.counted or 0
    weights = np.full((order, BUCKETS), 0.5)
    if counted_n and DELETED in sizes:
        weights = learn(settle(_events(table, answers, order, counted_docs, counted_n), "events"), order, 1 / (counted_v + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(lot: pa.Table, own: pa.Table) -> pa.Table:
        (r,) = lot.to_pylist()
        g = Grams(r["words"], r["tokens"], r["sizes"], r["leads"], order)
        counts, contexts = g.of_tokens(_answers(own, "every", order), n_docs, n)
        p, _ = mixture(counts, contexts, weights, 1 / (v + 1))
        size = np.asarray(r["sizes"]) - np.asarray(r["leads"])
        at = np.cumsum(size) - size
        total = lambda x: np.where(size > 0, np.add.reduceat(np.append(x, 0), at), 0)
        out = {
            "uid": pa.array(r["uids"], pa.int64()), "doc_id": lot.column("doc_ids").combine_chunks().flatten(), "held_out": pa.array([r["part"] == HELD] * len(size)), "n_tokens": pa.array(size, pa.int64()),
            "n_known": pa.array(total((counts[0] > 0).astype(np.int64)), pa.int64()), "base_score": pa.array(total(np.log10((counts[0] + 0.1) / (n + 0.1 * (v + 1)))), pa.float64()), "score": pa.array(total(np.log10(p[-1])), pa.float64()),
        }
        return pa.table(out)

    both = table.select("lot", "part", "uids", "doc_ids", "sizes", "leads", "words", "tokens").groupBy("lot").cogroup(answers.select("lot", "shard", "sizes", "every").groupBy("lot"))
    rows = both.applyInArrow(of, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    sums = rows.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
