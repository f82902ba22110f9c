"""Approximate nearest neighbours by collision counting with query-centred windows.

Vectors are scaled to length one and dealt into blocks. A block keeps, for each
of `lines` random directions, its projections in sorted order. A query opens a
window around its own projection on every line; a vector that falls into enough
windows is verified by its exact cosine. Windows widen step by step (virtual
rehashing: the sorted arrays stay as they are) until the k nearest verified lie
within the radius that the windows stand for. Queries come in lots of bounded
size; a task takes one block and one lot at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

#: Vectors planned for a block; lines; share of windows that a vector must fall into.
BLOCK, LINES, SHARE = 8192, 48, 0.56
#: Queries planned for a lot: an eighth of them, but at least and at most so many.
LOT = (512, 8192)
#: Radii of the windows, as distances between vectors of length one; the last is beyond the largest.
RADII = 0.2 * 1.2 ** np.arange(14)
INDEX = "dim int, block int, ids binary, vecs binary, places binary, values binary"
FOUND = "query_id long, vec_id long, score double"


def directions(dim: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(20240501).standard_normal((lines, dim))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: no nulls, all components finite, not all zero.

    Of rows that share a vec_id the smallest vector counts. Vectors of another
    length than a query's have no cosine with it and are never found for it.
    """
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _scaled(m: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that their largest components are near one: cosines stay as they are, and no square is too large or small."""
    _, e = np.frexp(np.abs(m).max(axis=1, keepdims=True))
    return np.ldexp(np.ldexp(m, -(e // 2)), -(e - e // 2))


def _unit(m: np.ndarray) -> np.ndarray:
    """Scaled vectors as vectors of length one."""
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def build(vectors: DataFrame, lines: int = LINES, block: int = BLOCK) -> DataFrame:
    """The index (INDEX) of usable vectors, one row a block of one length of vectors, in the shared folder."""
    vectors = vectors.withColumn("dim", F.size("embedding"))
    n = vectors.count()

    def sort_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        vecs = _scaled(_matrix(pdf["embedding"]))
        lie = (_unit(vecs) @ directions(vecs.shape[1], lines).T).T.astype(np.float32)
        places = np.argsort(lie, axis=1, kind="stable").astype("<i4")
        values = np.take_along_axis(lie, places.astype(np.int64), axis=1)
        return pd.DataFrame({"dim": [vecs.shape[1]], "block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "vecs": [vecs.tobytes()], "places": [places.tobytes()], "values": [values.tobytes()]})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // block)))).cast("int"))
    return settle(dealt.groupBy("dim", "block").applyInPandas(sort_block, INDEX), "ann-index")


class _Block:
    """One row of the index. Equal vectors are held once, with their ids in order."""

    def __init__(self, row: pd.Series, dim: int, lines: int):
        ids, vecs = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vecs"], np.float64).reshape(-1, dim)
        raw = np.ascontiguousarray(vecs).view(np.dtype((np.void, 8 * dim))).ravel()
        _, first, of = np.unique(raw, return_index=True, return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.members = np.split(ids[order], np.cumsum(np.bincount(of))[:-1])
        self.vecs, self.dim = vecs[first], dim
        self.norms = np.sqrt((self.vecs * self.vecs).sum(axis=1))
        self.units = _unit(self.vecs).astype(np.float32)
        places = np.frombuffer(row["places"], "<i4").reshape(lines, -1)
        values = np.frombuffer(row["values"], np.float32).reshape(lines, -1)
        heads = np.zeros(len(ids), bool)
        heads[first] = True
        keep = heads[places]
        self.places = of[places[keep]].reshape(lines, -1)
        self.values = values[keep].reshape(lines, -1)

    def near(self, q: np.ndarray, lie: np.ndarray, own: int, k: int, share: float) -> list:
        """The k best (-score, id) of this block, by the method above."""
        lines, n = self.places.shape
        norm = np.sqrt((q * q).sum())
        short = (q / norm).astype(np.float32)
        hits, seen, best = np.zeros(n, np.int64), np.zeros(n, bool), []
        edges = np.array([v.searchsorted(np.r_[x - RADII, x + RADII]) for v, x in zip(self.values, lie, strict=True)])
        low, high = edges[:, : len(RADII)].T.tolist(), edges[:, len(RADII) :].T.tolist()
        inner = (low[0], low[0])
        for radius, lo, hi in zip(RADII, low, high, strict=True):
            # Only what the wider windows have more than the ones before.
            rings = [p[a:b] for p, a, b in zip(self.places, lo, inner[0], strict=True)] + [p[a:b] for p, a, b in zip(self.places, inner[1], hi, strict=True)]
            inner = (lo, hi)
            hits += np.bincount(np.concatenate(rings), minlength=n)
            new = np.flatnonzero(~seen if radius > 2 else (hits >= share * lines) & ~seen)
            seen[new] = True
            if len(new):
                near = self.units[new] @ short
                floor = np.partition(near, -k - 1)[-k - 1] if len(near) > k + 1 else -2
                floor = max(floor, -best[-1][0] if len(best) == k else -2) - 1e-4  # what single precision can't tell apart stays
                for i in new[near >= floor]:
                    score = float((self.vecs[i] * q).sum() / (self.norms[i] * norm))
                    best += [(-score, int(x)) for x in self.members[i][: k + 1] if x != own]
                best = sorted(best)[:k]
            # Distance d between vectors of length one has cosine 1 - d * d / 2.
            if len(best) == k and -best[-1][0] >= 1 - radius * radius / 2:
                break
        return best


def search(index: DataFrame, queries: DataFrame, k: int = 5, lines: int = LINES, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable query(vec_id, embedding) its k nearest found in the index but itself.

    Each lot of queries meets each block once, as one row of packed vectors each,
    and k rows a query and block come out. Equal scores go to the smaller
    vec_id. An empty index or no queries give no rows.
    """
    n, n_blocks = queries.count(), (index.agg(F.max("block")).first()[0] or 0) + 1
    n_lots = max(1, -(-n // min(LOT[1], max(LOT[0], n // 8))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "lot": [int(pdf["lot"].iloc[0])], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "vecs": [_scaled(_matrix(pdf["embedding"])).tobytes()]})

    dealt = queries.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_lots)).cast("int").alias("lot"))
    lots = dealt.groupBy("dim", "lot").applyInPandas(pack, "dim int, lot int, ids binary, vecs binary")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def near(block: pd.DataFrame, lot: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(lot):
            dim = int(block["dim"].iloc[0])
            own, vecs = _Block(block.iloc[0], dim, lines), np.frombuffer(lot["vecs"].iloc[0], np.float64).reshape(-1, dim)
            lie = _unit(vecs) @ directions(dim, lines).T
            for i, q, x in zip(np.frombuffer(lot["ids"].iloc[0], "<i8").tolist(), vecs, lie, strict=True):
                out += [(i, j, -s) for s, j in own.near(q, x, i, k, share)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    sides = index.withColumn("lot", every(n_lots)), lots.withColumn("block", every(n_blocks))
    found = sides[0].groupBy("dim", "block", "lot").cogroup(sides[1].groupBy("dim", "block", "lot")).applyInPandas(near, FOUND)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
