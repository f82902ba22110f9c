"""Lloyd's clustering of quantised vectors by weighted deduplication.

Equal quantised vectors are one row with a multiplicity; every round runs over
the distinct ones only. A task hands on, for each centroid, the sum of its
vectors times their multiplicities as exact integers, so that a round gives the
driver (centroids x dimensions) numbers however many vectors there are. The
last assignment is joined back to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle

#: Components are held within this, so that a squared distance of 64 of them fits into a long.
LIMIT = 1 << 27
#: Below this, products of 64 components are exact in double precision.
_EXACT = 1 << 22
_SLICE = 1 << 12
_LOW = (1 << 32) - 1
_LONGEST = (1 << 63) - 1


class Clusters(NamedTuple):
    rows: DataFrame  # vec_id, cluster, distance
    centroids: list[tuple[int, ...]]
    inertia: list[int]  # of each cluster


def pack(m: np.ndarray) -> list[bytes]:
    """Each row's integers as bytes, two each where they fit, else four: equal rows give equal bytes."""
    out = [row.tobytes() for row in m.astype("<i2" if len(m) and np.abs(m).max() < 1 << 15 else "<i4")]
    if len(m) and len(out[0]) == 4 * m.shape[1]:
        small = np.flatnonzero(np.abs(m).max(axis=1) < 1 << 15)
        for i in small:
            out[i] = m[i].astype("<i2").tobytes()
    return out


def unpack(rows: list[bytes], dims: int) -> np.ndarray:
    m = np.empty((len(rows), dims), np.int64)
    for width, kind in ((2 * dims, "<i2"), (4 * dims, "<i4")):
        own = [i for i, r in enumerate(rows) if len(r) == width]
        if own:
            m[own] = np.frombuffer(b"".join(rows[i] for i in own), kind).reshape(-1, dims)
    return m


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number of two equally near, and the squared distance: exact."""
    who, far = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    for at in range(0, len(x), _SLICE):
        part = x[at : at + _SLICE]
        if max(np.abs(part).max(), np.abs(centroids).max()) < _EXACT:
            p, c = part.astype(np.float64), centroids.astype(np.float64)
            d = ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
        else:
            d = np.stack([((part - c) ** 2).sum(1) for c in centroids], 1)
        own = d.argmin(1)
        who[at : at + _SLICE], far[at : at + _SLICE] = own, d[np.arange(len(part)), own]
    return who, far


def weighted_sums(x: np.ndarray, n: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    """(k, dims + 1) Python integers: the sum of each cluster's rows times n, and of n itself in the last column."""
    out = np.zeros((k, x.shape[1] + 1), object)
    safe = int(n.sum()) * max(1, int(np.abs(x).max(initial=0))) < 1 << 62
    for c in np.unique(who):
        own = who == c
        w = n[own] if safe else n[own].astype(object)
        out[c, :-1] = [int(v) for v in (x[own] * w[:, None]).sum(0)]
        out[c, -1] = int(w.sum())
    return out


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the vectors with exactly dims components, none null or non-finite; v packs floor(scale * x)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), dims), False))
            m = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            fine = np.isfinite(m).all(axis=1)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * m[fine]), -LIMIT, LIMIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(fine)), pa.array(pack(q), pa.binary())], ["vec_id", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(of, "vec_id long, v binary")


def _round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """weighted_sums() of all distinct vectors assigned to these centroids."""
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), object)
        for b in batches:
            if b.num_rows:
                x = unpack(b.column("v").to_pylist(), dims)
                total += weighted_sums(x, b.column("n").to_numpy(), nearest(x, centroids)[0], k)
        own = [c for c in range(k) if total[c, -1]]
        parts = [pa.array([[f(v) for v in total[c]] for c in own], pa.list_(pa.int64())) for f in (lambda v: v >> 32, lambda v: v & _LOW)]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *parts], ["cluster", "high", "low"])

    rows = distinct.mapInArrow(partial, "cluster int, high array<long>, low array<long>")
    sums = rows.select("cluster", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    out = np.zeros((k, dims + 1), object)
    for r in sums.collect():  # centroids x (dims + 1) rows at most
        out[r.cluster, r.at] = (r.high << 32) + r.low
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2") -> Clusters:
    """Clusters of vectors(vec_id, embedding), from the k vectors whose `salt:vec_id` has the smallest SHA-256.

    Only vectors of exactly dims components, all finite, take part; each
    component becomes floor(scale * x), held within LIMIT. Rows with a null
    vec_id are clustered but start no centroid; rows that repeat a vec_id are
    vectors of their own (equal hashes are ordered by the packed vector); fewer
    than k vectors make fewer centroids, and none give no rows. A round replaces
    every centroid that has vectors by the floor of their mean.
    """
    spark = vectors.sparkSession
    rows = settle(quantised(vectors, dims, scale), "quantised")
    distinct = settle(rows.groupBy("v").agg(F.count("*").alias("n")), "distinct")
    first = rows.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    centroids = unpack([bytes(r.v) for r in first.orderBy("h", "v").limit(k).collect()], dims)
    if not len(centroids):
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [])
    for _ in range(rounds):
        sums = _round(distinct, centroids)
        centroids = np.array([[int(v) // int(s[-1]) for v in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids, strict=True)], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, far = nearest(unpack(b.column("v").to_pylist(), dims), centroids)
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("n"), pa.array(who), pa.array(far)], ["v", "n", "cluster", "distance"])

    assigned = settle(distinct.mapInArrow(assign, "v binary, n long, cluster int, distance long"), "assigned")
    inertia = [0] * len(centroids)
    for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")).alias("s")).collect():
        inertia[r.cluster] = int(r.s)
    found = lookup(rows, "v", assigned.select("v", "cluster", "distance"), "inner", by=["vec_id"]).select("vec_id", "cluster", "distance")
    return Clusters(found, [tuple(map(int, c)) for c in centroids], inertia)


def digest(found: Clusters) -> DataFrame:
    """found.rows with cluster_inertia, inertia (at most the largest long) and centroid_sha256, of the centroid's integers joined by commas."""
    if not found.centroids:
        return found.rows.selectExpr("*", "CAST(NULL AS LONG) AS cluster_inertia", "CAST(NULL AS LONG) AS inertia", "CAST(NULL AS STRING) AS centroid_sha256")
    held = lambda v: F.lit(min(v, _LONGEST)).cast("long")
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    return found.rows.select("*", F.get(F.array(*map(held, found.inertia)), F.col("cluster")).alias("cluster_inertia"), held(sum(found.inertia)).alias("inertia"), F.get(F.array(*map(F.lit, sha)), F.col("cluster")).alias("centroid_sha256"))
