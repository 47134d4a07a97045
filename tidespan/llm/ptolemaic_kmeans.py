"""Centroid clustering of integer vectors, with Ptolemaic lower bounds from cached pivot distances.

For any four points d(q, c) * d(p, s) >= |d(q, p) * d(c, s) - d(q, s) * d(c, p)| (Ptolemy's inequality), so two pivots p and s bound the distance
of a vector q to a centroid c by four distances that are known: those of q to the pivots are computed once and written beside it, those of the
centroids are a few numbers a round.  The bounds are rounded down by more than the error of their double-precision terms; a centroid whose bound is above the
exact distance to another one is ruled out, all others are measured exactly.  A round is one pass over the written vectors that returns a row of
sums for each cluster and task, added up by a plain aggregation; only those sums (k * dim numbers) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .vector_join import _matrix

#: Vectors from which the pivots are learnt (by a hash of id and components); the bound of what is collected for it.
SAMPLE = 4096
#: Relative slack of a bound: each of its terms is off by less than (dim + 8) * 2 ** -53, for up to some thousand dimensions.
SLACK = 1e-12
#: Differences below this give squared distances that doubles hold exactly, for up to 2 ** 9 dimensions; components from the second on are refused.
NARROW, WIDEST = 1 << 21, 1 << 31
OUT = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantized(column, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, exact for scales that are powers of two."""
    q = np.floor(scale * _matrix(column))
    if q.size and np.abs(q).max() >= WIDEST:
        raise OverflowError(f"a component is {WIDEST // scale} or more; squared distances of such vectors do not fit a long")
    return q


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``q`` to one point ``c`` (long)."""
    gap = q - c
    if not gap.size or max(np.abs(q).max(), np.abs(c).max()) < NARROW:
        return np.einsum("ij,ij->i", gap, gap).astype(np.int64)
    out = [sum(int(x) * int(x) for x in row) for row in gap]
    if max(out) >= 1 << 63:
        raise OverflowError("a squared distance does not fit a long")
    return np.array(out, np.int64)


class Pivots:
    """Fixed pivots, their pairs, and the lower bounds they give."""

    def __init__(self, points: np.ndarray):
        points = np.unique(points[np.isfinite(points).all(1)], axis=0)
        self.points = points
        self.between = self.distances(points)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(np.einsum("ij,ij->i", x - p, x - p)) for p in self.points], 1) if len(self.points) else np.zeros((len(x), 0))

    def bounds(self, dq: np.ndarray, dc: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of vectors (pivot distances ``dq``) to centroids (``dc``), from the pairs that hold a centroid's nearest pivot."""
        low = np.zeros((len(dq), len(dc)))
        for c in range(len(dc)):
            if not dc.shape[1]:
                break
            p = int(np.argmin(dc[c]))
            for s in range(dc.shape[1]):
                if s == p:
                    continue
                a, b = dq[:, p] * dc[c, s], dq[:, s] * dc[c, p]
                np.maximum(low[:, c], (np.abs(a - b) - SLACK * (a + b)) * ((1 - SLACK) / self.between[p, s]), out=low[:, c])
        return low


def assign(q: np.ndarray, dq: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many distances were measured."""
    low = pivots.bounds(dq, pivots.distances(centroids))
    low = low * low * (1 - SLACK)
    first = low.argmin(1) if len(centroids) else np.zeros(len(q), int)
    best, cluster, measured = np.zeros(len(q), np.int64), first.copy(), 0
    for c in range(len(centroids)):
        at = np.flatnonzero(first == c)
        best[at] = squared(q[at], centroids[c])
        measured += len(at)
    for c in range(len(centroids)):
        at = np.flatnonzero((first != c) & (low[:, c] <= best * (1 + SLACK)))
        d = squared(q[at], centroids[c])
        measured += len(at)
        nearer = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
        best[at[nearer]], cluster[at[nearer]] = d[nearer], c
    return cluster, best, measured


def learn_pivots(sample: np.ndarray, starts: np.ndarray, rounds: int = 8) -> Pivots:
    """Where plain rounds over a sample take the starting centroids: pivots near the centroids give the tightest bounds.  Any points would be valid."""
    at = starts.astype(float)
    for _ in range(rounds if len(sample) else 0):
        with np.errstate(all="ignore"):
            near = ((sample * sample).sum(1)[:, None] - 2 * sample @ at.T + (at * at).sum(1)).argmin(1)
        for c in range(len(at)):
            if (near == c).any():
                at[c] = sample[near == c].mean(0)
    return Pivots(at)


def _sums(batches: Iterator[pa.RecordBatch], scale: int, centroids: np.ndarray, pivots: Pivots) -> Iterator[pa.RecordBatch]:
    """One row for each cluster of a task: sums of the components, then rows, then squared distance."""
    k, dim = centroids.shape
    total = [[0] * (dim + 2) for _ in range(k)]
    for batch in batches:
        if not batch.num_rows:
            continue
        q, dq = quantized(batch.column("v"), scale), _distances(batch)
        cluster, best, _ = assign(q, dq, centroids, pivots)
        for c in range(k):
            mine = cluster == c
            s = q[mine].astype(np.int64).sum(0).tolist()
            d = int(best[mine].sum()) if not mine.any() or int(best.max()) < (1 << 62) // len(best) else sum(best[mine].tolist())
            total[c] = [x + y for x, y in zip(total[c], [*s, int(mine.sum()), d])]
    rows = [(c, t) for c, t in enumerate(total) if t[dim]]
    kind = pa.list_(pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([[Decimal(x) for x in t] for _, t in rows], kind)], names=["cluster", "s"])


def _distances(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("d").to_pylist()), np.float64).reshape(batch.num_rows, -1)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, salt: str = "3:", vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per kept vector: ``vec_id``, cluster, distance (squared), cluster_inertia and inertia (distance summed over its cluster, over all), centroid_sha256.

    Kept are vectors of ``dim`` components, none of them null or non-finite; component x becomes the integer floor(scale * x), ``scale`` a power of two.  Centroids 0, 1, ... start as
    the ``k`` kept vectors with the smallest lowercase-hex sha256 of ``salt`` and the id, in that order (ties, of repeated ids: by components, and
    equal rows may fill several places); vectors without an id never start one, but are clustered like all others.  A round assigns every vector to its nearest centroid (ties: the
    smaller number) and moves each centroid that has vectors to floor(sum / count) of each component.  Fewer kept vectors than ``k`` give fewer centroids; none give no rows.
    Components of 2 ** 31 / scale or more, or a distance beyond a long, raise OverflowError.  Columns other than ``vec`` and ``vec_id`` are not read.
    """
    v = F.col(vec)
    ok = v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    head = good.where("id is not null").orderBy(hashed, "v").limit(k).collect()
    spark = vectors.sparkSession
    if not head:
        return spark.createDataFrame([], OUT).withColumnRenamed("id", vec_id)
    centroids = quantized(pa.array([r.v for r in head], pa.list_(pa.float64())), scale)
    sample = good.orderBy(F.xxhash64("id", "v"), "v").limit(SAMPLE).collect()
    pivots = learn_pivots(quantized(pa.array([r.v for r in sample], pa.list_(pa.float64())), scale), centroids)

    def cached(batches):
        for batch in batches:
            if batch.num_rows:
                d = pivots.distances(quantized(batch.column("v"), scale))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in d], pa.binary())], names=["id", "v", "d"])

    points = common.materialize(good.mapInArrow(cached, f"id long, v {good.schema['v'].dataType.simpleString()}, d binary"), "pivots")
    inertia: dict[int, int] = {}
    for r in range(rounds + 1):
        at = centroids
        sums = points.select("v", "d").mapInArrow(lambda it, at=at: _sums(it, scale, at, pivots), "cluster int, s array<decimal(38,0)>")
        found = sums.select("cluster", F.posexplode("s").alias("pos", "s")).groupBy("cluster", "pos").agg(F.sum("s").alias("s")).collect()  # k * (dim + 2) rows
        total = {(x.cluster, x.pos): int(x.s) for x in found}
        full = sorted({x.cluster for x in found})
        inertia = {c: total[c, dim + 1] for c in full}
        moved = centroids.copy()
        for c in full:
            moved[c] = [total[c, i] // total[c, dim] for i in range(dim)]
        if r == rounds or np.array_equal(moved, centroids):  # where nothing moves, no later round moves anything
            break
        centroids = moved
    whole = sum(inertia.values())
    sha = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    if max(inertia.values()) >= 1 << 63 or whole >= 1 << 63:
        raise OverflowError("the inertia does not fit a long")

    def final(batches):
        for batch in batches:
            if batch.num_rows:
                cluster, best, _ = assign(quantized(batch.column("v"), scale), _distances(batch), centroids, pivots)
                own = cluster.tolist()
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(best), pa.array([inertia[c] for c in own], pa.int64()), pa.array([whole] * len(own), pa.int64()), pa.array([sha[c] for c in own])], names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return points.mapInArrow(final, OUT).withColumnRenamed("id", vec_id)
