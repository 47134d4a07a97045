"""Exact top-k by inner product: aggregation over sorted lists without random access.

Candidates are dealt into blocks.  In a block each dimension has one list of its rows sorted by that component, which a query reads from the top where its
own component is positive and from the bottom where it is negative.  What has been read of a list bounds what has not: an unread entry adds at
most the query's component times the value last read, and at least that times the value at the list's far end.  Lists are read on in steps, those first whose next entries
lower the bound most for each entry read; a query stops when no row that it hasn't met can reach its threshold, drops rows whose upper
bound is below it, and resolves the scores of the rest exactly.  The threshold is the k-th best of the exact scores of a bounded sample of rows, or the k-th best
lower bound so far if that is higher; both are scores that k rows are known to reach, so no row of the result is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ptolemaic_kmeans import quantized

#: Rows of a block at least and at most; queries of a batch; bytes of the sample that sets the first thresholds, and its rows at most.
LEAST, MOST, BATCH = 4096, 65536, 8192
SAMPLE_BYTES, SAMPLE = 4 << 20, 8192
#: Shares of all entries after which reading may stop; rows tried first, and the share of them that makes looking at all rows worth it.
STEPS = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 9 / 16, 5 / 8, 3 / 4, 1)
TRIED, WORTH = 256, 1 / 8
#: Relative slack of bounds in double precision.
SLACK = 1e-12
FOUND = "qrow long, query_id long, vec_id long, score long"


def exact(rows: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of integer vectors given as doubles."""
    if not rows.size or np.abs(rows).max() * np.abs(q).max() * len(q) < 2**53:
        return (rows @ q).astype(np.int64).tolist()
    return [sum(int(a) * int(b) for a, b in zip(r, q)) for r in rows]


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, x: np.ndarray, grid: int = 32):
        self.x, (self.n, self.dim) = x, x.shape
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()  # list d: rows by ascending component
        self.values = np.take_along_axis(x.T, self.order, 1)
        # Depths at which a list may pause: dense at both ends, where values change fastest.
        share = np.concatenate([np.geomspace(1 / 2048, 1 / 16, grid // 3, endpoint=False), np.linspace(1 / 16, 1, grid - grid // 3)])
        self.depths = np.unique(np.concatenate([[0], np.ceil(share * self.n).astype(int)]))
        self.weight = np.diff(self.depths)  # entries of a step of reading
        last = np.maximum(self.depths - 1, 0)
        self.down, self.up = self.values[:, self.n - 1 - last], self.values[:, last]  # value last read from the top, from the bottom; the head before any is read

    def plan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each list its bounds at each depth, and the bound's fall for each further entry (never rising along a list)."""
        most = q[:, None] * np.where((q > 0)[:, None], self.down, self.up)
        fall = (most[:, :-1] - most[:, 1:]) / self.weight
        return most, np.minimum.accumulate(fall, 1)

    def met(self, q: np.ndarray, depth: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Of each row, the sum of what the entries read (``depth`` of each list) exceed ``floor`` by."""
        out = np.zeros(self.n)
        for d in np.flatnonzero(depth):
            part = slice(self.n - depth[d], self.n) if q[d] > 0 else slice(0, depth[d])
            out[self.order[d, part]] += self.values[d, part] * q[d] - floor[d]
        return out

    def top(self, q: np.ndarray, k: int, least: int | None, own: int = -1) -> tuple[np.ndarray, int]:
        """Rows that may be among the ``k`` best (all that do reach the threshold are among them), and the entries read.

        ``least``: a score that k rows elsewhere reach; ``own``: a row that takes no part.
        """
        every = np.arange(self.dim)
        most, fall = self.plan(q)
        far = q * np.where(q > 0, self.values[:, 0], self.values[:, -1])
        slack = SLACK * float(np.abs(q) @ np.maximum(np.abs(self.values[:, 0]), np.abs(self.values[:, -1])))
        tau = -math.inf if least is None else float(least)
        level = np.sort(fall, axis=None)[::-1]
        spent = np.cumsum(np.tile(self.weight, (self.dim, 1)).ravel()[np.argsort(-fall, axis=None)])
        alive, at = np.arange(self.n), np.zeros(self.dim, int)
        for share in STEPS:
            # Beyond the middle, where values fall slowest, all lists are read alike.
            at = np.maximum(at, (fall >= level[np.searchsorted(spent, share * spent[-1])]).sum(1) if share < 0.5 else np.searchsorted(self.depths, share * self.n))
            depth, bound = self.depths[at], most[every, at]
            outside = float(bound.sum()) + slack  # what a row that was met in no list can reach
            if share < 1:
                tried = self.x[:TRIED]
                if outside >= tau or (np.maximum(tried * q, bound).sum(1) >= tau).mean() > WORTH:
                    continue
            upper = self.met(q, depth, bound) + outside
            if own >= 0:
                upper[own] = -math.inf
            alive = np.flatnonzero(upper >= tau)
            if len(alive) <= max(self.n // 16, 64):
                break
            lower = self.met(q, depth, far) + float(far.sum()) - slack
            if own >= 0:
                lower[own] = -math.inf
            if self.n > k:
                tau = max(tau, float(np.partition(lower, self.n - k)[self.n - k]))
                alive = alive[upper[alive] >= tau]
        return alive, int(depth.sum())


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec: str = "embedding", vec_id: str = "vec_id", block: int | None = None, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the ``k`` rows with the highest integer inner products (all, if fewer), ties to the smaller id.

    A component x becomes floor(scale * x).  Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own.  Vectors that are null
    or hold null or non-finite components take no part, and neither do rows without an id (there is nothing to return for them).  Vectors of another length than the query's are no candidates
    of it; one without components has the score 0 with its like.  Rows with one id are different candidates, and each a query of its own; equal rows are in no particular
    order.  Components of 2 ** 31 / scale or more raise OverflowError, and so does a score beyond a long.  Other columns are not read.

    Each block of candidates meets each batch of queries in one task: rows sent are candidates * batches + queries * blocks, and grow with the square of the table as the
    question does; memory is that of one block's lists.
    """
    spark = vectors.sparkSession
    v = F.col(vec)
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col(vec_id).isNotNull()
    good = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    points = common.materialize(good.withColumn("row", F.monotonically_increasing_id()), "lists")
    n = points.count()
    slots = spark.sparkContext.defaultParallelism
    block = block or min(MOST, max(LEAST, -(-n // (2 * slots))))
    asked = points.where(F.pmod("id", F.lit(every)) == 0)
    blocks, batches = max(1, -(-n // block)), max(1, -(-asked.count() // batch))
    picked = points.withColumn("o", F.xxhash64("row")).orderBy("o").limit(SAMPLE).select("row", "v").collect()
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r.v) for r in picked}:
        some = [r for r in picked if len(r.v) == size][: max(64, SAMPLE_BYTES // (8 * max(1, size)))]
        sample[size] = np.array([r.row for r in some]), quantized(pa.array([r.v for r in some], pa.list_(pa.float64())), scale) if size else np.zeros((len(some), 0))
    shared = spark.sparkContext.broadcast(sample)  # SAMPLE_BYTES for each length

    def thresholds(it):
        """The k-th best exact score of the sample, for each query; null where the sample has fewer rows."""
        for b in it:
            out = []
            for row, x in zip(b.column("row").to_pylist(), b.column("v").to_pylist()):
                rows, s = shared.value.get(len(x), (np.zeros(0), np.zeros((0, len(x)))))
                score = sorted(y for r, y in zip(rows.tolist(), exact(s, np.floor(scale * np.array(x, float))) if len(rows) else []) if r != row)
                out.append(score[-k] if len(score) >= k else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if y is None or abs(y) >= 1 << 62 else y for y in out], pa.int64())], names=["id", "v", "row", "least"])

    kind = points.schema["v"].dataType.simpleString()
    queries = asked.select("id", "v", "row").mapInArrow(thresholds, f"id long, v {kind}, row long, least long")
    queries = queries.withColumn("q", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    there = points.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, rows = left.column("id").to_numpy(), left.column("row").to_numpy()
            size = len(left.column("v")[0])
            x = quantized(left.column("v"), scale) if size else np.zeros((len(ids), 0))
            lists = Lists(x) if size else None
            where = {r: i for i, r in enumerate(rows.tolist())}
            qx = quantized(right.column("v"), scale) if size else np.zeros((right.num_rows, 0))
            for i, (qid, qrow, least) in enumerate(zip(*(right.column(c).to_pylist() for c in ("id", "row", "least")))):
                own = where.get(qrow, -1)
                alive = lists.top(qx[i], k, least, own)[0] if lists else np.arange(len(ids))
                alive = alive[alive != own]
                score = exact(x[alive], qx[i])
                best = sorted(zip((-s for s in score), ids[alive].tolist()))[:k]
                if best and max(abs(s) for s, _ in best) >= 1 << 63:
                    raise OverflowError("a score does not fit a long")
                out += [(qrow, qid, vid, -s) for s, vid in best]
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("qrow", "query_id", "vec_id", "score"), cols)})

    def keyed(df):
        return df.withColumn("dim", F.size("v")).groupBy("dim", "b", "q")

    found = keyed(there).cogroup(keyed(queries)).applyInArrow(run, FOUND)
    w = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
