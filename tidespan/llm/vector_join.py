"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at cosine >= c are at squared distance <= 2 - 2c.  After a fixed rotation the dimensions are split into blocks; some block
of a linked pair holds no more than its proportional share of that distance.  Each block is range-joined on its own: its first axis is
cut into slabs at quantiles, a vector is also sent to each slab within the block's radius, and within a slab the vectors are halved along all axes of the block,
each half meeting only those whose distance to it, added up over the axes, is within the radius.  Candidates are verified in full double precision where they meet, and each link is counted in the first block that finds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import text as T

#: Vectors of a slab, about, and of a part of one; a slab with more (of vectors that are alike, say) is compared part by part.
SLAB = 65536
PART = 131072
#: Vectors of which the quantiles are taken.
SAMPLE = 4096
#: Vectors that are multiplied with all that lie near them, rather than halved again.
LEAF = 64
_SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that neither huge nor tiny components leave the range of doubles
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _slabs(x: np.ndarray, bounds: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home slab of each value, and the first and last slab within the radius of it."""
    return tuple(np.searchsorted(bounds, z, "right") for z in (x, x - radius, x + radius))


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def links(vectors: DataFrame, cosine: float = 0.95, blocks: int = 8, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, n_links (other rows at cosine >= ``cosine``), component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do vectors of different
    lengths; a row without an id has none and a null component.  Equal vectors are one point that counts as often as it occurs.  Rows with one id are different vectors of one component.  ``cosine`` must be
    above 0.  The work grows with the pairs that share a part of a slab; for data without any structure that is a fixed share of all pairs, as for every exact method.
    """
    spark = vectors.sparkSession
    v = F.col(vec)
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "float" if vectors.schema[vec].dataType.simpleString() == "array<float>" else "double"
    same = F.transform(v, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 becomes 0.0
    good = vectors.select(F.col(vec_id).cast("long").alias("id"), same.alias("v")).where(F.coalesce(ok, F.lit(False)) & F.col(vec_id).isNotNull())
    # Points are told apart by number, as an id may have several.
    points = good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m")).withColumn("pt", F.monotonically_increasing_id())
    points = common.materialize(points, "points")
    dims = [(r.dim, r.n) for r in points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()]
    found = None
    for dim, n in dims:
        part = _join(points.where(F.size("v") == dim), dim, n, cosine, min(blocks, dim))
        found = part if found is None else found.union(part)
    out = vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(F.coalesce(ok, F.lit(False)) & F.col(vec_id).isNotNull(), same).alias("v"))
    if found is None:
        return out.select(F.col("id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = common.materialize(found, "found")
    counts = found.groupBy("pt").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("pt").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
    group = common.connected_components(edges)
    whole = points.join(counts, "pt", "left").join(group, points["pt"] == group["node"], "left").select("v", "id", "m", "pt", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "pt").alias("g"))
    names = whole.groupBy("g").agg(F.min("id").alias("component_id"))
    whole = whole.join(names, "g").select(F.col("v").alias("pv"), "m", "links", "component_id")
    joined = out.join(whole, out["v"] == whole["pv"], "left")
    comp = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(vec_id), F.coalesce(F.col("links") + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (comp == F.col("id")).alias("kept"))


def _join(points: DataFrame, dim: int, n: int, cosine: float, m: int) -> DataFrame:
    """(pt, links, root) rows: links counted with multiplicity, and a smaller point of the same component."""
    turn = rotation(dim)
    edge = [dim * i // m for i in range(m + 1)]
    budget = 2 - 2 * cosine
    share = [budget * (b - a) / dim + _SLACK for a, b in zip(edge, edge[1:])]
    k = -(-n // SLAB)
    chosen = np.array([r.v for r in points.orderBy(F.xxhash64("pt"), "pt").limit(SAMPLE).collect()], float)
    bounds = np.quantile((_unit(chosen) @ turn)[:, edge[:-1]], np.arange(1, k) / k, axis=0).T if k > 1 else np.zeros((m, 0))

    def cells(batches, sizes=None):
        """Without ``sizes``: (cell, rows) counts; with: the rows for each cell and pair of parts."""
        for batch in batches:
            pt = batch.column(0).to_numpy()
            if not len(pt):
                continue
            x = _matrix(batch.column(2))
            y = _unit(x) @ turn
            at = []
            for b in range(m):
                home, low, high = _slabs(y[:, edge[b]], bounds[b], share[b] ** 0.5 + 1e-6)
                row = np.repeat(np.arange(len(y)), high - low + 1)
                slab = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
                at.append((row, b * k + slab, home[row] == slab))
            row, cell, home = (np.concatenate(z) for z in zip(*at))
            if sizes is None:
                c, count = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(count.astype(np.int64))], names=["cell", "n"])
                continue
            parts = np.array([sizes[c] for c in cell])
            own = (T.mix(pt[row].astype(np.uint64)) >> np.uint64(7)) % parts.astype(np.uint64)
            # A task compares home part i with part j: a row goes to (own, j) if at home, to (i, own), and once to (own, own).
            r1 = np.repeat(np.flatnonzero(home), parts[home])
            j = np.concatenate([np.arange(p) for p in parts[home]]) if home.any() else np.zeros(0, int)
            r2 = np.repeat(np.arange(len(row)), parts)
            i = np.concatenate([np.arange(p) for p in parts])
            own = own.astype(np.int64)
            r1, j = r1[j != own[r1]], j[j != own[r1]]
            key = np.concatenate([np.stack([cell[r1], own[r1], j], 1), np.stack([cell[r2], i, own[r2]], 1)])
            kind = np.concatenate([np.full(len(r1), 1), np.where(home[r2] & (i == own[r2]), 2, 0)]).astype(np.int8)
            take = np.concatenate([row[r1], row[r2]])
            for s in range(0, len(take), 20_000):
                z = slice(s, s + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[z, 0] * 1_000_003 * 1_000_003 + key[z, 1] * 1_000_003 + key[z, 2]), pa.array((key[z, 0] // k).astype(np.int32)), pa.array(kind[z]), pa.array(pt[take[z]]), batch.column(1).take(pa.array(take[z])), batch.column(2).take(pa.array(take[z]))], names=["task", "b", "kind", "pt", "m", "v"])

    p = points.select("pt", "m", "v")
    counted = {r.cell: r.n for r in p.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # blocks * pivots rows at most
    sizes = {c: -(-x // PART) for c, x in counted.items()}

    def compare(table: pa.Table) -> pa.Table:
        pt, kind = table.column("pt").to_numpy(), table.column("kind").to_numpy()
        order = np.argsort(pt, kind="stable")
        b = table.column("b")[0].as_py()
        pt, kind, mult, x = pt[order], kind[order], table.column("m").to_numpy()[order], _matrix(table.column("v"))[order]
        home = kind > 0
        h, o = np.flatnonzero(home), np.flatnonzero(kind != 1)
        unit = _unit(x)
        y = unit @ turn
        yb = y[:, edge[b] : edge[b + 1]]
        # One single-precision product gives all squared distances of a strip; what it lets through (with a margin) is verified in double.
        sq, one = (yb * yb).sum(1)[:, None], np.ones((len(yb), 1))
        left = np.concatenate([-2 * yb, sq, one], 1).astype(np.float32)
        bound = np.float32(share[b] + 1e-5)
        links = np.zeros(len(pt), np.int64)
        ea, eb = [], []
        right = np.ascontiguousarray(np.concatenate([yb, one, sq], 1).astype(np.float32))
        flat = yb.astype(np.float32)
        waiting = []

        def verify() -> None:
            i, j = (np.concatenate(z) for z in zip(*waiting)) if waiting else (h[:0], o[:0])
            waiting.clear()
            for q in range(0, len(i), 200_000):
                at, to = i[q : q + 200_000], j[q : q + 200_000]
                gap = y[at] - y[to]
                gap *= gap
                first = pt[at] != pt[to]
                for e in range(b):
                    first &= gap[:, edge[e] : edge[e + 1]].sum(1) > share[e]
                first &= gap[:, edge[b] : edge[b + 1]].sum(1) <= share[b]
                first[first] &= (unit[at[first]] * unit[to[first]]).sum(1) >= cosine
                np.add.at(links, at[first], mult[to[first]])
                ea.append(at[first])
                eb.append(to[first])

        def meet(o: np.ndarray, h: np.ndarray, off: np.ndarray) -> None:
            """Pairs of h and o; ``off``: squared distance of each of h, along each axis, to the box that holds o."""
            if len(o) <= LEAF:
                step = max(1, 1_000_000 // max(1, len(o)))
                for s in range(0, len(h), step):
                    r, c = np.nonzero(left[h[s : s + step]] @ right[o].T <= bound)
                    if len(r):
                        waiting.append((h[s + r], o[c]))
                if sum(len(w[0]) for w in waiting) > 200_000:
                    verify()
                return
            axis = int(np.ptp(flat[o], axis=0).argmax())
            o = o[np.argpartition(flat[o, axis], len(o) // 2)]
            for half in (o[: len(o) // 2], o[len(o) // 2 :]):
                side, own = flat[half, axis], flat[h, axis]
                gap = np.maximum(np.maximum(side.min() - own, own - side.max()), 0) ** 2
                near = np.flatnonzero(off.sum(1) - off[:, axis] + gap <= bound)
                if len(near):
                    far = off[near]
                    far[:, axis] = gap[near]
                    meet(half, h[near], far)

        if len(h) and len(o):
            meet(o, h, np.zeros((len(h), yb.shape[1]), np.float32))
        verify()
        a, c = (np.concatenate(z) if z else np.zeros(0, int) for z in (ea, eb))
        root = _local_roots(len(pt), a, c)
        keep = h[(links[h] > 0)]
        also = np.setdiff1d(np.unique(c), keep)
        rows = np.concatenate([keep, also]).astype(int)
        return pa.table({"pt": pa.array(pt[rows]), "links": pa.array(np.where(home[rows], links[rows], 0)), "root": pa.array(pt[root[rows]])})

    return p.mapInArrow(lambda it: cells(it, sizes), f"task long, b int, kind byte, pt long, m long, v {points.schema['v'].dataType.simpleString()}").groupBy("task").applyInArrow(compare, "pt long, links long, root long")
