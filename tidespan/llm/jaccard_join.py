"""Exact n-gram Jaccard join in the Jaccard metric space.

1. Exchange: the document frequency of every shingle.  A shingle of one document only can't be shared, so it counts for the size of
   its set but is not kept.
2. Equal sets become one point of the space, which stands for its copies.
3. Regions: ordered by (frequency, hash), a set of n shingles and any set within the distance share one of its first n - ceil(t*n) + 1 shingles.
   These are the virtual pivots that document lies near to: it is replicated to each such region (a document at distance 1 of all
   document pivots has no other Voronoi cell).  Regions with the same members are one.
4. A region of up to ``LEAF`` members and ``LEAF_SHINGLES`` shingles is joined in one task: some members are pivots, every member's exact distance to them is found, and its home
   is the cell of the nearest.  A member goes into another cell too if, by the triangle inequality, a member at home there can be within the
   distance: d(x, q) <= d(x, home) + 2 eps.  Pairs of a cell that aren't yet in one component are compared exactly.
5. A larger region first loses members in rounds over Spark: pivots, exact distances, links.  A linked member x leaves if, by the triangle
   inequality, no member that its pivot does not reach can be near it: d(x, p) + eps < d(y, p) for all those y.  Pivots leave too; what is
   left goes to 4 as soon as it is small enough, and ends when it is one component.  No link between components is lost.
6. Components of the links between points, grown over distributed edges; copies take the component of their point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import blocks, common
from . import text as T

#: Members of a region that is joined in one task, and shingles of all of them (eight bytes each).
LEAF = 4096
LEAF_SHINGLES = 1 << 22
#: Members of the regions that one task joins, about, and shingles.
BIN = 1024
BIN_SHINGLES = 1 << 20
#: Parts of a group of equal sets, so that none is gathered in one task.
SALTS = 1024
_BASE = S.StructType([S.StructField("id", S.LongType()), S.StructField("n", S.IntegerType()), S.StructField("sig", S.LongType()), S.StructField("sig2", S.LongType()), S.StructField("alone", S.IntegerType()), S.StructField("anchors", S.ArrayType(S.LongType())), S.StructField("common", S.ArrayType(S.LongType()))])


def _sets(table: pa.Table, k: int):
    h, at = T.words(table.column("__text"), lower=True)
    doc, key = T.shingles(h, at, k)
    # Sets of one id (repeated rows) are kept apart here; they meet again in the component of their id.
    order, begin = blocks.runs(key)
    return key[order[begin]], np.diff(np.append(begin, len(order))), (doc, key, order, begin, len(at) - 1)


def sets(docs: DataFrame, k: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """id, n (size of the set), sig and sig2 (of the whole set), anchors and common (shingles that more documents hold), per row."""
    n = blocks.number(docs)
    dealt = blocks.dealt(docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")), "__id", n)

    def emit(table):
        key, count, _ = _sets(table, k)
        # 32 bits of the hash tell shingles of one range apart; two that fall together only look more frequent than they are.
        low, count = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(count, 65535).astype(np.uint16)
        return key, lambda a, b: [low[a:b], count[a:b]]

    def merge(_, got):
        sizes = [len(g[0]) for g in got]
        key, count = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)
        order, begin = blocks.runs(key)
        total = np.add.reduceat(count[order], begin)
        level = np.where(total < 2, 0, np.ceil(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        return [[x] for x in blocks.split(blocks.spread(level, order, begin), sizes)]

    def then(table, answer):
        ids = table.column("__id").to_numpy(zero_copy_only=False) if not table.column("__id").null_count else None
        key, _, (doc, flat, order, begin, rows) = _sets(table, k)
        level = blocks.spread(answer[0], order, begin) if len(order) else np.zeros(0, np.uint8)
        edge = np.searchsorted(doc, np.arange(rows + 1)).tolist()
        size, sig, sig2, rare, anchors, shared = [], [], [], [], [], []
        again = T.mix(flat ^ T.ODD[7])
        for a, b in zip(edge, edge[1:]):
            m = b - a
            x, lv = flat[a:b], level[a:b]
            size.append(m)
            sig.append(int(np.add.reduce(x).astype(np.int64)) if m else 0)
            sig2.append(int(np.add.reduce(again[a:b]).astype(np.int64)) if m else 0)
            prefix = m - (percent * m + 99) // 100 + 1
            alone = int((lv == 0).sum())
            rare.append(alone)
            if m and alone < prefix:
                some = np.flatnonzero(lv)
                first = some[np.lexsort((x[some], lv[some]))[: prefix - alone]]
                anchors.append(x[first].astype(np.int64))
                shared.append(x[some].astype(np.int64))
            else:
                anchors.append(np.zeros(0, np.int64))
                shared.append(np.zeros(0, np.int64))
        lists = lambda v: pa.array(v, pa.list_(pa.int64()))
        return pa.table([table.column("__id") if ids is None else pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.int64()), pa.array(sig2, pa.int64()), pa.array(rare, pa.int32()), lists(anchors), lists(shared)], names=_BASE.names)

    from .substring_dedup import _or_empty

    return blocks.finish(dealt, blocks.replies(blocks.requests(dealt, n, emit), n, merge), _or_empty(then, _BASE), _BASE)


def _tops(ranked: DataFrame, few: int) -> DataFrame:
    """(region, pivot): the ``few`` members of each region that come first by the size of their component, and the ``few`` by where their shared shingle stands."""
    by = F.array(F.col("own").cast("double"), F.col("pos") / F.col("n"))
    some = ranked.select("region", F.posexplode(by).alias("kind", "by"), F.xxhash64("id").alias("h"), F.col("id").alias("pivot"))
    # Ranked with a limit per group, so that no task holds more than it sorts.
    for part in (["region", "kind", F.pmod("h", F.lit(256))], ["region", "kind"]):
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("by", "h", "pivot"))).where(F.col("r") <= few).drop("r")
    return some.select("region", "pivot").distinct()


def _join_region(size: np.ndarray, flat: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """The first member of each member's component; ``flat[at[i]:at[i+1]]``: numbers of the shingles of member i, of ``size[i]`` in all."""
    m, eps = len(size), 1 - percent / 100
    root = np.arange(m)  # the first member of each member's component so far
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)

    def distances(i: int, others: np.ndarray | None = None):
        """Distance of i to the others (all: None), and which are linked."""
        mark[flat[at[i] : at[i + 1]]] = True
        if others is None:
            c = np.concatenate([[0], np.cumsum(mark[flat])])
            both, n = c[at[1:]] - c[at[:-1]], size
        else:
            length = at[others + 1] - at[others]
            end = np.cumsum(length)
            c = np.concatenate([[0], np.cumsum(mark[flat[np.repeat(at[others] - (end - length), length) + np.arange(end[-1])]])])
            both, n = c[end] - c[end - length], size[others]
        mark[flat[at[i] : at[i + 1]]] = False
        union = n + size[i] - both
        return 1 - both / union, 100 * both >= percent * union

    def join(i: int, others) -> None:
        if len(others):
            both = np.unique(np.append(root[others], root[i]))
            root[np.isin(root, both)] = both[0]

    pivots = np.unique(np.linspace(0, m - 1, max(1, int(np.ceil(np.sqrt(m))))).astype(int))
    d = np.empty((m, len(pivots)))
    for k, i in enumerate(pivots):
        d[:, k], linked = distances(i)
        join(i, np.flatnonzero(linked))
    home = d.argmin(1)
    least = d[np.arange(m), home]
    for k in range(len(pivots)):
        cell = np.flatnonzero(d[:, k] <= least + 2 * eps + 1e-9)
        for x in cell[home[cell] == k].tolist():
            others = cell[root[cell] != root[x]]
            # What the pivots' distances rule out needs no look.
            others = others[(np.abs(d[others] - d[x]) <= eps + 1e-9).all(1)] if len(others) else others
            if len(others):
                join(x, others[distances(x, others)[1]])
    return root


def _join_bin(table: pa.Table, percent: int) -> pa.Table:
    """(a, b) links that hold the components of each of a bin's regions together."""
    region, ids, size = (table.column(c).to_numpy() for c in ("region", "id", "n"))
    shingles = table.column("common").combine_chunks()
    shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
    length = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(length)])
    value = shingles.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, region))
    edge = np.flatnonzero(np.concatenate([[True], region[order][1:] != region[order][:-1], [True]]))
    a, b = [], []
    for i, j in zip(edge[:-1], edge[1:]):
        rows = order[i:j]
        flat = np.unique(np.concatenate([value[start[r] : start[r + 1]] for r in rows]), return_inverse=True)[1]
        root = _join_region(size[rows].astype(np.int64), flat, np.concatenate([[0], np.cumsum(length[rows])]), percent)
        a.append(ids[rows])
        b.append(ids[rows][root])
    a, b = (np.concatenate(x) for x in (a, b))
    return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})


def copies(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, ids): ids of equal sets, in parts that a hash deals out; and (n, sig, sig2, rep, part): the least id of each set, for each of its parts."""
    full = base.where("n > 0 and id is not null")
    some = full.groupBy("n", "sig", "sig2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("part"), F.collect_set("id").alias("ids"))
    some = common.materialize(some.select("n", "sig", "sig2", "part", "ids"), "copies")
    rep = some.groupBy("n", "sig", "sig2").agg(F.min("part").alias("rep"), F.collect_set("part").alias("parts"))  # SALTS parts at most
    return some, common.materialize(rep, "sets")


def links(base: DataFrame, rep: DataFrame, percent: int, max_rounds: int = 10_000) -> tuple[list[DataFrame], list[DataFrame]]:
    """(a, b) links between points whose components are those of all pairs at least ``percent`` alike, and what can be discarded once those are read.

    ``rep``: the points, as ``copies`` gives them.
    """
    written = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        written.append(common.materialize(df, tag))
        return written[-1]

    full = base.where("n > 0 and id is not null")
    # An id with several sets links them.
    several = full.groupBy("id").agg(F.collect_set(F.struct("n", "sig", "sig2")).alias("s")).where(F.size("s") > 1).select("id", F.explode("s").alias("s")).select("id", "s.*")
    several = several.join(rep, ["n", "sig", "sig2"]).groupBy("id").agg(F.collect_set("rep").alias("r")).select(F.array_min("r").alias("a"), F.explode("r").alias("b"))
    out = [several.where("a <> b")]
    points = full.where(F.size("anchors") > 0).join(rep.select("n", "sig", "sig2", F.col("rep").alias("id")), ["n", "sig", "sig2", "id"], "left_semi").dropDuplicates(["id", "n", "sig", "sig2"])
    points = keep(points.select("id", "n", "alone", "anchors", "common"), "points")
    eps = 1 - percent / 100
    a = points.select("id", "n", F.size("common").alias("w"), F.posexplode("anchors").alias("pos", "region"), "alone")
    # What comes before the first shingle that two sets share is shared by none of them: of a set with ``pos`` shingles before it, at most
    # n - pos are shared, so a partner has at most ``most`` shingles.
    most = F.floor((F.col("n") - F.col("pos") - F.col("alone")) * (100 + percent) / F.lit(percent)) - F.col("n")
    a = a.select("id", "n", "w", "region", (F.col("pos") + F.col("alone")).alias("pos"), most.cast("int").alias("most"))
    # Regions with the same members are one: that of the earliest shingle.
    kept = a.groupBy("region").agg(F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.sum("pos").alias("p"), F.min(F.when(F.col("most") >= F.col("n"), F.col("n"))).alias("low")).where("m > 1 and low is not null")
    kept = kept.groupBy("m", "s", "x").agg(F.min(F.struct("p", "region", "low")).alias("r")).select("r.region", "r.low")
    # Of two members, one at least has most >= n; the others need one of those that is small enough.
    a = a.join(kept, "region").where("most >= n or most >= low").select("region", "id", "n", "w", "pos", "most", F.col("id").alias("comp"))
    whole = [F.count("*").alias("m"), F.sum("w").alias("shingles")]
    members, small = keep(a, "members"), None
    members = keep(members.join(members.groupBy("region").agg(*whole), "region"), "regions")
    fits = (F.col("m") <= LEAF) & (F.col("shingles") <= LEAF_SHINGLES)
    for r in range(max_rounds):
        leaf = members.where(fits).select("region", "id", "w")
        small = leaf if small is None else small.union(leaf)
        members = members.where(~fits)
        if members.isEmpty():
            break
        ranked = members.join(members.groupBy("region", "comp").agg(F.count("*").alias("own")), ["region", "comp"])
        # Pivots: the smallest id at first; then members of the smallest components of each region, and those whose shared shingle stands first.
        if r == 0:
            chosen = members.groupBy("region").agg(F.min_by("id", F.struct((F.col("pos") / F.col("n")).alias("at"), "id")).alias("pivot"))
        else:
            chosen = _tops(ranked, min(2048, 16 << (2 * r)))
        pivots = ranked.select("region", F.col("id").alias("pivot"), F.col("comp").alias("pcomp"), F.col("n").alias("pn"), F.col("most").alias("pmost"), "own")
        chosen = keep(chosen.join(pivots, ["region", "pivot"]), "pivots")
        # Pairs of one component need no distance: they can't add a link that joins anything.
        near = members.join(chosen, "region").where("comp <> pcomp and n <= pmost and pn <= most")
        near = keep(near.select("region", "id", "comp", "pivot", "pcomp", (F.col("m") - F.col("own")).alias("others")), "near")
        pairs = near.select("id", "pivot").distinct()
        left = points.select("id", F.col("n").alias("n1"), F.col("common").alias("c1"))
        right = points.select(F.col("id").alias("pivot"), F.col("n").alias("n2"), F.col("common").alias("c2"))
        measured = pairs.join(left, "id").join(right, "pivot").select("id", "pivot", "n1", "n2", F.size(F.array_intersect("c1", "c2")).alias("i"))
        union = F.col("n1") + F.col("n2") - F.col("i")
        measured = measured.groupBy("id", "pivot").agg(F.max(F.col("i") * 100 >= union * percent).alias("linked"), F.min(1 - F.col("i") / union).alias("d"))
        seen = keep(near.join(measured, ["id", "pivot"]), "seen")
        hits = seen.where("linked")
        out.append(hits.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        # A linked member leaves if all members of other components have been measured and its pivot's window holds none that is not linked.
        far = seen.groupBy("region", "pivot", "pcomp").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("far"), F.count("*").alias("met"), F.min("others").alias("others")).where("met = others").select("region", "pivot", "far")
        done = hits.join(far, ["region", "pivot"]).where(F.col("far").isNull() | (F.col("d") + eps + 1e-9 < F.col("far"))).select("region", "id")
        done = done.union(chosen.select("region", F.col("pivot").alias("id")))
        rest = members.drop("m", "shingles").join(done.distinct(), ["region", "id"], "left_anti")
        renamed = common.connected_components(hits.select(F.col("comp").alias("a"), F.col("pcomp").alias("b")).distinct())
        rest = rest.join(renamed, rest["comp"] == renamed["node"], "left").select("region", "id", "n", "w", "pos", "most", F.coalesce("component", "comp").alias("comp"))
        alive = rest.groupBy("region").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), *whole).where("c0 <> c1").select("region", "m", "shingles")
        members = keep(rest.join(alive, "region"), "regions")
        common.release(base.sparkSession)
    else:
        raise RuntimeError("regions did not settle")
    rows, weight = small.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    bins = max(1, -(-rows // BIN), -(-weight // BIN_SHINGLES))
    held = small.join(points.select("id", "n", "common"), "id").select("region", "id", "n", "common", F.pmod(F.xxhash64("region"), F.lit(bins)).alias("bin"))
    out.append(keep(held.groupBy("bin").applyInArrow(lambda table: _join_bin(table, percent), "a long, b long"), "links"))
    return out, written


def components(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, n_shingles, component_id (smallest id reachable by links, itself included).

    Two documents link when 100 * |A and B| >= percent * |A or B| over their distinct k-word shingles (A-Z lower-cased; a shorter
    document is one shingle of all its words).  A null or empty text has no shingles and links with nothing.  Rows that repeat an id share its
    component; a null id gets a null component.
    """
    base = common.materialize(sets(docs, k, percent, text, doc_id), "sets")
    common.release(docs.sparkSession)
    parts, rep = copies(base)
    edges = None
    found, written = links(base, rep, percent)
    for e in found:
        edges = e if edges is None else edges.union(e)
    grown = common.connected_components(edges)
    for x in written:
        common.discard(x)
    # Parts are joined rather than ids, so that no task holds all copies of a text.
    named = rep.select("rep", F.explode("parts").alias("part")).join(grown, F.col("rep") == F.col("node"), "left").select("part", F.coalesce("component", "rep").alias("component"))
    named = parts.join(named.groupBy("part").agg(F.min("component").alias("component")), "part")
    found = named.select(F.explode("ids").alias("node"), "component").groupBy("node").agg(F.min("component").alias("component"))
    return base.select("id", "n").join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
