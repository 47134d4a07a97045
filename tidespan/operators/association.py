"""Association of seeds with tracks, and locking on a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vision
from .intervals import _keys


def within(a: DataFrame, b: DataFrame, key: str | list[str], ta: str, tb: str, tolerance) -> DataFrame:
    """Pairs of equal key with abs(ta - tb) <= tolerance, as an equi-join on time buckets.

    ``a`` is put in its bucket and both neighbours, ``b`` in its own; a pair meets once.  Column names of the two sides must differ (but
    for the key).
    """
    keys = _keys(key)
    bucket = F.floor(F.col(ta) / tolerance)
    left = a.withColumn("__bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = b.withColumn("__bucket", F.floor(F.col(tb) / tolerance))
    return left.join(right, [*keys, "__bucket"]).where(F.abs(F.col(ta) - F.col(tb)) <= tolerance).drop("__bucket")


def votes(pairs: DataFrame, key: str | list[str], seed: str, track: str, seed_order: str) -> DataFrame:
    """Votes of each track: distinct seeds; with the earliest seed that voted for it."""
    return pairs.groupBy(*_keys(key), track).agg(F.countDistinct(seed).alias("votes"), F.min(seed_order).alias("first_seed"))


def elect(voted: DataFrame, key: str | list[str], track: str) -> DataFrame:
    """The track with most votes; ties go to the one voted for earliest, then to the smaller."""
    w = Window.partitionBy(*_keys(key)).orderBy(F.desc("votes"), "first_seed", track)
    return voted.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def lock_on(df: DataFrame, key: str | list[str], frame: str, box: str, base: str, qualifies: str, accepted_at, similarity, gain: float = 0.6, tie_desc: bool = False) -> DataFrame:
    """Rescore candidates once a reference is locked, and keep the best accepted one of each frame.

    The reference is the first candidate (by frame, box) that ``qualifies``, or, if that is earlier, the best accepted candidate of a frame before.  Candidates from then on
    (the qualifying one itself included) gain ``gain`` * similarity(candidate, reference).  ``similarity`` takes two columns of the candidate id
    ``box``-level vector named ``vector`` and ``reference``.  ``accepted_at``: the least accepted score (a number or column).
    """
    keys = _keys(key)
    at = F.struct(F.col(frame).alias("frame"), F.col(box).alias("box"))
    best = Window.partitionBy(*keys, frame).orderBy(F.desc(base), box)
    first = df.withColumn("__r", F.row_number().over(best))
    # A frame's accepted best locks after all its boxes, so it compares as (frame, infinity).
    late = F.struct(F.col(frame).alias("frame"), F.lit(2**31 - 1).cast("long").alias("box"))
    early = F.struct(F.col(frame).alias("frame"), F.col(box).cast("long").alias("box"))
    triggers = first.where(F.col(qualifies)).select(*keys, early.alias("at"), F.col("vector").alias("reference")).union(first.where((F.col("__r") == 1) & (F.col(base) >= accepted_at)).select(*keys, late.alias("at"), F.col("vector").alias("reference")))
    lock = triggers.groupBy(*keys).agg(F.min("at").alias("lock"), F.min_by("reference", "at").alias("reference"))
    x = df.join(lock, keys, "left").withColumn("__at", early)
    score = F.col(base) + F.when(F.col("__at") >= F.col("lock"), gain * similarity(F.col("reference"), F.col("vector"))).otherwise(0.0)
    x = x.withColumn("score", score)
    w = Window.partitionBy(*keys, frame).orderBy(F.desc("score"), box)
    return x.withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) & (F.col("score") >= accepted_at)).drop("__r", "__at", "lock", "reference")


#: Fixed value of the grid: how much wider the cells of a level are than those of the one below.
STEP = 4


def _cells(df: DataFrame, box: str, cell: float, up: int) -> DataFrame:
    """One row for each cell that a box touches, on its own level (cells at least as large as its longer side: four at most) and ``up`` more; boxes without area go."""
    x1, y1, x2, y2 = (F.col(f"{box}.{c}") for c in ("x1", "y1", "x2", "y2"))
    side = F.greatest(x2 - x1, y2 - y1)
    level = sum(((side > cell * float(STEP) ** n).cast("int") for n in range(25)), F.lit(0))
    d = df.where((x2 > x1) & (y2 > y1) & (side <= cell * float(STEP) ** 25)).withColumn("__own", level)
    at = lambda x, n: F.floor(x / (cell * F.pow(F.lit(float(STEP)), n)))
    cells = F.flatten(F.transform(F.sequence("__own", F.col("__own") + up), lambda n: F.flatten(F.transform(F.sequence(at(x1, n), at(x2, n)), lambda i: F.transform(F.sequence(at(y1, n), at(y2, n)), lambda j: F.struct(n.alias("n"), i.alias("i"), j.alias("j")))))))
    return d.withColumn("__cell", F.explode(cells))


def overlapping(a: DataFrame, b: DataFrame, key: str | list[str], ta: str, tb: str, tolerance, least: float, box_a: str = "a", box_b: str = "b", cell: float = 64.0) -> DataFrame:
    """Pairs of equal key with abs(ta - tb) <= tolerance whose boxes (structs x1, y1, x2, y2) have an intersection over union of at least ``least`` (above 0).

    An equi-join on time buckets and the cells of a grid, so that only boxes that touch one cell at about one time meet.  The overlap bounds how much
    the longer sides differ, so a box is put on its own level and the few above that a partner can have: four cells of each, however large it is.  A pair counts once, on the higher of its own levels and in the cell
    that holds the upper left corner of the intersection.  Column names of the two sides must differ (but for the key).
    """
    if not 0 < least <= 1:
        raise ValueError("the least overlap must be above 0")
    keys, up = _keys(key), 0
    while STEP**up * least < 1:
        up += 1
    bucket = F.floor(F.col(ta) / tolerance)
    left = _cells(a, box_a, cell, up).withColumnsRenamed({"__own": "__a"}).withColumn("__bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = _cells(b, box_b, cell, up).withColumnsRenamed({"__own": "__b"}).withColumn("__bucket", F.floor(F.col(tb) / tolerance))
    x = left.join(right, [*keys, "__bucket", "__cell"]).where((F.abs(F.col(ta) - F.col(tb)) <= tolerance) & (F.col("__cell.n") == F.greatest("__a", "__b")))
    size = cell * F.pow(F.lit(float(STEP)), F.col("__cell.n"))
    corner = lambda c: F.floor(F.greatest(F.col(f"{box_a}.{c}"), F.col(f"{box_b}.{c}")) / size)
    x = x.where((F.col("__cell.i") == corner("x1")) & (F.col("__cell.j") == corner("y1")))
    part = lambda c: {n: F.col(f"{c}.{n}") for n in ("x1", "y1", "x2", "y2")}
    return x.where(vision.iou(part(box_a), part(box_b)) >= least).drop("__bucket", "__cell", "__a", "__b")
