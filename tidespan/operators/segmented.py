"""Sessions, islands, caps, row numbers and runs for keys of any size.

A window over a key puts all of its rows into one task.  Here a key of more than twice ``rows`` rows is cut into ranges of the ordering column of about ``rows`` rows each; a
window runs over (key, range), and what it has to know of the ranges before (the last time, the furthest end, a sum, a count) comes from one small row per range: those are scanned
in order and joined back.  Results are those of the plain windows.

Cuts come from a histogram of up to 65,536 equal cells of a key's own span, so rows of one value stay together, and a range is only as
even as its fullest cell.  The tables that are broadcast hold the cells, at most 16 * (all rows) / ``rows`` numbers, and one row per range.  The cells are counted when an
operator is called and written to the shared folder; where no key is that large, the plain windows are used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from . import intervals
from .intervals import _keys

ROWS = 1_000_000
CELLS = 65_536


def _joined(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Left join on equal names, nulls being equal too, with ``right`` broadcast."""
    other = right.withColumnsRenamed({n: f"__r_{n}" for n in names})
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names))
    return left.join(F.broadcast(other), on, "left").drop(*(f"__r_{n}" for n in names))


def _cell(t: Column, low: Column, high: Column, cells: Column) -> Column:
    """The cell of a value, from 0; never falling as the value rises, whatever is rounded."""
    share = (t.cast("double") - low.cast("double")) / F.when(high > low, high.cast("double") - low.cast("double")).otherwise(1.0)
    return F.least(cells - 1, F.greatest(F.lit(0), F.floor(share * cells).cast("int")))


def ranges(df: DataFrame, key: str | list[str], t: str, rows: int = ROWS) -> DataFrame | None:
    """One row for each key of more than 2 * ``rows`` rows: key, __low, __high, __cells and __of, the range of each cell.  None if there is no such key."""
    keys = _keys(key)
    d = df.where(F.col(t).isNotNull())
    hot = d.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(t).alias("__low"), F.max(t).alias("__high")).where(F.col("__n") > 2 * rows)
    hot = hot.withColumn("__cells", F.least(F.lit(CELLS), F.ceil(F.lit(16.0) * F.col("__n") / rows)).cast("int"))
    hot = scratch.written(hot, "keys")
    if hot.isEmpty():
        scratch.discard(hot)
        return None
    there = _joined(d.select(*keys, t), hot, keys).where(F.col("__cells").isNotNull())
    count = there.groupBy(*keys, _cell(F.col(t), F.col("__low"), F.col("__high"), F.col("__cells")).alias("__cell")).agg(F.count("*").alias("__c"))
    every = hot.select(*keys, "__low", "__high", "__cells", F.explode(F.sequence(F.lit(0), F.col("__cells") - 1)).alias("__cell"))
    before = F.sum(F.coalesce("__c", F.lit(0))).over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    of = _joined(every, count, [*keys, "__cell"]).withColumn("__of", F.floor(F.coalesce(before, F.lit(0)) / rows).cast("int"))
    cells = F.array_sort(F.collect_list(F.struct("__cell", "__of")))
    out = scratch.written(of.groupBy(*keys, "__low", "__high", "__cells").agg(cells["__of"].alias("__of")), "ranges")
    scratch.discard(hot)
    return out


def placed(df: DataFrame, key: str | list[str], t: str, hot: DataFrame | None) -> DataFrame:
    """Adds ``__range``: the range of each row, null for keys that aren't cut."""
    if hot is None:
        return df.withColumn("__range", F.lit(None).cast("int"))
    x = _joined(df, hot, _keys(key))
    return x.withColumn("__range", F.get("__of", _cell(F.col(t), F.col("__low"), F.col("__high"), F.col("__cells")))).drop("__low", "__high", "__cells", "__of")


def carried(df: DataFrame, key: str | list[str], states: dict[str, Column], scan: Callable[[Window], dict[str, Column]]) -> DataFrame:
    """Joins to each row what ``scan`` makes of the ``states`` (aggregates) of the ranges of its key, over a window in order of the ranges; null for keys that aren't cut."""
    keys = _keys(key)
    s = df.where(F.col("__range").isNotNull()).groupBy(*keys, "__range").agg(*(c.alias(n) for n, c in states.items()))
    found = scan(Window.partitionBy(*keys).orderBy("__range"))
    return _joined(df, s.select(*keys, "__range", *(c.alias(n) for n, c in found.items())), [*keys, "__range"])


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _counted(x: DataFrame, keys: list[str], flag: str, over: Window, out: str) -> DataFrame:
    """Running sum of ``flag`` over a key, from those within ranges and the sums of whole ranges."""
    x = carried(x, keys, {"__s": F.sum(flag)}, lambda w: {"__sum": F.sum("__s").over(_before(w))})
    return x.withColumn(out, F.sum(flag).over(over.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__sum", F.lit(0))).drop("__sum")


def session_ids(df: DataFrame, key: str | list[str], t: str, gap, tie: list[str] | None = None, out: str = "session", rows: int = ROWS) -> DataFrame:
    """As ``intervals.session_ids``."""
    keys = _keys(key)
    if (hot := ranges(df, keys, t, rows)) is None:
        return intervals.session_ids(df, keys, t, gap, tie, out)
    x = placed(df.where(F.col(t).isNotNull()), keys, t, hot)
    x = carried(x, keys, {"__l": F.max(t)}, lambda w: {"__last": F.lag("__l").over(w)})
    w = Window.partitionBy(*keys, "__range").orderBy(t, *(tie or []))
    x = x.withColumn("__new", F.when(F.col(t) - F.coalesce(F.lag(t).over(w), "__last") > gap, 1).otherwise(0))
    return _counted(x, keys, "__new", w, out).drop("__new", "__last", "__range")


def sessionize(df: DataFrame, key: str | list[str], t: str, gap, pre=0, post=0, tie: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """As ``intervals.sessionize``."""
    keys = _keys(key)
    g = session_ids(df, keys, t, gap, tie, rows=rows).groupBy(*keys, "session")
    return g.agg(F.greatest(F.lit(0), F.min(t) - pre).alias("start"), (F.max(t) + post).alias("end"), F.count("*").alias("n")).drop("session")


def merge_islands(df: DataFrame, key: str | list[str], tolerance=0, start: str = "start", end: str = "end", tie: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """As ``intervals.merge_islands``."""
    keys, whole = _keys(key), df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    if (hot := ranges(whole, keys, start, rows)) is None:
        return intervals.merge_islands(df, keys, tolerance, start, end, tie)
    x = carried(placed(whole, keys, start, hot), keys, {"__e": F.max(end)}, lambda w: {"__far": F.max("__e").over(_before(w))})
    w = Window.partitionBy(*keys, "__range").orderBy(start, *(tie or [end]))
    reach = F.greatest(F.max(end).over(_before(w)), F.col("__far"))
    x = x.withColumn("__new", F.when(F.col(start) <= reach + tolerance, 0).otherwise(1))
    g = _counted(x, keys, "__new", w, "__island").groupBy(*keys, "__island")
    return g.agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")


def cap_total(df: DataFrame, key: str | list[str], most, start: str = "start", end: str = "end", tie: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """As ``intervals.cap_total``."""
    keys, length, some = _keys(key), F.col(end) - F.col(start), df.where(F.col(end) > F.col(start))
    if (hot := ranges(some, keys, start, rows)) is None:
        return intervals.cap_total(df, keys, most, start, end, tie)
    x = carried(placed(some, keys, start, hot), keys, {"__s": F.sum(length)}, lambda w: {"__sum": F.sum("__s").over(_before(w))})
    x = x.where(F.coalesce("__sum", F.lit(0)) < most)  # whole ranges beyond it go before they are sorted
    w = Window.partitionBy(*keys, "__range").orderBy(start, *(tie or [end]))
    x = x.withColumn("__used", F.coalesce(F.sum(length).over(_before(w)), F.lit(0)) + F.coalesce("__sum", F.lit(0))).where(F.col("__used") < most)
    return x.withColumn(end, F.least(F.col(end), F.col(start) + (F.lit(most) - F.col("__used")))).drop("__used", "__sum", "__range")


def numbered(df: DataFrame, key: str | list[str], t: str, tie: list[str] | None = None, out: str = "number", rows: int = ROWS) -> DataFrame:
    """Numbers the rows of each key from 0, in order of ``t`` and ``tie``; rows without ``t`` are left out."""
    keys, timed = _keys(key), df.where(F.col(t).isNotNull())
    hot = ranges(timed, keys, t, rows)
    x = placed(timed, keys, t, hot)
    x = carried(x, keys, {"__n": F.count("*")}, lambda w: {"__sum": F.sum("__n").over(_before(w))}) if hot is not None else x.withColumn("__sum", F.lit(0))
    w = Window.partitionBy(*keys, "__range").orderBy(t, *(tie or []))
    return x.withColumn(out, (F.row_number().over(w) - 1 + F.coalesce("__sum", F.lit(0))).cast("long")).drop("__sum", "__range")


def hysteresis_runs(df: DataFrame, key: str | list[str], index: str, moving: str, still: int, rows: int = ROWS) -> DataFrame:
    """As ``motion.hysteresis_runs``."""
    keys = _keys(key)
    last = df.groupBy(*keys).agg(F.max(index).alias("__end"))
    runs = sessionize(df.where(F.col(moving)), keys, index, still, rows=rows).withColumnsRenamed({"start": "first", "end": "last"})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys))
    closed = F.when(F.col("last") + still <= F.col("__end"), F.col("last") + still)
    return runs.join(last.withColumnsRenamed({k: f"__r_{k}" for k in keys}), on).select(*keys, "first", "last", closed.alias("closed"))
