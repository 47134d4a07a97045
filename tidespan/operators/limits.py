"""A fixed-window rate limiter whose keys may be of any size.

A window opens at the first event after the last one ended, so where it opens depends on all windows before.  Each event points to the one that would open
the next window if it opened one; the windows of a key are the path from its first event.  That path is found by pointer doubling: with the events 2 ** r windows on known, those
found so far are joined to them, and the pointers to themselves, until nothing is new; the rounds grow with the logarithm of the most windows of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from . import segmented
from .intervals import _keys


def _pointers(times: DataFrame, keys: list[str], hot: DataFrame | None, window) -> DataFrame:
    """(key, t, next): the first time of the key that is later than t + ``window``; null if there is none."""
    both = times.select(*keys, F.col("__t").alias("__at"), F.lit(None).cast(times.schema["__t"].dataType).alias("__from"))
    both = both.unionAll(times.select(*keys, (F.col("__t") + window).alias("__at"), F.col("__t").alias("__from")))
    x = segmented.placed(both, keys, "__at", hot)
    event = F.when(F.col("__from").isNull(), F.col("__at"))
    first = lambda w: {"__first": F.lead("__f").over(w)}  # noqa: E731  every range holds an event
    x = segmented.carried(x, keys, {"__f": F.min(event)}, first) if hot is not None else x.withColumn("__first", F.lit(None).cast(x.schema["__at"].dataType))
    # From the latest on; at one time those who ask come before the event, which is not later for them.
    w = Window.partitionBy(*keys, "__range").orderBy(F.desc("__at"), F.desc_nulls_last("__from")).rowsBetween(Window.unboundedPreceding, 0)
    later = F.coalesce(F.last(event, ignorenulls=True).over(w), "__first")
    return x.withColumn("__next", later).where(F.col("__from").isNotNull()).select(*keys, F.col("__from").alias("__t"), "__next")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Inner join on the key (null equals null) and left.a = right.b; the right side's columns are (key, t, next) as (_, __rt, __rnext)."""
    r = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(F.col(c).alias(c.replace("__", "__r")) for c in right.columns if c not in keys))
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys), F.col(a) == F.col(b.replace("__", "__r")))
    return left.join(r, on).drop(*(f"__r_{k}" for k in keys))


def opening_times(df: DataFrame, key: str | list[str], t: str, window, rows: int = segmented.ROWS) -> DataFrame:
    """(key, __t): the times at which a window opens, the first time of each key and all that follow from it.  Written, to be discarded by the caller."""
    keys = _keys(key)
    times = scratch.written(df.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("__t")).distinct(), "times")
    hot = segmented.ranges(times, keys, "__t", rows)
    jump = scratch.written(_pointers(times, keys, hot, window).where("__next is not null"), "pointers")
    found = scratch.written(times.groupBy(*keys).agg(F.min("__t").alias("__t")), "openings")
    while True:
        new = scratch.written(_meet(found, jump, keys, "__t", "__t").select(*keys, F.col("__rnext").alias("__t")), "openings")
        if new.isEmpty():
            scratch.discard(new, jump, times, *([] if hot is None else [hot]))
            return found
        more = scratch.written(found.unionAll(new), "openings")
        twice = scratch.written(_meet(jump, jump, keys, "__next", "__t").select(*keys, "__t", F.col("__rnext").alias("__next")), "pointers")
        scratch.discard(found, new, jump)
        found, jump = more, twice


def rate_limited(df: DataFrame, key: str | list[str], t: str, tie: str, limit: int, window, rows: int = segmented.ROWS) -> DataFrame:
    """The columns of ``df`` and ``allowed``: whether an event is among the first ``limit`` (by ``t``, then ``tie``) of its window.

    Windows close ``window`` after the event that opens them, which includes that very time.  Rows of equal key, time and tie count one by one, in no particular order; rows without a
    time are in no window and get null.
    """
    keys, given = _keys(key), df.columns
    x = scratch.written(df.withColumn("__id", F.monotonically_increasing_id()), "events")
    opened = opening_times(x, keys, t, window, rows)
    hot = segmented.ranges(x, keys, t, rows)
    timed = x.where(F.col(t).isNotNull())
    both = timed.withColumn("__t", F.col(t)).withColumn("__open", F.lit(None).cast(opened.schema["__t"].dataType))
    both = both.unionByName(opened.withColumn("__open", F.col("__t")), allowMissingColumns=True)
    p = segmented.placed(both, keys, "__t", hot)
    last = lambda w: {"__last": F.max("__o").over(segmented._before(w))}
    p = segmented.carried(p, keys, {"__o": F.max("__open")}, last) if hot is not None else p.withColumn("__last", F.lit(None).cast(p.schema["__t"].dataType))
    w = Window.partitionBy(*keys, "__range").orderBy("__t", F.desc_nulls_last("__open")).rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("__start", F.coalesce(F.max("__open").over(w), "__last")).where("__id is not null").select(*given, "__id", "__start")
    # The last event that a window lets through is found with a limit per group before the shuffle, then compared with all.
    spot = F.struct(F.col(t), F.col(tie), F.col("__id"))
    first = p.select(*keys, "__start", spot.alias("__spot")).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__start").orderBy("__spot"))).where(F.col("__r") <= limit)
    last = first.groupBy(*keys, "__start").agg(F.max("__spot").alias("__bound")).withColumnsRenamed({k: f"__r_{k}" for k in keys} | {"__start": "__s"})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys), F.col("__start") == F.col("__s"))
    done = p.join(last, on, "left").select(*given, F.coalesce(spot <= F.col("__bound"), F.lit(False)).alias("allowed"))
    return done.unionAll(x.where(F.col(t).isNull()).select(*given, F.lit(None).cast("boolean").alias("allowed")))
