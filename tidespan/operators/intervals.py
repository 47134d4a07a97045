"""Operators on detections (key, t) and intervals (key, start, end).

Each is one window pass partitioned by the key, so Catalyst plans one exchange and one sort, and consecutive operators on the same key
share them.  Columns hold numbers of one unit (BIGINT micros for exact sums, or DOUBLE seconds).  Rows with a null time or bound are
left out.  Ties are settled by ``tie`` columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Seconds that may lie between intervals to be merged, for players, practice sessions and general footage.
TOLERANCE = {"player": 1.0, "practice": 0.2, "general": 0.5}


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def session_ids(df: DataFrame, key: str | list[str], t: str, gap, tie: list[str] | None = None, out: str = "session") -> DataFrame:
    """Number the sessions of each key: a new one begins where the time since the event before is more than ``gap``."""
    w = Window.partitionBy(*_keys(key)).orderBy(t, *(tie or []))
    begins = F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)
    return df.where(F.col(t).isNotNull()).withColumn("__new", begins).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def sessionize(df: DataFrame, key: str | list[str], t: str, gap, pre=0, post=0, tie: list[str] | None = None) -> DataFrame:
    """(key, start, end, n): sessions padded by ``pre`` and ``post``, the start not below 0.

    Padded sessions may overlap and are not merged again; ``merge_islands`` does that where it is wanted.
    """
    keys = _keys(key)
    g = session_ids(df, keys, t, gap, tie).groupBy(*keys, "session")
    return g.agg(F.greatest(F.lit(0), F.min(t) - pre).alias("start"), (F.max(t) + post).alias("end"), F.count("*").alias("n")).drop("session")


def padding(action: Column, motion: bool = False) -> tuple[Column, Column]:
    """Seconds before and after a session: long afterwards for bowling; motion sessions are tighter."""
    before, bowling = (1.5, 10.0) if motion else (2.0, 12.0)
    return F.lit(before), F.when(action == "bowling", bowling).otherwise(4.0)


def merge_islands(df: DataFrame, key: str | list[str], tolerance=0, start: str = "start", end: str = "end", tie: list[str] | None = None) -> DataFrame:
    """Merge intervals whose start is no more than ``tolerance`` beyond the furthest end so far.  Expects end >= start."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(start, *(tie or [end]))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__new", F.when(F.col(start) <= reach + tolerance, 0).otherwise(1))
    x = x.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")


def clamp(df: DataFrame, duration, start: str = "start", end: str = "end") -> DataFrame:
    """Drop intervals that end at or before 0, bound the others by 0 and ``duration``.  One that starts beyond it comes out inverted."""
    d = F.col(duration) if isinstance(duration, str) else F.lit(duration)
    return df.where(F.col(end) > 0).withColumn(start, F.greatest(F.lit(0), start)).withColumn(end, F.least(d, end))


def cap_total(df: DataFrame, key: str | list[str], most, start: str = "start", end: str = "end", tie: list[str] | None = None) -> DataFrame:
    """Keep intervals in order of start until their lengths add up to ``most``; the one that crosses it is cut short."""
    w = Window.partitionBy(*_keys(key)).orderBy(start, *(tie or [end])).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col(end) - F.col(start)).over(w), F.lit(0))
    x = df.where(F.col(end) > F.col(start)).withColumn("__used", used).where(F.col("__used") < most)
    return x.withColumn(end, F.least(F.col(end), F.col(start) + (F.lit(most) - F.col("__used")))).drop("__used")


def chunk(df: DataFrame, size, beyond, start: str = "start", end: str = "end") -> DataFrame:
    """Cut intervals longer than ``beyond`` into pieces of ``size`` (the last may be shorter), numbered by ``chunk``."""
    length = F.col(end) - F.col(start)
    pieces = F.when(length > beyond, F.ceil(length / size).cast("int")).otherwise(1)
    x = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), pieces - 1)))
    long = length > beyond
    begin = F.when(long, F.col(start) + F.col("chunk") * size).otherwise(F.col(start))
    stop = F.when(long, F.least(F.col(end), F.col(start) + (F.col("chunk") + 1) * size)).otherwise(F.col(end))
    return x.withColumn("__b", begin).withColumn("__e", stop).drop(start, end).withColumnsRenamed({"__b": start, "__e": end})


def session_stats(df: DataFrame, key: str | list[str], duration: Column, per_ball: Column | float = 0.8, start: str = "start", end: str = "end") -> DataFrame:
    """Segments, total and average length, percent of ``duration`` (0 if that isn't positive) and estimated balls (1 at least)."""
    total, n = F.sum(F.col(end) - F.col(start)), F.count("*")
    share = F.when(F.max(duration) > 0, total / F.max(duration) * 100).otherwise(0.0)
    rate = F.max(per_ball) if isinstance(per_ball, Column) else F.lit(per_ball)
    return df.groupBy(*_keys(key)).agg(n.alias("segments"), total.alias("total"), (total / n).alias("average"), share.alias("efficiency"), F.greatest(F.lit(1), (n * rate).cast("int")).alias("balls"))
