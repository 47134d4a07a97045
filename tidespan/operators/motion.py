"""Motion: velocity filters, frame differences and runs with hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import _keys, sessionize


def velocity_filter(df: DataFrame, key: str | list[str], t: str, x: str, y: str, speed, jitter=3.0, least_dt=1e-3, fewest: int = 3, tie: list[str] | None = None) -> DataFrame:
    """Rows whose distance from the row before is at least ``jitter`` and whose speed is at least ``speed``.

    Keys with fewer than ``fewest`` rows give none.  Adds ``distance`` and ``speed``.
    """
    w = Window.partitionBy(*_keys(key)).orderBy(t, *(tie or []))
    whole = Window.partitionBy(*_keys(key))
    distance = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    dt = F.greatest(F.lit(least_dt), F.col(t) - F.lag(t).over(w))
    d = df.withColumn("__n", F.count("*").over(whole)).withColumn("distance", distance).withColumn("__dt", dt)
    d = d.withColumn("speed", F.col("distance") / F.col("__dt"))
    return d.where((F.col("__n") >= fewest) & (F.col("distance") >= jitter) & (F.col("speed") >= speed)).drop("__n", "__dt")


def motion_segments(df: DataFrame, key: str | list[str], t: str, x: str, y: str, post, gap=2.5, pre=1.5, speed=100.0, jitter=3.0, tie: list[str] | None = None) -> DataFrame:
    """Sessions of the rows that move."""
    return sessionize(velocity_filter(df, key, t, x, y, speed, jitter, tie=tie), key, t, gap, pre, post, tie)


def share_changed(a: Column, b: Column, threshold) -> Column:
    """Share of cells that differ by more than ``threshold``; null if either is null or empty."""
    moved = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) > threshold, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(a) > 0, moved / F.size(a))


def frame_diff(df: DataFrame, key: list[str], order: str, cells: str, threshold, out: str = "changed") -> DataFrame:
    """Share of cells changed since the frame before in each key; the first frame has none and is left out."""
    w = Window.partitionBy(*key).orderBy(order)
    d = df.withColumn("__before", F.lag(cells).over(w)).where(F.col("__before").isNotNull())
    return d.withColumn(out, share_changed(F.col(cells), F.col("__before"), threshold)).drop("__before")


#: Fixed values of quick and detailed runs: seconds of stillness that close one, and the most seconds after it.
STILL_SECONDS = {"quick": 0.3, "detailed": 0.5}
MOST_AFTER = {"quick": 2.5, "detailed": 3.0}


def hysteresis_runs(df: DataFrame, key: str | list[str], index: str, moving: str, still: int) -> DataFrame:
    """(key, first, last, closed): runs that open at a moving sample and close at the ``still``-th still sample in a row.

    ``index`` numbers a key's samples without holes.  ``closed`` is the sample that closes the run, null if the samples end before.
    A run is a session of moving samples on the index: two belong together if fewer than ``still`` still ones lie between.
    """
    keys = _keys(key)
    last = df.groupBy(*keys).agg(F.max(index).alias("__end"))
    runs = sessionize(df.where(F.col(moving)), keys, index, still).withColumnsRenamed({"start": "first", "end": "last"})
    closed = F.when(F.col("last") + still <= F.col("__end"), F.col("last") + still)
    return runs.join(last, keys).select(*keys, "first", "last", closed.alias("closed"))


def stride(duration: Column, detailed: bool = False) -> Column:
    """Frames from one sample to the next, by the length of the video in seconds."""
    steps = (5, 3, 2, 1) if detailed else (10, 8, 5, 3)
    return F.when(duration > 1200, steps[0]).when(duration > 600, steps[1]).when(duration > 300, steps[2]).otherwise(steps[3])


def sampled(df: DataFrame, index: str, skip: int, every: int = 1, begin: int = 0) -> DataFrame:
    """Every ``skip``-th frame, and of those every ``every``-th (the detector's own cadence)."""
    off = F.col(index) - begin
    return df.where((off >= 0) & (off % skip == 0) & (F.floor(off / skip) % every == 0))


def changes_only(df: DataFrame, key: str | list[str], order: list, value: str, step) -> DataFrame:
    """Rows where ``value`` reaches another multiple of ``step`` (progress without repeats)."""
    w = Window.partitionBy(*_keys(key)).orderBy(*order)
    now = F.floor(F.col(value) / step)
    d = df.withColumn("level", now)
    return d.withColumn("__b", F.lag("level").over(w)).where(F.col("__b").isNull() | (F.col("__b") != F.col("level"))).drop("__b")
