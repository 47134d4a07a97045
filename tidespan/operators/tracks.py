"""Tracks: boxes of a frame, fresh track states, forward tracking with a lost-run limit, and sessions of the track that seeds elect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vision
from . import association, intervals, select
from .intervals import _keys

#: The class number of a person, and the least width and height of a box.
PERSON = 0
LEAST_BOX = (20, 40)


def boxes(frames: DataFrame, detected: str = "boxes", cls: str = "cls") -> DataFrame:
    """One row per person box of sufficient size: the columns of ``frames``, box (its number in the frame) and the fields of the struct.

    ``detected`` is an array of structs (x1, y1, x2, y2, ``cls``, ...).  Numbers count all boxes of a frame, kept or not.
    """
    rest = [c for c in frames.columns if c != detected]
    x = frames.select(*rest, F.posexplode(detected).alias("box", "__b")).select(*rest, "box", "__b.*")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return x.where((F.col(cls) == PERSON) & (w >= LEAST_BOX[0]) & (h >= LEAST_BOX[1])).drop(cls)


def fresh(df: DataFrame, state: str = "confirmed", age: str = "time_since_update") -> DataFrame:
    """Rows of confirmed tracks that were updated in their frame."""
    return df.where(F.col(state) & (F.col(age) == 0))


def histories(df: DataFrame, key: str | list[str], track: str, t: str, *fields: str) -> DataFrame:
    """Each track's sightings as one array in order of time.  A row is as long as its track; the long form needs no such step."""
    return df.groupBy(*_keys(key), track).agg(F.array_sort(F.collect_list(F.struct(t, *fields))).alias("history"))


def follow(samples: DataFrame, key: str | list[str], frame: str, found: str, similarity: str, lost: int, check: int, least: float = 0.35) -> DataFrame:
    """(key, last, samples): how far each track runs.  ``frame`` counts frames since its start.

    A track ends with the sample at which more than ``lost`` samples in a row have not found it, or with a found sample whose frame is a multiple of
    ``check`` and whose ``similarity`` is below ``least`` (null: not compared).  ``last`` is the last frame that found it, null for none.
    """
    w = Window.partitionBy(*_keys(key)).orderBy(frame)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = samples.withColumn("__r", F.row_number().over(w))
    run = F.col("__r") - F.coalesce(F.max(F.when(F.col(found), F.col("__r"))).over(upto), F.lit(0))
    x = x.withColumn("__run", run)
    unlike = F.col(found) & (F.col(frame) % max(1, check) == 0) & F.coalesce(F.col(similarity) < least, F.lit(False))
    x = x.withColumn("__stop", F.when(unlike | (F.col("__run") > lost), 1).otherwise(0))
    x = x.withColumn("__over", F.coalesce(F.max("__stop").over(before), F.lit(0))).where("__over = 0")
    return x.groupBy(*_keys(key)).agg(F.max(F.when(F.col(found), F.col(frame))).alias("last"), F.count("*").alias("samples"))


def followed_span(followed: DataFrame, begin: str, seed: str, total: str, fps: float) -> DataFrame:
    """Adds start and end in seconds to the rows of ``follow`` joined with the track's first, seed and total frames."""
    last = F.coalesce(F.col(begin) + F.col("last"), F.col(seed))
    return followed.withColumn("start", F.greatest(F.lit(0.0), F.col(begin) / fps)).withColumn("end", F.least((last + 1) / fps, F.col(total) / fps))


def seeded_segments(seeds: DataFrame, tracks: DataFrame, first: DataFrame, key: str, gap, pre, post, window, overlap: float | None = 0.3, duration: str | None = None) -> DataFrame:
    """(key, start, end, n): sessions of the track that most seeds elect, or the segments ``first`` (key, start, end, n) of keys without one.

    ``seeds``: key, seed, ts; ``tracks``: key, track, tt; with boxes as structs ``a`` and ``b`` of x1, y1, x2, y2 unless ``overlap`` is None.
    A seed votes once for each track that has a sighting within ``window`` of it and boxes that overlap that much.
    """
    pairs = association.within(seeds, tracks, key, "ts", "tt", window)
    if overlap is not None:
        box = lambda c: {n: F.col(f"{c}.{n}") for n in ("x1", "y1", "x2", "y2")}
        pairs = pairs.where(vision.iou(box("a"), box("b")) >= overlap)
    best = association.elect(association.votes(pairs, key, "seed", "track", "seed"), key, "track").select(key, "track")
    seen = tracks.join(best, [key, "track"], "left_semi")
    out = intervals.sessionize(seen, key, "tt", gap, pre, post)
    out = intervals.clamp(out, duration) if duration else out
    return select.if_empty(out, first.select(*out.columns), key)
