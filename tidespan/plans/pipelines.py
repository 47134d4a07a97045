"""The two session pipelines as single lazy plans partitioned by video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images, scalar, vision
from ..operators import association, intervals, motion, select
from ..sources import scratch


def highlights(detections: DataFrame, seeds: DataFrame, videos: DataFrame, key: str = "video_id", most_seconds: float = 120.0, segments: int = 50, speed: float = 20.0) -> DataFrame:
    """Motion segments of each video, or else its detection segments; the first ``segments``, clamped and capped.

    detections (key, t), seeds (key, time_s, x, y), videos (key, duration, action).  Returns (key, start, end).
    """
    def padded(d: DataFrame, t: str, moving: bool) -> DataFrame:
        pre, post = intervals.padding(F.col("action"), moving)
        s = intervals.sessionize(d, key, t, 2.5).join(videos, key)
        return s.select(key, F.greatest(F.lit(0.0), F.col("start") - pre).alias("start"), (F.col("end") + post).alias("end"))

    moving = padded(motion.velocity_filter(seeds, key, "time_s", "x", "y", speed), "time_s", True)
    both = select.if_empty(moving, padded(detections, "t", False), key)
    first = select.top_per_key(both, key, ["start", "end"], segments).drop("rank")
    clamped = intervals.clamp(first.join(videos.select(key, "duration"), key), "duration").drop("duration")
    return intervals.cap_total(clamped, key, most_seconds)


#: Samples after which a detailed run stops.
MOST_SAMPLES = 100_000


def practice(samples: DataFrame, videos: DataFrame, key: str = "video_id", batting: bool = True, fps: float = 30.0, skip: int = 3, mode: str = "quick") -> DataFrame:
    """Movement segments of practice videos from samples (key, sample_idx, moving): runs, padding, bounds, least duration, merged.

    videos: (key, total_frames) and their duration (if it is not given, that of the frames).  An end is bounded by the duration before the length is tested.  Fixed values by practice type:
    least duration, padding before and after; by mode (quick or detailed) the stillness that closes a run and the most padding after it.
    """
    least, before, after = (0.3, 0.5, 2.0) if batting else (0.4, 0.8, 2.5)
    still = max(1, int(fps * motion.STILL_SECONDS[mode] / skip))
    if mode == "detailed":
        samples = samples.where(F.col("sample_idx") < MOST_SAMPLES)
    if "duration" not in videos.columns:
        videos = videos.withColumn("duration", F.col("total_frames") / fps)
    runs = motion.hysteresis_runs(samples, key, "sample_idx", "moving", still).join(videos, key)
    end = F.coalesce(F.col("closed") * skip, F.col("total_frames")) / fps
    s = runs.select(key, F.greatest(F.lit(0.0), F.col("first") * skip / fps - before).alias("start"), F.least("duration", end + min(after, motion.MOST_AFTER[mode])).alias("end"))
    return intervals.merge_islands(s.where(F.col("end") - F.col("start") >= least), key, intervals.TOLERANCE["practice"]).drop("n")


#: How much a cell must change, and the share of cells that must, for a frame to count as moving.
CELL_CHANGE, MOVING_SHARE = 20, 0.02


def movement(frames: DataFrame, videos: DataFrame, width: int, key: str = "video_id", pixels: str = "pixels", batting: bool = True, fps: float = 30.0, skip: int = 3, mode: str = "quick", change=CELL_CHANGE, share: float = MOVING_SHARE) -> DataFrame:
    """From sampled frames to movement segments: gray, a quarter of the size, blurred, compared with the frame before, then the runs of ``practice``.

    frames (key, sample_idx, ``pixels``: an array of (blue, green, red) row by row, ``width`` in a row); videos as in ``practice``.  Every step but the blur is a column expression, and all
    windows are over the key.  The first frame of a video has nothing to compare with and counts neither as moving nor as still.
    """
    small = frames.select(key, "sample_idx", images.quarter(images.gray(F.col(pixels)), F.lit(width)).alias("cells"))
    soft = small.select(key, "sample_idx", images.blurred(F.col("cells"), F.lit(width // 4)).alias("cells"))
    changed = motion.frame_diff(soft, [key], "sample_idx", "cells", change)
    return practice(changed.select(key, "sample_idx", (F.col("changed") > share).alias("moving")), videos, key, batting, fps, skip, mode)


def seeds(candidates: DataFrame, jersey: str | None = None, helmet: tuple | None = None, glove: tuple | None = None, pad: tuple | None = None, shirt: tuple | None = None, color_threshold: float = 0.28, key: str = "video_id") -> DataFrame:
    """The seeds of a player: the best accepted candidate of each frame, as (key, frame, box, score).

    candidates: key, frame, box, x1, y1, x2, y2, width and height of the frame, ``text`` (what was read on it), ``vector`` (its color histogram) and mean colors (blue, green, red) ``helmet``, ``glove_left`` and
    ``torso``, null where a region is empty.  Boxes below the least size go.  Hints are colors; a number on the jersey, sure colors or a like shirt lock the reference, to which later candidates are compared.  Without any hint the
    best candidate of each frame is taken.
    """
    x = candidates.where(vision.box_ok(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    like = lambda region, hint: 1 - vision.color_distance(F.col(region), F.array(*map(F.lit, hint)))
    hints = {f"__{region}": like(region, hint) for region, hint in (("helmet", helmet), ("glove_left", glove), ("torso", pad)) if hint}
    x = x.withColumns(hints)  # columns of their own, so that no expression holds a color's many times
    count = sum((F.col(c).isNotNull().cast("int") for c in hints), F.lit(0))
    mean = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in hints), F.lit(0.0)) / F.nullif(count, F.lit(0))
    x = x.withColumn("__sure", F.coalesce(mean >= 1 - color_threshold, F.lit(False)))
    x = x.withColumn("__read", scalar.contains_label(F.col("text"), F.lit(jersey)) if jersey else F.lit(False))
    x = x.withColumn("__shirt", F.coalesce(like("torso", shirt), F.lit(0.0)) if shirt else F.lit(0.0))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    center = vision.center_bias(0.5 * (F.col("x1") + F.col("x2")), 0.5 * (F.col("y1") + F.col("y2")), F.col("width"), F.col("height"))
    base = vision.player_score(F.col("__read"), F.col("__sure"), F.col("__shirt"), F.lit(0.0), center, w * h / (F.col("width") * F.col("height")))
    x = x.withColumn("__base", base).withColumn("__lock", F.col("__read") | F.col("__sure") | (F.col("__shirt") >= 0.6))
    # The lock needs all candidates before it can score any again: they are scored once and written.
    x = scratch.written(x.select(key, "frame", "box", "vector", "__base", "__lock"), "candidates")
    any_hint = bool(jersey or helmet or glove or pad or shirt)
    found = association.lock_on(x, key, "frame", "box", "__base", "__lock", (0.45 if shirt else 0.25) if any_hint else float("-inf"), vision.histogram_similarity)
    return found.select(key, "frame", "box", "score")
