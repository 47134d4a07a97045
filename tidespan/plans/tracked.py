"""Queries of the trackers: videos whose boxes are made from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import training
from ..operators import association, correlation, tracker, tracks
from ..sources import tables

#: Vectors of a video and of a frame; frames without boxes that end all tracks of a spell.
VIDEO, FRAME, HOLE = 200, 4, 30


def video_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Each vector is one box: four people walk through every video, and their vectors say how far each box is off, how it looks, and when nobody is seen."""
    e = tables.read(spark, d, "embeddings").where(F.size("embedding") >= 16)
    x = lambda i: F.col("embedding")[i].cast("double")
    person, frame = F.col("vec_id") % FRAME, F.floor((F.col("vec_id") % VIDEO) / FRAME)
    left, top, height = 90.0 * person + 2.5 * frame * (1 - 2 * (person % 2)) + 20 * x(0), 30.0 + 10 * person + 20 * x(1), 80.0 + 20 * x(2)
    look = F.array(*(F.when(person == i, 1.0).otherwise(0.0) + 0.5 * x(4 + i) for i in range(FRAME)))
    box = e.where(F.abs(x(3)) < 0.25).select(F.floor(F.col("vec_id") / VIDEO).alias("video"), frame.alias("frame"), person.alias("box"), left.alias("x1"), top.alias("y1"), (left + 0.4 * height).alias("x2"), (top + height).alias("y2"), look.alias("look"))
    return box


def tracked_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of confirmed tracks, filtered; Kalman filters and assignments are beyond SQL, a plain loop is the test."""
    found = tracks.fresh(tracker.multi_object(video_boxes(spark, d), "video"))
    return found.select("video", "frame", "box", "track", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


QUERIES = {"tracked_boxes": tracked_boxes}


#: Ids apart that a seed and a sighting may be, and the least overlap of their boxes.
NEAR, OVERLAP = 60, 0.3


def boxes_meet(spark: SparkSession, d: str) -> DataFrame:
    """The track that most seeds of each label elect: a third of the vectors are seeds, the others sightings; near in time and overlapping counts."""
    x = lambda i: F.col("embedding")[i].cast("double")
    left, top, width, height = 90 * x(0), 90 * x(1), 30 + 90 * F.abs(x(2)) + F.when(F.col("vec_id") % 11 == 0, 500.0).otherwise(0.0), 60 + 90 * F.abs(x(3))
    box = F.struct(left.alias("x1"), top.alias("y1"), (left + width).alias("x2"), (top + height).alias("y2"))
    e = tables.read(spark, d, "embeddings").where(F.size("embedding") >= 16).select("label", "vec_id", box.alias("box"))
    a = e.where("vec_id % 3 = 0").select("label", F.col("vec_id").alias("seed"), F.col("vec_id").alias("ts"), F.col("box").alias("a"))
    b = e.where("vec_id % 3 <> 0").select("label", (F.col("vec_id") % 7).alias("track"), F.col("vec_id").alias("tt"), F.col("box").alias("b"))
    pairs = association.overlapping(a, b, "label", "ts", "tt", NEAR, OVERLAP)
    return association.elect(association.votes(pairs, "label", "seed", "track", "seed"), "label", "track").select("label", "track", "votes", "first_seed")


QUERIES["boxes_meet"] = boxes_meet
ORACLE_SQL = {
    "boxes_meet": f"""with e as (select label, vec_id, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings where len(embedding) >= 16),
 o as (select label, vec_id, 90 * x[1] as x1, 90 * x[2] as y1, 90 * x[1] + (30 + 90 * abs(x[3]) + case when vec_id % 11 = 0 then 500 else 0 end) as x2, 90 * x[2] + (60 + 90 * abs(x[4])) as y2 from e),
 p as (select a.label, a.vec_id as seed, b.vec_id % 7 as track, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as common,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as areas from o a join o b on a.label = b.label and abs(a.vec_id - b.vec_id) <= {NEAR} and a.vec_id % 3 = 0 and b.vec_id % 3 <> 0),
 v as (select label, track, count(distinct seed) as votes, min(seed) as first_seed from p where common / (areas - common + 1e-6) >= {OVERLAP} group by label, track)
 select label, track, votes, first_seed from v qualify row_number() over (partition by label order by votes desc, first_seed, track) = 1"""
}


def trained_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all vectors, as eight frames of eight numbers, by the best of five epochs."""
    e = tables.read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    done = training.train(e, "embedding", "label", "vec_id", classes=10, frames=8, rate=0.01, decay=0.01)
    return training.predicted(e, done.best, "embedding").select("vec_id", "label", "predicted")


QUERIES["trained_epochs"] = trained_epochs


#: Vectors of a video of frames of eight by eight.
SHOTS = 40


def shifted_frames(spark: SparkSession, d: str) -> DataFrame:
    """A video is the picture of its first vector, moving by one cell right each frame and one down every third, round the borders, with the vector of each frame as noise."""
    from pyspark.sql import Window

    e = tables.read(spark, d, "embeddings").where(F.size("embedding") == 64)
    video, at = F.expr(f"vec_id div {SHOTS}"), F.col("vec_id") % SHOTS
    x = e.select(video.alias("video"), at.alias("frame"), "embedding").withColumn("base", F.first("embedding").over(Window.partitionBy("video").orderBy("frame")))
    old = lambda i: F.pmod(F.floor(i / 8) - F.expr("frame div 3"), F.lit(8)) * 8 + F.pmod(i % 8 - F.col("frame"), F.lit(8))
    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("base", old(i).cast("int")).cast("double") + 0.25 * F.get("embedding", i).cast("double"))
    return x.select("video", "frame", cells.alias("cells"))


def correlated_track(spark: SparkSession, d: str) -> DataFrame:
    """Where a correlation filter finds each video's target; a dense solve is the test."""
    out = correlation.correlate(shifted_frames(spark, d), "video", "frame", "cells", 8, fade=False)
    return out.select("video", "frame", "dx", "dy", F.round("peak", 6).alias("peak"), "found")


QUERIES["correlated_track"] = correlated_track


def tracked_spells(spark: SparkSession, d: str) -> DataFrame:
    """All boxes as one video in which frames without boxes count: its spells, between holes of more than ``HOLE`` frames, are tracked side by side."""
    b = video_boxes(spark, d).withColumn("frame", F.col("frame") + F.col("video") * (VIDEO // FRAME + HOLE + 2)).withColumn("all", F.floor(F.col("x1") * 0).cast("long"))
    found = tracks.fresh(tracker.multi_object(b, "all", every_frame=True, max_age=HOLE, rows=400))
    return found.select("spell", "frame", "box", "track", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


QUERIES["tracked_spells"] = tracked_spells
