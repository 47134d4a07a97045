"""Snapshots of a log, models that fail, and the chains from frames and candidates, with odd rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidespan.functions import models
from tidespan.operators import jobs
from tidespan.plans import pipelines
from tidespan.sources import tables


def log(spark, seed=0, n=200):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abcde"), i // 3, i, rnd.choice([None, "queued", "done"]), rnd.choice([None, None, 0.5, 1.0]), i // 40) for i in range(n)] + [("quiet", 5, 1000, None, None, 0), (None, 6, 1001, "done", None, 1)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "id string, at long, seq long, status string, progress double, batch long")


def rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def test_snapshots_add_up_to_the_whole_log(spark, tmp_path):
    d, fields, order = log(spark), ["status", "progress"], ["at", "seq"]
    want = rows(jobs.latest(d, "id", order, fields))
    part = lambda where: jobs.snapshot(d.where(where), "id", order, fields)
    for a, b in (("batch < 2", "batch >= 2"), ("batch < 4", "batch > 1"), ("batch >= 2", "batch < 3"), ("true", "false"), ("false", "true")):
        assert rows(jobs.state_of(jobs.merged(part(a), part(b), "id"), "id")) == want
    folder = str(tmp_path / "snapshots")
    for upto in (0, 0, 2, 4):
        some = d.where(f"batch <= {upto}")
        got = jobs.compact(some, folder, "id", order, fields)
        assert rows(jobs.state_of(got, "id")) == rows(jobs.latest(some, "id", order, fields))
    assert sorted(os.listdir(folder)) == ["upto=0", "upto=2", "upto=4"]
    os.remove(f"{folder}/upto=4/_SUCCESS")  # cut off: written again from the one before
    assert rows(jobs.state_of(jobs.compact(d, folder, "id", order, fields), "id")) == want
    assert jobs.compact(d.where("false"), str(tmp_path / "none"), "id", order, fields).count() == 0
    full = jobs.as_rows(d.select("id", "status"), tables.JOB)
    assert full.columns == tables.JOB.names and full.where("error is null").count() == d.count()


def test_models_that_fail(spark):
    d = spark.createDataFrame([(i, None if i == 3 else bytearray([i] * 4)) for i in range(12)], "i int, content binary")

    def detector():
        def detect(frames):
            if any(f[0] == 5 for f in frames):
                raise RuntimeError
            return [[(0.0, 1.0, float(f[0]), 3.0, 0, 0.5)] * (f[0] % 3) for f in frames]

        return detect

    got = {r.i: r.boxes for r in models.detections(d, detector, "content").collect()}
    assert {i: len(b) for i, b in got.items()} == {i: 0 if i in (3, 5) else i % 3 for i in range(12)} and got[2][0].x2 == 2.0 and got[2][0].cls == 0

    def reader():
        def read(x):
            if x[0] == 4:
                raise ValueError
            return ["no", x[0]]

        return read

    texts = {r.i: r.texts for r in models.read_texts(d, reader, "content", 2, "i").collect()}
    assert texts == {i: ["no", str(i)] if i % 2 == 0 and i != 4 else [] for i in range(12)}

    def scorer():
        return lambda x: "0.5" if x[0] != 7 else 1 / 0

    answers = {r.i: r.answer for r in models.scored(d, scorer, "content").collect()}
    assert answers == {i: "" if i in (3, 7) else "0.5" for i in range(12)}
    none = d.where("false")
    assert models.detections(none, detector, "content").count() == models.read_texts(none, reader, "content", 2, "i").count() == models.scored(none, scorer, "content").count() == 0


def test_movement_of_a_square(spark):
    places = [0] * 10 + list(range(0, 40, 8)) + [40] * 10
    data = [("v", i, a) for i, a in enumerate(places)] + [("still", i, 3) for i in range(12)] + [("one", 0, 0), ("odd", 0, None), ("odd", 1, 0), ("odd", 2, None)]
    i, at = F.sequence(F.lit(0), F.lit(64 * 64 - 1)), F.col("at")
    cell = lambda i: F.array_repeat(F.when((i % 64).between(at, at + 23) & F.floor(i / 64).between(16, 47), 200).otherwise(10), 3)
    d = spark.createDataFrame(data, "video_id string, sample_idx int, at int").repartition(3).withColumn("pixels", F.when(at.isNotNull(), F.transform(i, cell)))
    videos = d.groupBy("video_id").agg((F.count("*") * 3).alias("total_frames"))
    got = pipelines.movement(d, videos, 64).collect()
    assert [r.video_id for r in got] == ["v"] and (got[0].start, got[0].end) == pytest.approx((11 * 0.1 - 0.5, 2.5))  # from the first change to the video's end
    assert pipelines.movement(d.where("false"), videos, 64).count() == 0


CANDIDATES = "video_id string, frame int, box int, x1 int, y1 int, x2 int, y2 int, width int, height int, text string, helmet array<int>, glove_left array<int>, torso array<int>, vector array<double>"


def test_seeds(spark):
    red, blue = [0, 0, 255], [255, 0, 0]
    box = lambda v, f, b, text=None, helmet=None, torso=None, vector=(1.0, 0.0), x=0, w=30: (v, f, b, x, 0, x + w, 60, 300, 200, text, helmet, None, torso, list(vector))
    data = [box("a", 0, 0, torso=blue), box("a", 0, 1, torso=red), box("a", 1, 0, torso=blue, vector=(0.0, 1.0)), box("a", 2, 0, w=10, torso=red), box("b", 0, 0), box("b", 0, 1, x=140), box("c", 0, 0, text="1 7"), box("c", 0, 1, helmet=red)]
    d = spark.createDataFrame(data, CANDIDATES)
    pick = lambda **hints: {(r.video_id, r.frame): r.box for r in pipelines.seeds(d, **hints).collect()}
    assert pick(shirt=(0, 0, 255)) == {("a", 0): 1}
    assert pick(jersey="17") == {("c", 0): 0}
    assert pick(helmet=(0, 0, 255)) == {("c", 0): 1}
    assert pick() == {("a", 0): 0, ("a", 1): 0, ("b", 0): 1, ("c", 0): 0}  # without hints the best of each frame; ties to the smaller box
    assert pipelines.seeds(d.where("false"), jersey="17").count() == 0
