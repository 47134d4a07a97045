import random

import pytest
from pyspark.sql import functions as F

from tidespan.functions import models, scalar
from tidespan.operators import jobs, tracks
from tidespan.sources import clips
from tidespan.streaming import streams


def test_follow_against_a_loop(spark):
    rnd = random.Random(3)
    rows, expected = [], {}
    for key in range(60):
        last, run, n, over = None, 0, 0, False
        for i in range(1, rnd.randrange(2, 60)):
            found, sim = rnd.random() < 0.6, rnd.choice([None, 0.1, 0.9, 0.9, 0.9, 0.35])
            rows.append((key, i, found, sim))
            if over:
                continue
            n += 1
            run = 0 if found else run + 1
            last = i if found else last
            over = run > 3 or (found and i % 4 == 0 and sim is not None and sim < 0.35)
        expected[key] = (last, n)
    d = spark.createDataFrame(rows, "key int, i long, found boolean, sim double").repartition(7)
    got = {r.key: (r.last, r.samples) for r in tracks.follow(d, "key", "i", "found", "sim", 3, 4).collect()}
    assert got == expected
    span = spark.createDataFrame([(10, 14, 100, 20), (10, 14, 100, None)], "begin int, seed int, total int, last int")
    assert [(r.start, r.end) for r in tracks.followed_span(span, "begin", "seed", "total", 10.0).collect()] == [(1.0, 3.1), (1.0, 1.5)]
    assert tracks.follow(d.where("false"), "key", "i", "found", "sim", 3, 4).count() == 0


def test_seeds_elect_a_track(spark):
    box = lambda x: (x, 0, x + 10, 10)
    b = "struct<x1:int,y1:int,x2:int,y2:int>"
    seeds = spark.createDataFrame([("v", 1, 10.0, box(0)), ("v", 2, 20.0, box(0)), ("w", 1, 5.0, box(0))], f"key string, seed int, ts double, a {b}")
    seen = spark.createDataFrame([("v", 7, 10.2, box(1)), ("v", 7, 20.1, box(0)), ("v", 8, 10.0, box(50)), ("w", 9, 50.0, box(0))], f"key string, track int, tt double, b {b}")
    first = spark.createDataFrame([("w", 1.0, 2.0, 1), ("v", 0.0, 1.0, 1)], "key string, start double, end double, n long")
    got = tracks.seeded_segments(seeds, seen, first, "key", 2.5, 2.0, 4.0, 0.5).collect()
    assert sorted((r.key, round(r.start, 1), round(r.end, 1)) for r in got) == [("v", 8.2, 14.2), ("v", 18.1, 24.1), ("w", 1.0, 2.0)]


def test_clips_try_in_order(spark):
    s = spark.createDataFrame([("v", 10.0, 30.0), ("v", 0.0, 5.0), ("v", 40.0, 200.0), ("v", 300.0, 310.0), ("v", 7.0, 7.0)], "key string, start double, end double").withColumn("source", F.lit("in/v.mp4"))
    p = clips.plan(s, "key", "source", "out")
    assert [(r.start, r.end, r.clip, r.batch) for r in p.orderBy("ordinal").collect()] == [(0.0, 5.0, "out/v_clips/clip_000.mp4", 0), (10.0, 30.0, "out/v_clips/clip_001.mp4", 0), (40.0, 135.0, "out/v_clips/clip_002.mp4", 0)]

    def run(args, timeout):
        if "libx264" in args and "10.0" in args:
            raise OSError("no encoder")
        return 10 if "40.0" in args else 5000

    a = [F.col("source"), F.col("start"), F.col("end"), F.col("clip")]
    done = clips.cut(p, {"encode": clips.encode_args(*a), "copy": clips.copy_args(*a)}, run)
    assert {r.ordinal: (r.done, r.bytes) for r in done.collect()} == {0: ("encode", 5000), 1: ("copy", 5000), 2: (None, None)}
    o = clips.outcomes(done, "key").first()
    assert (o.made, o.failed, o.seconds) == (2, 1, 25.0)
    assert clips.join_list(done, "key").first().lines == ["file 'out/v_clips/clip_000.mp4'", "file 'out/v_clips/clip_001.mp4'"]


def test_polling_and_listener(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "queued", None), ("a", 2, None, 5.0), ("b", 1, "queued", 1.0)], "id string, at int, status string, progress double")
    assert [tuple(r) for r in jobs.status_of(log, "id", ["a"], ["at"], ["status", "progress"]).collect()] == [("a", "queued", 5.0, 2)]
    told = []
    listener = streams.ProgressListener(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.json").write_text('{"kind": "upload", "job_id": "1"}\n{"kind": "other"}\n{"kind": \n')
        rows = streams.webhooks(spark, str(tmp_path / "in")).select("job_id", F.lit("error").alias("level"))
        q = streams.log_sink(rows, str(tmp_path / "out"), str(tmp_path / "c"))
        q.awaitTermination(60)
        assert [r.job_id for r in spark.read.json(str(tmp_path / "out")).where("level = 'error'").collect()] == ["1"]
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)


def test_checkpoints(spark, tmp_path):
    p = str(tmp_path / "models")
    for epoch, score in ((0, 0.5), (1, 0.9), (2, 0.9)):
        models.save_checkpoint(spark, p, epoch, score, bytes([epoch]), ["x"])
    assert models.best_checkpoint(spark, p).first().epoch == 1


@pytest.mark.parametrize("index, left", [(0, [2, 3]), (2, [1, 2]), (9, [1, 2, 3])])
def test_list_edits(spark, index, left):
    d = spark.createDataFrame([([1, 2, 3],)], "x array<int>")
    assert d.select(scalar.removed_at(F.col("x"), index)).first()[0] == left
