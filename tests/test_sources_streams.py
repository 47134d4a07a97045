import random

from pyspark.sql import functions as F

from tidespan.operators import intervals
from tidespan.plans import pipelines
from tidespan.sources import frames, tables
from tidespan.streaming import streams


def test_label_lines_skip_malformed(spark, tmp_path):
    p = str(tmp_path / "labels")
    tables.append_labels(spark.createDataFrame([("a.mp4", "six", 1.0, 2.0, {"k": "v"})], tables.CLIP), p)
    (tmp_path / "labels" / "bad.json").write_text('{"clip_path": "b.mp4", "label"\n')
    assert [r.clip_path for r in tables.read_labels(spark, p).collect()] == ["a.mp4"]


def test_manifest_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("v", 3.0, 4.0, "b", ["t"], None), ("v", 1.0, 2.0, "a", [], "x")], "video string, start double, end double, clip string, thumbs array<string>, label string")
    tables.write_manifest(d, "video", str(tmp_path / "m"))
    assert [(r.video_path, r.clip) for r in tables.read_manifest(spark, str(tmp_path / "m")).collect()] == [("v", "a"), ("v", "b")]


def test_frames(spark, tmp_path):
    f = tmp_path / "v.raw"
    f.write_bytes(bytes(range(40)))
    frames.register(spark)
    got = spark.read.format("frames").options(paths=str(f), width="2", height="2", fps="10", skip="3").load().orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.t_sec, bytes(r.pixels)[0]) for r in got] == [(0, 0.0, 0), (3, 0.3, 12), (6, 0.6, 24), (9, 0.9, 36)]


def test_frames_reads_what_a_filter_leaves(spark, tmp_path, monkeypatch):
    rnd = random.Random(1)
    paths = [str(tmp_path / f"{n}.raw") for n in "ab"]
    data = {p: rnd.randbytes(6 * n + 5) for p, n in zip(paths, (1000, 37))}  # the last frame is cut off
    for p, raw in data.items():
        with open(p, "wb") as f:
            f.write(raw)
    frames.register(spark)
    whole = spark.createDataFrame([(p, i, i / 29.97, bytearray(raw[6 * i : 6 * i + 6])) for p, raw in data.items() for i in range(len(raw) // 6)], "video string, frame_idx long, t_sec double, pixels binary")
    for where in ("t_sec >= 3.3 and t_sec < 7.1", f"frame_idx > 20 and frame_idx <= 30 and video = '{paths[0]}'", f"t_sec = {30 / 29.97!r}", f"t_sec > {30 / 29.97!r} and t_sec <= {33 / 29.97!r}", "t_sec < -1 or frame_idx = 5", "frame_idx in (3, 4) and t_sec is not null", "frame_idx > 5000", "video is null", "t_sec >= 'NaN'"):
        for skip in (1, 4):
            source = spark.read.format("frames").options(paths=",".join(paths), width="3", height="2", fps="29.97", skip=str(skip), part_frames="50").load()
            assert sorted(map(tuple, source.where(where).collect())) == sorted(map(tuple, whole.where(f"frame_idx % {skip} = 0").where(where).collect())), (where, skip)
    # bytes that are read, counted in this process
    read = []
    real = frames.opened

    def counting(path):
        size, make = real(path)

        class Spy:
            def __enter__(self):
                self.f = make()
                return self

            def __exit__(self, *_):
                self.f.close()

            def read_at(self, n, at):
                read.append((at, n))
                return self.f.read_at(n, at)

        return size, Spy

    monkeypatch.setattr(frames, "opened", counting)
    reader = frames.FramesReader({"paths": ",".join(paths), "width": "3", "height": "2", "fps": "10", "part_frames": "30"})
    odd = frames.GreaterThan(("pixels",), b"")
    assert list(reader.pushFilters([frames.GreaterThanOrEqual(("t_sec",), 20.0), frames.LessThan(("t_sec",), 30.0), odd])) == [odd]
    parts = reader.partitions()
    assert [(p.first, p.stop) for p in parts] == [(200, 230), (230, 260), (260, 290), (290, 300)]
    got = [x for p in parts for b in reader.read(p) for x in b.column("frame_idx").to_pylist()]
    assert got == list(range(200, 300)) and sum(n for _, n in read) == 100 * 6 and min(a for a, _ in read) == 1200


def test_stream_sessions_equal_batch(spark, tmp_path):
    rnd = random.Random(2)
    data = [(k, i, rnd.randrange(400)) for i, k in enumerate(rnd.choices(["a", "b"], k=60))] + [("c", 100, 0), ("c", 101, 10), ("c", 102, 21)]
    d = spark.createDataFrame(data, "k string, id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = streams.sessions(stream, "k", "ts", "10 seconds", "1 hour").writeStream.outputMode("complete").format("memory").queryName("s").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.k, r.start.timestamp(), r.n) for r in spark.table("s").collect())
    batch = intervals.sessionize(d, "k", "s", 10, tie=["id"])
    assert got == sorted((r.k, float(r.start), r.n) for r in batch.collect())


def test_rate_limit(spark):
    d = spark.createDataFrame([("u", i, t) for i, t in enumerate((0, 1, 2, 10, 11, 12))], "u string, id int, t long")
    got = streams.rate_limited(d, "u", "t", "id", 2, 10).orderBy("t").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True]


def test_pipelines(spark):
    videos = spark.createDataFrame([("v", 60.0, "batting", 100), ("w", 60.0, "bowling", 100)], "video_id string, duration double, action string, total_frames int")
    det = spark.createDataFrame([("v", 5.0), ("w", 50.0)], "video_id string, t double")
    seeds = spark.createDataFrame([("v", 1.0, 0.0, 0.0), ("v", 2.0, 90.0, 0.0), ("v", 3.0, 91.0, 0.0)], "video_id string, time_s double, x double, y double")
    got = sorted(tuple(r) for r in pipelines.highlights(det, seeds, videos).select("video_id", "start", "end").collect())
    assert got == [("v", 0.5, 6.0), ("w", 48.0, 60.0)]
    s = spark.createDataFrame([("v", i, i in (4, 5)) for i in range(20)], "video_id string, sample_idx int, moving boolean")
    got = pipelines.practice(s, videos.select("video_id", "total_frames")).collect()
    assert [(round(r.start, 3), round(r.end, 3)) for r in got] == [(0.0, 2.8)]
