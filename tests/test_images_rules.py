"""Images, upload rules, manifests, practice bounds and the linear head."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidespan.functions import images, models, scalar, vision
from tidespan.plans import pipelines
from tidespan.sources import tables


def naive_blur(cells, width, size=15):
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    taps = [math.exp(-((i - size // 2) ** 2) / (2 * sigma**2)) for i in range(size)]
    taps = [t / sum(taps) for t in taps]
    height = len(cells) // width

    def mirrored(i, n):
        while not 0 <= i < n:
            i = -i if i < 0 else 2 * n - 2 - i
            if n == 1:
                return 0
        return i

    down = [[sum(taps[k] * cells[mirrored(y + k - size // 2, height) * width + x] for k in range(size)) for x in range(width)] for y in range(height)]
    return [sum(taps[k] * down[y][mirrored(x + k - size // 2, width)] for k in range(size)) for y in range(height) for x in range(width)]


def test_blur_against_a_loop(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.randrange(256) for _ in range(w * h)], w) for i, (w, h) in enumerate([(20, 9), (3, 4), (1, 1), (30, 1), (16, 16)])]
    d = spark.createDataFrame(rows + [(9, [], 4), (10, None, 4)], "i int, cells array<int>, w int")
    got = {r.i: r.b for r in d.select("i", images.blurred(F.col("cells"), F.col("w")).alias("b")).collect()}
    assert got[9] == [] and got[10] is None
    for i, cells, w in rows:
        assert all(abs(a - b) <= 0.5 + 1e-6 for a, b in zip(got[i], naive_blur(cells, w), strict=True))


def test_regions_without_pixels(spark):
    d = spark.createDataFrame([(1, [[0, 0, 255], [0, 0, 255], [255, 0, 0]]), (2, []), (3, None)], "i int, p array<array<int>>")
    assert {r.i: r.m for r in d.select("i", images.mean_color(F.col("p")).alias("m")).collect()} == {1: [85, 0, 170], 2: None, 3: None}
    h = {r.i: r.histogram for r in images.color_histogram(d, ["i"], "p").collect()}
    assert sum(h[2]) == sum(h[3]) == 0 and len(h[1]) == 256 and sum(x * x for x in h[1]) == pytest.approx(1)
    assert h[1][15] == pytest.approx(2 / 5**0.5) and h[1][10 * 16 + 15] == pytest.approx(1 / 5**0.5)  # red at hue 0, blue at hue 120
    assert [r.q for r in spark.createDataFrame([([1, 2, 3], 3)], "c array<int>, w int").select(images.quarter(F.col("c"), F.col("w")).alias("q")).collect()] == [[]]


def test_uploads_by_type(spark):
    mb = 1024 * 1024
    rows = [("video", "video/mp4", 500 * mb, True), ("video", "video/mp4", 500 * mb + 1, False), ("video", "video/ogg", 1, False), ("image", "image/png", 10 * mb, True), ("image", "video/mp4", 1, False), ("audio", None, 1, False), ("text", "text/plain", 1, False)]
    d = spark.createDataFrame(rows, "kind string, mime string, size long, want boolean")
    assert d.where(scalar.acceptable_upload(F.col("kind"), F.col("mime"), F.col("size")) != F.col("want")).count() == 0


def test_practice_is_bounded_by_the_video(spark):
    """A run that is open at the end stops there; a tail that is too short within the video goes."""
    rows = [("a", i, i >= 95) for i in range(100)] + [("b", i, i == 99) for i in range(100)]
    samples = spark.createDataFrame(rows, "video_id string, sample_idx long, moving boolean")
    videos = spark.createDataFrame([("a", 300, 9.8), ("b", 300, 9.5)], "video_id string, total_frames long, duration double")
    assert [(r.video_id, r.start, r.end) for r in pipelines.practice(samples, videos).collect()] == [("a", 9.0, 9.8)]
    long = spark.range(100_050).selectExpr("'c' as video_id", "id as sample_idx", "id >= 100010 as moving")
    assert pipelines.practice(long, spark.createDataFrame([("c", 300_150, 10_005.0)], videos.schema), mode="detailed").count() == 0
    assert pipelines.practice(long, spark.createDataFrame([("c", 300_150, 10_005.0)], videos.schema)).count() == 1


def test_manifest_keeps_meta(spark, tmp_path):
    d = spark.createDataFrame([("v", 3.0, 4.0, "b", ["t"], None, {"k": "2"}), ("v", 1.0, 2.0, "a", [], "x", {"k": "1"})], "key string, start double, end double, clip string, thumbs array<string>, label string, meta map<string,string>")
    tables.write_manifest(d, "key", str(tmp_path / "m"))
    assert spark.read.schema(tables.MANIFEST).json(str(tmp_path / "m")).first().meta == {"k": "1"}
    assert [r.clip for r in tables.read_manifest(spark, str(tmp_path / "m")).collect()] == ["a", "b"]


def test_regions_are_cut_to_the_frame(spark):
    r = spark.range(1).select(F.explode(vision.regions(F.lit(-5), F.lit(-10), F.lit(200), F.lit(100), F.lit(50), F.lit(81))).alias("r")).select("r.*").collect()
    assert [(x.name, x.x1, x.y1, x.x2, x.y2) for x in r][:2] == [("helmet", 0, 0, 49, 12), ("torso", 0, 12, 49, 48)]


def test_head_learns(spark):
    rnd = random.Random(2)
    d = spark.createDataFrame([(i, [rnd.gauss(3 * (i % 3 == k), 1) for k in range(3)], i % 3 if i else None) for i in range(300)], "i int, v array<double>, y int")
    out = models.apply_head(d, models.train_head(d, "v", "y"), "v").collect()
    assert len(out) == 300 and sum(r.predicted == r.y for r in out) > 250


def test_frames_of_any_store(spark, tmp_path):
    raw = bytes(range(250)) * 2
    (tmp_path / "v.raw").write_bytes(raw)
    from tidespan.sources import frames

    run = lambda **o: [(r.frame_idx, r.t_sec, bytes(r.pixels)) for r in frames.scan(spark, str(tmp_path / "v.raw"), 3, 4, **o).orderBy("frame_idx").collect()]
    want = [(i, i / 10, raw[12 * i : 12 * i + 12]) for i in range(41)]
    assert run(fps=10) == run(fps=10, begin=7, stop=3) == want
    assert run(fps=10, skip=4, begin=2, stop=20) == want[2:20:4] and run(begin=50) == []
    assert [x[0] for x in run(count=4)] == [5, 15, 25, 35]
