import random

import pytest
from pyspark.sql import functions as F

from tidespan.operators import association, dataset, intervals, jobs, motion, select
from tidespan.functions import scalar, vision


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def spans(spark, *pairs):
    return spark.createDataFrame([("v", float(a), float(b), i) for i, (a, b) in enumerate(pairs)], "key string, start double, end double, id int")


@pytest.mark.parametrize("times, expected", [((0, 2.5), [(0, 6.5)]), ((0, 2.75), [(0, 4), (0.75, 6.75)]), ((1,), [(0, 5)])])
def test_sessionize(spark, times, expected):
    d = spark.createDataFrame([("v", float(t)) for t in times], "key string, t double")
    assert rows(intervals.sessionize(d, "key", "t", 2.5, 2, 4), "start", "end") == expected


@pytest.mark.parametrize("pairs, tolerance, expected", [(((0, 1), (2, 3)), 1.0, [(0, 3)]), (((0, 10), (2, 3)), 0.2, [(0, 10)]), (((0, 1), (2.5, 3)), 1.0, [(0, 1), (2.5, 3)])])
def test_islands(spark, pairs, tolerance, expected):
    once = intervals.merge_islands(spans(spark, *pairs), "key", tolerance)
    assert rows(once, "start", "end") == expected
    assert rows(intervals.merge_islands(once.drop("n"), "key", tolerance), "start", "end") == expected


def test_clamp_keeps_inverted_ones(spark):
    d = spans(spark, (-1, 0), (-1, 5), (8, 20), (12, 20))
    assert rows(intervals.clamp(d, 10), "start", "end") == [(0, 5), (8, 10), (12, 10)]


@pytest.mark.parametrize("pairs, expected", [(((0, 50), (60, 120), (130, 140)), [(0, 50), (60, 110)]), (((0, 100), (200, 210)), [(0, 100)]), ((), [])])
def test_cap(spark, pairs, expected):
    assert rows(intervals.cap_total(spans(spark, *pairs), "key", 100), "start", "end") == expected


def test_cap_against_a_loop(spark):
    rnd = random.Random(3)
    data = [(k, rnd.randrange(200) / 4, 0.0, i) for i, k in enumerate(rnd.choices("abcd", k=200))]
    data = [(k, s, s + rnd.randrange(40) / 4 - 1, i) for k, s, _, i in data]
    d = spark.createDataFrame(data, "key string, start double, end double, id int")
    expected = []
    for key in "abcd":
        used = 0.0
        for _, s, e, _ in sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[3])):
            if e > s and used < 30:
                expected.append((key, s, min(e, s + 30 - used)))
                used += e - s
    assert rows(intervals.cap_total(d, "key", 30, tie=["id"]), "key", "start", "end") == sorted(expected)


def test_chunk(spark):
    assert rows(intervals.chunk(spans(spark, (0, 20), (100, 137)), 15, 20), "start", "end") == [(0, 20), (100, 115), (115, 130), (130, 137)]


@pytest.mark.parametrize("scored, expected", [(((0, 200, 0.9),), [(0, 120)]), (((0, 100, 0.9), (200, 250, 0.8), (300, 310, 0.7)), [(0, 100)]), (((0, 5, 0.55), (9, 9, 0.9)), [(0, 5)])])
def test_budget(spark, scored, expected):
    d = spark.createDataFrame([("v", float(a), float(b), s) for a, b, s in scored], "key string, start double, end double, score double")
    assert rows(select.budgeted_top_k(d, "key", "score", 10, 120.0, 0.55), "start", "end") == expected


@pytest.mark.parametrize("flags, still, expected", [("MSMSS", 2, [(0, 2, 4)]), ("SM", 2, [(1, 1, None)]), ("SSS", 1, [])])
def test_hysteresis(spark, flags, still, expected):
    d = spark.createDataFrame([("v", i, f == "M") for i, f in enumerate(flags)], "key string, i int, moving boolean")
    assert rows(motion.hysteresis_runs(d, "key", "i", "moving", still), "first", "last", "closed") == expected


def test_velocity_needs_three(spark):
    d = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 1.0, 300.0, 0.0), ("b", 0.0, 0.0, 0.0), ("b", 1.0, 300.0, 0.0), ("b", 2.0, 301.0, 0.0)], "key string, t double, x double, y double")
    assert rows(motion.velocity_filter(d, "key", "t", "x", "y", 100), "key", "t") == [("b", 1.0)]


def test_interval_join_plans_no_loop(spark):
    rnd = random.Random(5)
    a = [(rnd.choice("xy"), i, rnd.randrange(1000) / 100) for i in range(60)]
    b = [(rnd.choice("xy"), i, rnd.randrange(1000) / 100) for i in range(90)]
    got = association.within(spark.createDataFrame(a, "k string, seed int, ts double"), spark.createDataFrame(b, "k string, point int, tt double"), "k", "ts", "tt", 0.7)
    assert rows(got, "seed", "point") == sorted((i, j) for k, i, s in a for m, j, t in b if k == m and abs(s - t) <= 0.7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_votes_tie_goes_to_the_earliest(spark):
    d = spark.createDataFrame([("v", 2, 7), ("v", 1, 9), ("v", 2, 7)], "k string, seed int, track int")
    assert rows(association.elect(association.votes(d, "k", "seed", "track", "seed"), "k", "track"), "track", "votes") == [(9, 1)]


def test_lock_on_against_a_loop(spark):
    rnd = random.Random(11)
    data = []
    for v in range(6):
        for frame in range(8):
            data += [(v, frame, box, rnd.randrange(100) / 100, rnd.random() < 0.08, [float(rnd.randrange(1, 9)), float(rnd.randrange(1, 9))]) for box in range(3)]
    d = spark.createDataFrame(data, "k int, frame int, box int, base double, hit boolean, vector array<double>")

    def sim(a, b):
        s = sum((x * y) ** 0.5 for x, y in zip(a, b)) / (sum(a) * sum(b)) ** 0.5
        return max(0.0, 1 - max(0.0, 1 - s) ** 0.5)

    expected = []
    for v in range(6):
        ref = None
        for frame in range(8):
            scored = []
            for _, _, box, base, hit, vec in (r for r in data if r[:2] == (v, frame)):
                if hit and ref is None:
                    ref = vec
                scored.append((-(base + (0.6 * sim(ref, vec) if ref else 0.0)), box, vec))
            s, box, vec = min(scored)
            if -s >= 0.4:
                expected.append((v, frame, box))
                ref = ref or vec
    got = association.lock_on(d, "k", "frame", "box", "base", "hit", 0.4, vision.histogram_similarity)
    assert rows(got, "k", "frame", "box") == sorted(expected)


def test_scalars(spark):
    d = spark.createDataFrame([("1:30",), ("",), ("a",), ("1:2:3:4",), (None,), (" 90 ",)], "t string")
    assert [r[0] for r in d.select(scalar.timecode(F.col("t"))).collect()] == [90.0, None, None, None, None, 90.0]
    one = spark.range(1)
    assert one.select(scalar.clock(F.lit(3661.9)), scalar.short_clock(F.lit(75)), scalar.file_size(F.lit(1536)), scalar.file_size(F.lit(0)), scalar.safe_name(F.lit("A b__(c).MP4")), scalar.score_json(F.lit("x 0.7 y")), scalar.percent(F.lit(1), F.lit(0))).first() == ("01:01:01", "1:15", "1.5 KB", "0 Bytes", "a_b_c_.mp4", 0.7, 0)
    assert [r[0] for r in one.select(F.explode(F.array(*(vision.color(F.lit(x)) for x in ("Red", "#0f0", "#0000ff", "1, 2,3", "blue-ish", ""))))).collect()] == [[0, 0, 255], [0, 255, 0], [255, 0, 0], [3, 2, 1], None, None]
    assert one.select(vision.color_distance(vision.color(F.lit("red")), vision.color(F.lit("red")))).first()[0] == 0.0


def test_folded_mean(spark):
    h = F.array(F.array(F.lit(0.0)), F.array(F.lit(4.0)), F.array(F.lit(8.0)))
    assert spark.range(1).select(vision.folded_mean(h)).first()[0] == [5.0]


def test_split_sizes_and_determinism(spark):
    d = spark.range(103).withColumnRenamed("id", "key")
    a, b = (rows(dataset.split(d, "key", 0.1, 0.2), "key", "split") for _ in range(2))
    assert a == b
    assert [sum(s == n for _, s in a) for n in ("validation", "test", "train")] == [10, 20, 73]


def test_latest_keeps_old_values_for_nulls(spark):
    d = spark.createDataFrame([("j", 1, "queued", 0.0), ("j", 2, "done", None), ("k", 1, None, None)], "id string, at int, status string, progress double")
    assert rows(jobs.latest(d, "id", ["at"], ["status", "progress"]), "id", "status", "progress") == [("j", "done", 0.0), ("k", None, None)]


def test_if_empty(spark):
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert rows(select.if_empty(a, b, "k"), "k", "v") == [("x", 1), ("y", 3)]
    assert rows(select.if_empty(a.where("false"), b, "k"), "k", "v") == [("x", 2), ("y", 3)]


@pytest.mark.parametrize("least, cell", [(0.3, 16.0), (0.05, 1.0), (1.0, 500.0)])
def test_boxes_meet_in_cells_once(spark, least, cell):
    rnd = random.Random(6)

    def boxes(n, first):
        out = []
        for i in range(n):
            w, h, x, y = rnd.choice([1, 16, 64, 64, 900]) * rnd.choice([1, 1, 1.5]), rnd.choice([1, 16, 64, 64, 900]), rnd.choice([rnd.uniform(-100, 100), -16.0, 0.0]), rnd.choice([rnd.uniform(-50, 50), 0.0])
            out.append((rnd.choice("kl"), first + i, rnd.randrange(30), (x, y, x + w, y + h)))
        return out + [("k", first + n, 3, (0.0, 0.0, 0.0, 10.0)), ("k", first + n + 1, 3, (None, 0.0, 1.0, 1.0)), (None, first + n + 2, 3, (0.0, 0.0, 64.0, 64.0)), ("k", first + n + 3, 3, None), ("k", first + n + 4, None, (0.0, 0.0, 64.0, 64.0))]

    a, b = boxes(120, 0), boxes(150, 1000)
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    got = association.overlapping(spark.createDataFrame(a, f"k string, seed int, ts int, a {box}"), spark.createDataFrame(b, f"k string, point int, tt int, b {box}"), "k", "ts", "tt", 4, least, cell=cell)
    want = []
    for k, i, t, p in a:
        for m, j, u, q in b:
            if k and k == m and p and q and None not in p + q and t is not None and u is not None and abs(t - u) <= 4:
                both = max(0.0, min(p[2], q[2]) - max(p[0], q[0])) * max(0.0, min(p[3], q[3]) - max(p[1], q[1]))
                if both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both + 1e-6) >= least:
                    want.append((i, j))
    assert rows(got, "seed", "point") == sorted(want) and (want or least == 1)
    assert association.overlapping(spark.createDataFrame([], f"k string, seed int, ts int, a {box}"), spark.createDataFrame(b, f"k string, point int, tt int, b {box}"), "k", "ts", "tt", 4, least).count() == 0
