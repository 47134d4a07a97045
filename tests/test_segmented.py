"""Split windows against plain ones, with keys that hold most rows, ties, nulls, and nothing."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidespan.operators import intervals, limits, motion, segmented
from tidespan.streaming import streams


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), i, rnd.choice([rnd.randrange(5000), rnd.randrange(40), rnd.randrange(4000, 4020)]), rnd.randrange(60), rnd.random() < 0.4) for i in range(900)]
    data += [("hot", i, None, 1, True) for i in range(900, 905)] + [("same", i, 77, 5, True) for i in range(905, 960)]
    return spark.createDataFrame(data, "k string, id long, t long, w long, m boolean").repartition(6).cache()


def same(a, b):
    assert a.columns == b.columns
    x, y = (sorted(map(repr, map(tuple, z.collect()))) for z in (a, b))
    assert x == y and x


@pytest.mark.parametrize("n", [25, 10_000])
def test_equal_to_plain_windows(spark, rows, n):
    same(segmented.sessionize(rows, "k", "t", 9, 2, 4, ["id"], rows=n), intervals.sessionize(rows, "k", "t", 9, 2, 4, ["id"]))
    same(segmented.session_ids(rows, ["k"], "t", 9, ["id"], rows=n), intervals.session_ids(rows, ["k"], "t", 9, ["id"]))
    spans = rows.select("k", "id", F.col("t").alias("start"), (F.col("t") + F.col("w")).alias("end"))
    same(segmented.merge_islands(spans, "k", 3, tie=["id"], rows=n), intervals.merge_islands(spans, "k", 3, tie=["id"]))
    same(segmented.cap_total(spans, "k", 700, tie=["id"], rows=n), intervals.cap_total(spans, "k", 700, tie=["id"]))
    number = segmented.numbered(rows, "k", "t", ["id"], "i", rows=n)
    w = Window.partitionBy("k").orderBy("t", "id")
    same(number, rows.where("t is not null").withColumn("i", (F.row_number().over(w) - 1).cast("long")))
    known = number.where("k is not null")
    same(segmented.hysteresis_runs(known, "k", "i", "m", 3, rows=n), motion.hysteresis_runs(known, "k", "i", "m", 3))


def test_ranges_are_even(spark, rows):
    d = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * F.col("id") % 100_003).alias("t"))
    got = segmented.placed(d, "k", "t", segmented.ranges(d, "k", "t", 1000)).groupBy("__range").count().collect()
    assert 15 <= len(got) <= 22 and max(r["count"] for r in got) < 3000
    assert segmented.ranges(d.limit(1500), "k", "t", 1000) is None


@pytest.mark.parametrize("n,cases", [(10, ((2, 25), (1, 0))), (10_000, ((5, 900),))])
def test_limiter_equals_the_one_task_form(spark, rows, n, cases):
    d = rows.where("t is not null").select("k", "id", "t")
    for limit, window in cases:
        same(limits.rate_limited(d, "k", "t", "id", limit, window, rows=n), streams.rate_limited(d.fillna("none", ["k"]), "k", "t", "id", limit, window).withColumn("k", F.when(F.col("k") != "none", F.col("k"))))


def test_limiter_with_repeated_rows_and_no_time(spark):
    d = spark.createDataFrame([("a", 1, 5)] * 4 + [("a", 2, None), ("a", 3, 30), (None, 1, 9)], "k string, id int, t long")
    got = limits.rate_limited(d, "k", "t", "id", 3, 10, rows=2).collect()
    assert sorted((str(r.k), r.id, str(r.allowed)) for r in got) == sorted([("a", 1, "True")] * 3 + [("a", 1, "False"), ("a", 2, "None"), ("a", 3, "True"), ("None", 1, "True")])


def test_nothing(spark, rows):
    none = rows.where("false")
    assert segmented.sessionize(none, "k", "t", 9, rows=10).count() == 0
    assert segmented.cap_total(none.select("k", F.col("t").alias("start"), F.col("w").alias("end")), "k", 9, rows=10).count() == 0
    assert limits.rate_limited(none.select("k", "id", "t"), "k", "t", "id", 2, 5).count() == 0
