"""Stateful streams equal the batch operators over several micro-batches, out of order, and over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from tidespan.operators import limits, motion
from tidespan.streaming import stateful


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.enable(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, make, schema, path, out, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/*")
    make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def waves(rows, n, spread, seed):
    """Rows in about the order of time, in ``n`` batches; none comes later than ``spread`` after its time."""
    rnd = random.Random(seed)
    late = sorted(rows, key=lambda r: r[-1] + rnd.randrange(spread))
    size = -(-len(late) // n)
    return [late[i : i + size] for i in range(0, len(late), size)]


def test_limiter(rocks, tmp_path):
    spark, rnd = rocks, random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", "c"]), i, rnd.randrange(3000)) for i in range(150)] + [("a", 150 + i, 500) for i in range(5)]
    d = spark.createDataFrame(rows, "k string, id long, s long")
    timed = d.withColumn("ts", F.timestamp_seconds("s"))
    batches = waves(rows, 5, 100, 1)
    end = [("end", -1, 10_000_000), ("end", -2, 20_000_000)]
    write = lambda i, rows: spark.createDataFrame(rows, d.schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    make = lambda s: stateful.limited(s, "k", "ts", "id", 3, 200_000_000, "150 seconds")
    for i, b in enumerate(batches[:3]):
        write(i, b)
    run(spark, make, timed.schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    for i, b in enumerate([*batches[3:], end[:1], end[1:]], 3):
        write(i, b)
    run(spark, make, timed.schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.key, r.us // 1_000_000, r.tie, r.allowed) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.key != "end")
    want = limits.rate_limited(d, "k", "s", "id", 3, 200)
    assert got == sorted((r.k, r.s, r.id, r.allowed) for r in want.collect())
    assert {g[3] for g in got} == {True, False}


def test_hysteresis(rocks, tmp_path):
    spark, rnd = rocks, random.Random(7)
    rows = [(k, i, rnd.random() < 0.3, 10 * i + 3) for k, n in (("a", 60), ("b", 25), ("c", 1), ("d", 40)) for i in range(n)]
    d = spark.createDataFrame(rows, "k string, i long, moving boolean, s long")
    timed = d.withColumn("ts", F.timestamp_seconds("s"))
    batches = [*waves(rows, 4, 40, 2), [("end", 0, False, 10_000_000)], [("end", 1, False, 20_000_000)]]
    make = lambda s: stateful.runs(s, "k", "ts", "i", "moving", 2, "60 seconds", 3_600_000_000)
    for start, some in ((0, batches[:2]), (2, batches[2:])):
        for i, b in enumerate(some, start):
            spark.createDataFrame(b, d.schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        run(spark, make, timed.schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.key != "end"]
    want = motion.hysteresis_runs(d, "k", "i", "moving", 2).select("k", "first", "last", "closed").collect()
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in want) and any(r.closed is None for r in want)
