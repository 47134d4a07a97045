"""Reading tables, shared-folder checkpoints, hashed splits and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of ``sf_dir``; Python workers started afterwards can import this package."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reachable(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); one of our own only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        at = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="tidespan-"))
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` as parquet into the shared folder and read it again with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; neither it nor frames made from it can be read any more."""
    if path := getattr(df, "_written", None):
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def one_of_each(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each of ``keys``, with its text of least hash (null if all are): tasks keep one text each, so a key that is repeated is not gathered."""
    return rows.groupBy(*keys).agg(F.min_by(text, F.struct(F.xxhash64(text), F.col(text))).alias(text))


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of frames that are no longer referenced.

    Without it their files stay until the JVM happens to collect its garbage, which on a large driver heap can be after the job.
    """
    for _ in range(3):  # Python's references, then those of the JVM's objects that they held, then what the cleaner has queued
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the scan below ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable, for every node with a link.

    Alternates large-star and small-star rounds, each a shuffle on the node, until every link hangs from the root of its star; links that
    are stars already take no round.  Edges stay distributed, and the number of rounds grows with the logarithm of the longest chain.  Hot nodes are
    pre-aggregated by the partial ``min``; the minima of the large stars are written before they are joined, so that both sides of that join are plain shuffles and
    adaptive execution can split a hot node's edges (small stars join on their far nodes, which have few edges).  Each round replaces an edge by at most one, so the edge list never grows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, "cc")
    for _ in range(max_rounds):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.agg(F.max(F.col("up") + F.col("down"))).first()[0] in (None, 1):  # a node hangs from one other, or is a root
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc")
        # large star: neighbours above the node hang from the smallest neighbour
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and its neighbours below hang from the smallest of them
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = materialize(small, "cc")
        for x in (e, low):
            discard(x)
        e = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
