"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a folder of this driver's, which only a local master can use."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        at = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="tidespan-"))
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a parquet table that is read again: what comes after does not depend on how it was made."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote; neither these frames nor others made from them can be read any more."""
    for df in frames:
        if path := getattr(df, "_written", None):
            jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jvm, True)
