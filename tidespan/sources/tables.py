"""Readers and writers: the parquet tables, label lines, manifests, files, and an append-only log."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
#: A dataset row: one captured clip.
CLIP = T.StructType([T.StructField("clip_path", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
MANIFEST = T.StructType([T.StructField("video_path", T.StringType()), T.StructField("segments", T.ArrayType(T.StructType([T.StructField("clip", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("thumbs", T.ArrayType(T.StringType())), T.StructField("label", T.StringType())]))), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
JOB = T.StructType([T.StructField(n, T.DoubleType() if n in ("download_percent", "progress", "created_at", "updated_at") else T.StringType(), n != "id") for n in ("id", "status", "stage", "message", "download_percent", "progress", "output_url", "output_path", "request_json", "result_json", "error", "created_at", "updated_at")])


def reachable(spark: SparkSession) -> None:
    """Python workers that start from now on can import this package, wherever they run from."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a detection stream: us (micros), cents (value in hundredths) and k (the score in props) as whole numbers."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Clip lines; malformed ones are skipped."""
    return spark.read.schema(CLIP).option("mode", "DROPMALFORMED").json(path).where(F.col("clip_path").isNotNull())


def append_labels(df: DataFrame, path: str) -> None:
    df.select(*(F.col(f.name).cast(f.dataType) for f in CLIP.fields)).write.mode("append").json(path)


def write_manifest(df: DataFrame, key: str, path: str) -> None:
    """One JSON document per key with its segments in order of start, and its ``meta`` (a map; that of the first segment that has one) if ``df`` has such a column."""
    s = F.array_sort(F.collect_list(F.struct("start", "end", "clip", "thumbs", "label")))
    meta = [F.min_by("meta", F.struct(F.col("meta").isNull(), "start", "end")).alias("meta")] if "meta" in df.columns else []
    df.groupBy(F.col(key).alias("video_path")).agg(s.alias("segments"), *meta).select(F.to_json(F.struct("video_path", "segments", *(["meta"] if meta else []))).alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path).select("video_path", F.explode_outer("segments").alias("s")).select("video_path", "s.*")


def files(spark: SparkSession, path: str, glob: str = "*", least: int = 0) -> DataFrame:
    """path, length and modificationTime of files by prefix; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime").where(F.col("length") > least)


def encoded(df: DataFrame, content: str = "content", out: str = "base64") -> DataFrame:
    return df.withColumn(out, F.base64(content))


def existing(rows: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Rows whose file is listed."""
    return rows.join(listing.select(F.col("path").alias(path)), path, "left_semi")


def duration_of(videos: DataFrame, total_frames: str = "total_frames", fps: str = "fps") -> DataFrame:
    """Adds fps (30 where it is missing or not positive) and duration; null, not 0, where it can't be known."""
    rate = F.when(F.col(fps) > 0, F.col(fps)).otherwise(30.0)
    return videos.withColumn(fps, rate).withColumn("duration", F.col(total_frames) / rate)
