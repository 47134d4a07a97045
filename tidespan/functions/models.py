"""Model calls as batch functions: the model is loaded once per worker process and given whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def apply_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """``load()`` gives a function of a batch; it runs once per task's iterator.  Rows where the model fails are the function's matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)


def scored_or_zero(call: Callable[[bytes], str]) -> Callable[[pd.Series], pd.Series]:
    """Wrap a scorer of one item so that a failure gives an empty text (which ``score_json`` reads as 0.0)."""

    def safe(x) -> str:
        try:
            return call(x)
        except Exception:
            return ""

    return lambda s: s.map(safe)


def train_head(df: DataFrame, vector: str, label: str, ridge: float = 0.01, rounds: int = 50):
    """A linear head on pooled vectors (array column): multinomial logistic regression, trained where the rows are."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(regParam=ridge, maxIter=rounds).fit(x)


def apply_head(df: DataFrame, model, vector: str, out: str = "predicted") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    return scored.withColumn(out, F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def save_checkpoint(spark: SparkSession, path: str, epoch: int, score: float, weights: bytes, labels: list[str]) -> None:
    """Append one model state; ``best_checkpoint`` picks among them."""
    spark.createDataFrame([(epoch, score, weights, labels)], "epoch int, score double, weights binary, labels array<string>").write.mode("append").parquet(path)


def best_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The state of the highest score; of equal ones the earliest epoch."""
    return spark.read.parquet(path).orderBy(F.desc("score"), "epoch").limit(1)


#: The settings of the models that a detection uses; the detector's confidence is the request's.
MODEL_SETTINGS = {
    "detector": {"model": "yolov8x.pt", "classes": [0], "tracking": True},
    "landmarks": {"pose": True, "face": True, "hands": False, "holistic": False},
    "face": {"model": "FaceNet", "distance_metric": "cosine", "enforce_detection": False},
    "appearance": {"model": "osnet_x1_0", "max_dist": 0.6, "min_confidence": 0.3},
}


def model_settings(confidence):
    """A struct of the settings of each model, for a request's confidence threshold."""
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    part = lambda name, more=(): F.struct(*(value(v).alias(k) for k, v in MODEL_SETTINGS[name].items()), *more).alias(name)
    return F.struct(part("detector", (confidence.alias("confidence"),)), *(part(n) for n in MODEL_SETTINGS if n != "detector"))


def detections(frames: DataFrame, load: Callable[[], Callable[[list], list]], content: str, out: str = "boxes", fields: str = "x1 double, y1 double, x2 double, y2 double, cls int, conf double") -> DataFrame:
    """Adds ``out``, an array of boxes, by a detector of frames.

    ``load()`` gives a function of a list of contents that returns a list of lists of tuples; it is loaded once for each task and sees a batch at a time.  A batch that fails is tried frame by frame, and a frame that
    fails has no boxes; a null content has none either.
    """
    kind = f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>>"
    names = [f.split()[0] for f in fields.split(",")]

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detect = load()

        def one(x) -> list:
            try:
                return detect([x])[0]
            except Exception:
                return []

        for b in batches:
            some = b[b.notna()]
            try:
                found = detect(list(some))
            except Exception:
                found = [one(x) for x in some]
            boxes = dict(zip(some.index, found))
            yield pd.Series([[dict(zip(names, box)) for box in boxes.get(i, [])] for i in b.index], b.index)

    return frames.withColumn(out, run(F.col(content)))


def read_texts(crops: DataFrame, load: Callable[[], Callable[[object], list[str]]], content: str, every: int, sample: str, out: str = "texts") -> DataFrame:
    """Adds ``out``, the texts that a reader finds on each crop of every ``every``-th sample; none on other samples, on a null crop, and where the reader fails."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = load()

        def one(x) -> list:
            try:
                return [str(t) for t in read(x)]
            except Exception:
                return []

        for b in batches:
            yield pd.Series([[] if x is None else one(x) for x in b], b.index)

    now = F.col(content).isNotNull() & (F.col(sample) % every == 0)
    # Rows that aren't read go around the reader.
    some = crops.where(now).withColumn(out, run(F.col(content)))
    return some.unionByName(crops.where(~F.coalesce(now, F.lit(False))).withColumn(out, F.array().cast("array<string>")))


def scored(df: DataFrame, load: Callable[[], Callable[[object], str]], content: str, out: str = "answer") -> DataFrame:
    """Adds the answer of a remote scorer as text, empty where it fails or the content is null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = load()

        def one(x) -> str:
            try:
                return "" if x is None else call(x)
            except Exception:
                return ""

        for b in batches:
            yield pd.Series([one(x) for x in b], b.index)

    return df.withColumn(out, run(F.col(content)))
