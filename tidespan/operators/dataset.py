"""Building labelled datasets, their splits and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capture(df: DataFrame, key: str, order: list, start: str, end: str, most: int = 25, least=2.5, longest=10) -> DataFrame:
    """The first ``most`` segments of each key; of those, ones of at least ``least``, cut to ``longest``."""
    w = Window.partitionBy(key).orderBy(*order)
    x = df.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= most).where(F.col(end) - F.col(start) >= least)
    return x.withColumn(end, F.least(F.col(end), F.col(start) + longest))


def labelled(df: DataFrame, label: str, path: str) -> DataFrame:
    """Rows with a label and a path."""
    return df.where((F.coalesce(F.col(label), F.lit("")) != "") & (F.coalesce(F.col(path), F.lit("")) != ""))


def label_index(df: DataFrame, label: str) -> DataFrame:
    """(label, label_index): distinct labels numbered from 0 in order.  The window holds distinct labels only."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("label_index", F.row_number().over(Window.orderBy(label)) - 1)


def split(df: DataFrame, key: str, validation: float, test: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: a seeded shuffle, of which int(n * validation) and int(n * test) rows are set aside and the rest is train.

    Ranks come from a distributed sort: rows are counted in 65,536 hash ranges, whose running counts are a small table.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    x = df.withColumn("__h", h).withColumn("__band", F.shiftrightunsigned(F.col("__h"), 48))
    bands = x.groupBy("__band").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select("__band", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"), F.sum("__c").over(whole).alias("__n"))
    x = x.join(bands, "__band").withColumn("__r", F.row_number().over(Window.partitionBy("__band").orderBy("__h", key)) + F.col("__b"))
    v, t = F.floor(F.col("__n") * validation), F.floor(F.col("__n") * test)
    return x.withColumn("split", F.when(F.col("__r") <= v, "validation").when(F.col("__r") <= v + t, "test").otherwise("train")).drop("__h", "__band", "__b", "__n", "__r")


def metrics(df: DataFrame, by: list[str], predicted: Column, actual: Column, loss: Column, weight: Column) -> DataFrame:
    """Weighted mean loss and accuracy, 0 for no rows."""
    n = F.sum(weight)
    return df.groupBy(*by).agg((F.sum(loss * weight) / F.greatest(F.lit(1), n)).alias("loss"), (F.sum(F.when(predicted == actual, weight).otherwise(0)) / F.greatest(F.lit(1), n)).alias("accuracy"))


def running_best(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Adds ``best`` (the greatest value so far, at least 0) and ``improved`` (strictly above all before)."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.greatest(F.lit(0.0), F.coalesce(F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return df.withColumn("best", F.greatest(before, value)).withColumn("improved", F.col(value) > before)


def mean_pool(df: DataFrame, by: str, vector: str, scale: int = 9) -> DataFrame:
    """(by, dim, mean): the mean of each dimension; partial sums before the shuffle."""
    return df.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.round(F.avg(F.col("x").cast("double")), scale).alias("mean"))


def sample_positions(n: int, total: Column) -> Column:
    """``n`` evenly spaced positions int(i*T/n + T/(2n)); beyond the last one it repeats."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(total - 1, F.floor(i * total / n + total / (2 * n))))


def argmax(scores: Column) -> Column:
    """Position (from 0) of the first greatest value."""
    return F.array_position(scores, F.array_max(scores)) - 1
