"""Choosing rows under counts and budgets, fallbacks, pages and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import _keys


def budgeted_top_k(df: DataFrame, key: str | list[str], score: str, k: int, budget, least=None, start: str = "start", end: str = "end", tie: list[str] | None = None) -> DataFrame:
    """The best intervals by score, then length, while they fit the budget; the first that doesn't ends the choice.

    If that is the very first, it is cut to the budget.  Adds ``rank``.
    """
    length = F.col(end) - F.col(start)
    w = Window.partitionBy(*_keys(key)).orderBy(F.desc(score), length.desc(), *(tie or [start]))
    x = df.where(length > 0)
    x = x if least is None else x.where(F.col(score) >= least)
    x = x.withColumn("rank", F.row_number().over(w)).withColumn("__sum", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.where((F.col("rank") <= k) & ((F.col("__sum") <= budget) | (F.col("rank") == 1)))
    return x.withColumn(end, F.when(F.col("rank") == 1, F.least(F.col(end), F.col(start) + budget)).otherwise(F.col(end))).drop("__sum")


def top_per_key(df: DataFrame, key: str | list[str], order: list, n: int = 1, out: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes with a group limit before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*_keys(key)).orderBy(*order))).where(F.col(out) <= n)


def scored_then_rest(df: DataFrame, key: str | list[str], order: list, n: int, score: Column, out: str = "score") -> DataFrame:
    """``score`` for the first ``n`` rows of each key and 0.0 for all others."""
    r = F.row_number().over(Window.partitionBy(*_keys(key)).orderBy(*order))
    return df.withColumn("__r", r).withColumn(out, F.when(F.col("__r") <= n, score).otherwise(0.0)).drop("__r")


def if_empty(first: DataFrame, second: DataFrame, key: str | list[str]) -> DataFrame:
    """All rows of ``first``, and those of ``second`` for keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(*_keys(key)).distinct(), _keys(key), "left_anti"))


def paginate(df: DataFrame, order: list, page: int, limit: int) -> DataFrame:
    """Page ``page`` (from 1) of ``limit`` rows."""
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_counts(df: DataFrame, limit: int) -> DataFrame:
    """total and pages (its quotient by ``limit``, rounded up)."""
    return df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / limit).alias("pages"))


def batches(df: DataFrame, key: str | list[str], order: list, size: int) -> DataFrame:
    """Adds ``batch``: rows of each key in groups of ``size``."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*_keys(key)).orderBy(*order)) - 1) / size))


def zip_by_ordinal(a: DataFrame, b: DataFrame, key: str | list[str], order_a: list, order_b: list) -> DataFrame:
    """Join the n-th row of each key in ``a`` with the n-th in ``b``."""
    keys = _keys(key)
    number = lambda d, o: d.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*o)))
    return number(a, order_a).join(number(b, order_b), [*keys, "ordinal"])


def preview(df: DataFrame, key: str | list[str], order: list, n: int = 6) -> DataFrame:
    """The first ``n`` rows of each key with the number of those that follow (``more``)."""
    w = Window.partitionBy(*_keys(key))
    x = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(w) - n))
    return x.where(F.col("rank") <= n)


def ordered_manifest(df: DataFrame, key: str | list[str], order: str, value: str, out: str = "items") -> DataFrame:
    """Values of each key as one array in order (an ordered concatenation)."""
    return df.groupBy(*_keys(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(out))
