"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table
from .oracles import ORACLE_SQL  # noqa: F401

TOKENIZERS = os.environ.get("TIDESPAN_TOKENIZERS", "/opt/tokenizers")
#: The split pattern of the public byte-level vocabulary (a fixed value of that vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", check="round_trip")
    return out.select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"), "round_trip")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score

    out = score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_join import links

    return links(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import length_histogram, totals

    docs = table(spark, sf_dir, "documents")
    return totals(length_histogram(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, lexicon, out="score")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import matches

    out = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "start", "n_words", "similarity")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import components

    return components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gam import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, out="score")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ptolemaic_kmeans import clusters

    return clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dim=64, salt="3:")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import detect, listed, strongest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    # A tenth of the documents gets a planted repeat: from word a on, the p words from there over and over.
    n, a, p = (F.col(c) for c in "nap")
    some = docs.where((h % 10 == 0) & (F.size(words) > 0)).select("doc_id", words.alias("w"), g.alias("g")).withColumn("n", F.size("w")).withColumn("a", F.col("g") % n).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
    rest = docs.where(~F.coalesce((h % 10 == 0) & (F.size(words) > 0), F.lit(False)))
    found = detect(rest.unionByName(some.select("doc_id", F.array_join(planted, " ").alias("text"))))
    best = strongest("runs")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed("runs").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_topk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_lists import search

    return search(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_pitman_yor, op3_substring_dedup, op4_vector_join, op5_language_id, op6_token_counts, op7_toxicity, op8_decontamination, op9_jaccard_join, op10_quality, op11_centroids, op12_periodic_runs, op13_topk_lists)}
