"""A training corpus in five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as parquet and read
again as the next one's docs.  All but the last return the columns of documents (others that the table has, whatever their names, go along).  Rows without an id
and rows with a null or empty text are kept by the filters; texts of any length are read whole; empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.llm import common, decontamination, jaccard_join, sentencepiece_codec, substring_dedup, toxicity
from tidespan.llm.queries import TOKENIZERS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go.  The lexicon learns from the labels of these documents (of several labels of an id, a toxic one counts); without labels nothing goes."""
    common.reachable(spark)
    lexicon = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, out="__toxicity").where("`__toxicity` < 0.3").drop("__toxicity")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach each other by links of 0.8 over five-word shingles, the one of smallest id stays; of rows with one id, the one of least text."""
    common.reachable(spark)
    found = common.materialize(jaccard_join.components(docs, k=5, percent=80).where("doc_id is not null"), "groups")
    away = found.where("component_id <> doc_id").select("doc_id").distinct()
    again = found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), "text").alias("r"), F.first(F.struct(*docs.columns)).alias("f"))
    one = one.select(F.coalesce("r", "f").alias("r")).select("r.*")  # all texts null: any of the rows
    return docs.join(away.union(again), "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document of smaller id has go from the text; documents of which nothing is left go too."""
    common.reachable(spark)
    out = substring_dedup.dedup(docs, texts=True)
    out = out.where("n_removed = 0 or text <> ''")
    return out.select(*(F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (five-word shingles, 0.8) go."""
    hits = decontamination.matches(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, n_tokens, and whether decoding them gives the text back."""
    common.reachable(spark)
    out = sentencepiece_codec.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", check="round_trip")
    return out.withColumn("n_tokens", F.size("token_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: SQL can't express the learnt lexicon, recompression's texts on whole tables or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns goes through parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), re.sub(r"\W", "", name))
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
