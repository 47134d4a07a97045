"""Exact token-length histogram and what follows from it for every context limit."""

from __future__ import annotations

import base64
import functools
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


@functools.lru_cache(2)
def ranks_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs) for every encoded length that occurs.

    Lengths are counted in the worker and partly summed there, so what is shuffled has at most as many rows as there are
    different lengths per task.  A null text is no document and is left out; an empty one has length 0.
    """

    def run(batches):
        enc, seen = ranks_encoding(ranks_path, pattern), Counter()
        for batch in batches:
            for x in batch.column(0):
                if (t := x.as_py()) is not None:
                    seen[len(enc.encode_ordinary(t))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n"])

    return docs.select(text).mapInArrow(run, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def totals(histogram: DataFrame) -> DataFrame:
    """Per length: documents and tokens up to and beyond it, and the tokens that are left if each document is cut there.

    Columns: n_tokens, n_docs, docs_longer (strictly), tokens_longer, docs_to (this length and below), tokens_to,
    tokens_if_cut (sum of min(length, n_tokens)), quantile (docs_to / all documents).  All sums are integers.  For a limit
    between two lengths, ``at_limit`` gives the same figures.  The running sums go over distinct lengths, not documents: ranges of
    lengths are summed first and only their totals (as many rows as the square root of the greatest length) meet in one task.  The histogram is used twice and
    written first (as many rows as there are lengths), so that no document is encoded twice.
    """
    histogram = common.materialize(histogram.select("n_tokens", "n_docs"), "lengths")
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("w"), F.floor(F.sqrt("n_tokens")).cast("long").alias("band"))
    bands = h.groupBy("band").agg(F.sum("n_docs").alias("bd"), F.sum("w").alias("bw"))
    # Lengths between k*k and (k+1)**2 are one band, so there are few bands even where single texts are huge.
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select("band", F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("bw").over(before), F.lit(0)).alias("w0"), F.sum("bd").over(total).alias("d1"), F.sum("bw").over(total).alias("w1"))
    within = Window.partitionBy("band").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    x = h.join(bands, "band").select("n_tokens", "n_docs", (F.sum("n_docs").over(within) + F.col("d0")).alias("docs_to"), (F.sum("w").over(within) + F.col("w0")).alias("tokens_to"), "d1", "w1")
    longer, more = F.col("d1") - F.col("docs_to"), F.col("w1") - F.col("tokens_to")
    return x.select("n_tokens", "n_docs", longer.alias("docs_longer"), more.alias("tokens_longer"), "docs_to", "tokens_to", (F.col("tokens_to") + longer * F.col("n_tokens")).alias("tokens_if_cut"), (F.col("docs_to") / F.col("d1")).alias("quantile"))


def at_limit(summary: DataFrame, limit: int) -> DataFrame:
    """docs_longer, tokens_longer and tokens_if_cut for any context limit; one row, zeros for an empty summary."""
    longer = F.col("n_tokens") > limit
    cut = F.when(longer, F.lit(limit)).otherwise(F.col("n_tokens")) * F.col("n_docs")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return summary.agg(zero(F.sum(F.when(longer, F.col("n_docs")))).alias("docs_longer"), zero(F.sum(F.when(longer, F.col("n_tokens") * F.col("n_docs")))).alias("tokens_longer"), zero(F.sum(cut)).alias("tokens_if_cut"))


def quantile(summary: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share ``q`` of documents does not exceed (null without documents)."""
    return summary.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
