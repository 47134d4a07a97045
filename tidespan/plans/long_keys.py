"""Queries over keys that hold all rows, or a third of them: ``documents`` as one long stream of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import limits, segmented
from ..sources import tables

#: Rows of a range here, so that small tables are cut too; ``segmented.ROWS`` is the library's own.
ROWS = 400
GAP, REACH, CAP, STILL, LIMIT, SPAN = 1500, 40, 60_000, 2, 3, 9_000
DOCS = """d as (select doc_id, substring(source, 1, 3) as stream, doc_id * 1000 + n_chars * 7919 % 5000 as t, n_chars % 1800 as w, n_chars % 3 <> 0 as moving, case when doc_id % 3 = 0 then -1 else doc_id // 50 end as part from documents)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars").cast("long")
    t = F.col("doc_id") * 1000 + n * 7919 % 5000
    return tables.read(spark, d, "documents").select("doc_id", F.substring("source", 1, 3).alias("stream"), t.alias("t"), (n % 1800).alias("w"), (n % 3 != 0).alias("moving"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.expr("doc_id div 50")).alias("part"))


def long_sessions(spark, d):
    return segmented.sessionize(_docs(spark, d), "stream", "t", GAP, 200, 400, ["doc_id"], rows=ROWS)


def long_islands(spark, d):
    x = _docs(spark, d).select("stream", "doc_id", F.col("t").alias("start"), (F.col("t") + F.col("w")).alias("end"))
    return segmented.merge_islands(x, "stream", REACH, tie=["doc_id"], rows=ROWS)


def long_cap(spark, d):
    """A third of all rows have one key, the others keys of their own."""
    x = _docs(spark, d).select("part", "doc_id", F.col("t").alias("start"), (F.col("t") + F.col("w")).alias("end"))
    return segmented.cap_total(x, "part", CAP, tie=["doc_id"], rows=ROWS).select("part", "doc_id", "start", F.col("end").cast("long").alias("end"))


def long_runs(spark, d):
    x = segmented.numbered(_docs(spark, d), "stream", "t", ["doc_id"], "i", rows=ROWS)
    return segmented.hysteresis_runs(x, "stream", "i", "moving", STILL, rows=ROWS)


def long_rate_limit(spark, d):
    return limits.rate_limited(_docs(spark, d).select("stream", "doc_id", "t"), "stream", "t", "doc_id", LIMIT, SPAN, rows=ROWS)


QUERIES = {f.__name__: f for f in (long_sessions, long_islands, long_cap, long_runs, long_rate_limit)}
ORACLE_SQL = {
    "long_sessions": f"""with {DOCS}, x as (select *, case when t - lag(t) over (partition by stream order by t, doc_id) > {GAP} then 1 else 0 end as n from d),
 y as (select *, sum(n) over (partition by stream order by t, doc_id rows unbounded preceding) as g from x) select stream, greatest(0, min(t) - 200) as start, max(t) + 400 as "end", count(*) as n from y group by stream, g""",
    "long_islands": f"""with {DOCS}, x as (select *, case when t <= max(t + w) over (partition by stream order by t, doc_id rows between unbounded preceding and 1 preceding) + {REACH} then 0 else 1 end as n from d),
 y as (select *, sum(n) over (partition by stream order by t, doc_id rows unbounded preceding) as g from x) select stream, min(t) as start, max(t + w) as "end", count(*) as n from y group by stream, g""",
    "long_cap": f"""with {DOCS}, p as (select *, coalesce(sum(w) over (partition by part order by t, doc_id rows between unbounded preceding and 1 preceding), 0) as p from d where w > 0)
 select part, doc_id, t as start, cast(least(t + w, t + ({CAP} - p)) as bigint) as "end" from p where p < {CAP}""",
    "long_runs": f"""with {DOCS}, r as (select *, row_number() over (partition by stream order by t, doc_id) - 1 as i from d), l as (select stream, max(i) as last_i from r group by stream),
 m as (select *, case when i - lag(i) over (partition by stream order by i) > {STILL} then 1 else 0 end as b from r where moving), g as (select *, sum(b) over (partition by stream order by i rows unbounded preceding) as g from m),
 q as (select stream, min(i) as first, max(i) as last from g group by stream, g) select stream, first, last, case when last + {STILL} <= last_i then last + {STILL} end as closed from q join l using (stream)""",
    "long_rate_limit": f"""with recursive {DOCS}, r as (select stream, doc_id, t, row_number() over (partition by stream order by t, doc_id) as i from d),
 w(stream, doc_id, i, n, upto, allowed) as (select stream, doc_id, i, 1, t + {SPAN}, true from r where i = 1 union all
 select r.stream, r.doc_id, r.i, case when r.t > upto then 1 when n >= {LIMIT} then n else n + 1 end, case when r.t > upto then r.t + {SPAN} else upto end, r.t > upto or n < {LIMIT} from w join r on r.stream = w.stream and r.i = w.i + 1)
 select stream, doc_id, t, allowed from w join d using (stream, doc_id)""",
}
