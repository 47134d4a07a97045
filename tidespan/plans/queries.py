"""Registered queries of the interval engine over the stand-in tables, each with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, models, scalar, vision
from ..operators import association, dataset, intervals, jobs, motion, select, tracks
from ..sources import clips, tables
from ..streaming import streams
from . import long_keys, media, pipelines, tracked

HOUR = 3_600_000_000
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
EV = """ev as (select event_id, user_id, event_type, value, epoch_us(ts) as us, cast(round(value * 100) as bigint) as cents,
 cast(json_extract_string(props, '$.k') as integer) as k from events)"""
#: cents of value as hours of length: hundredths of an hour in micros.
CENT = HOUR // 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).select("event_id", "user_id", F.col("us").alias("start"), (F.col("us") + F.col("cents") * CENT).alias("end"), "k", "event_type")


SPANS = f"{EV}, sp as (select event_id, user_id, us as s, us + cents * {CENT} as e, k, event_type from ev)"
E1 = f"""x as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) > {6 * HOUR} then 1 else 0 end as n from ev),
 y as (select *, sum(n) over (partition by user_id order by us, event_id rows unbounded preceding) as g from x)"""


@query(f"with {EV}, {E1} select user_id, min(us) as start, max(us) as \"end\", count(*) as n from y group by user_id, g")
def sessionize_gap(spark, d):
    return intervals.sessionize(tables.events(spark, d), "user_id", "us", 6 * HOUR, tie=["event_id"])


BASE_US = 1_704_067_200_000_000


@query(f"""with {EV}, {E1}, s as (select user_id, greatest(0, min(us) - {2 * HOUR}) as s, max(us) + {4 * HOUR} as e from y group by user_id, g),
 c as (select user_id, greatest(0, s) as s, least({BASE_US + 400 * 24 * HOUR}, e) as e from s where e > 0),
 p as (select *, coalesce(sum(e - s) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding), 0) as p from c where e > s),
 q as (select user_id, s, least(e, s + ({200 * HOUR} - p)) as e from p where p < {200 * HOUR})
 select user_id, count(*) as segments, cast(sum(e - s) as double) / 1000000 as total, cast(sum(e - s) as double) / 1000000 / count(*) as average,
 cast(sum(e - s) as double) / 1000000 / 1000000.0 * 100 as efficiency, greatest(1, cast(trunc(count(*) * 0.8::double) as integer)) as balls from q group by user_id""")
def session_pipeline(spark, d):
    """Sessions, padded, clamped, capped, and summed up for each user (the flagship)."""
    s = intervals.sessionize(tables.events(spark, d), "user_id", "us", 6 * HOUR, 2 * HOUR, 4 * HOUR, ["event_id"])
    capped = intervals.cap_total(intervals.clamp(s, BASE_US + 400 * 24 * HOUR), "user_id", 200 * HOUR)
    out = intervals.session_stats(capped, "user_id", F.lit(1000000.0))
    total = F.col("total").cast("double") / 1000000
    return out.select("user_id", "segments", total.alias("total"), (total / F.col("segments")).alias("average"), (total / 1000000.0 * 100).alias("efficiency"), "balls")


@query(f"""with {SPANS}, x as (select *, case when s <= max(e) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) + {HOUR} then 0 else 1 end as n from sp),
 y as (select *, sum(n) over (partition by user_id order by s, event_id rows unbounded preceding) as g from x) select user_id, min(s) as start, max(e) as "end", count(*) as n from y group by user_id, g""")
def merge_islands(spark, d):
    return intervals.merge_islands(_spans(spark, d), "user_id", HOUR, tie=["event_id"])


@query(f"""with {SPANS} select event_id, greatest({BASE_US}, s) as start, least({BASE_US + 30 * 24 * HOUR}, e) as "end" from sp where e > {BASE_US}""")
def clamp_segments(spark, d):
    s = _spans(spark, d).select("event_id", (F.col("start") - BASE_US).alias("start"), (F.col("end") - BASE_US).alias("end"))
    return intervals.clamp(s, 30 * 24 * HOUR).select("event_id", (F.col("start") + BASE_US).alias("start"), (F.col("end") + BASE_US).alias("end"))


@query(f"""with {SPANS}, p as (select *, coalesce(sum(e - s) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding), 0) as p from sp where e > s)
 select event_id, user_id, s as start, least(e, s + ({300 * HOUR} - p)) as "end" from p where p < {300 * HOUR}""")
def cap_total(spark, d):
    return intervals.cap_total(_spans(spark, d), "user_id", 300 * HOUR, tie=["event_id"]).select("event_id", "user_id", "start", F.col("end").cast("long").alias("end"))


@query(f"""with {SPANS}, x as (select *, row_number() over (partition by user_id order by k desc, e - s desc, event_id) as r, sum(e - s) over (partition by user_id order by k desc, e - s desc, event_id rows unbounded preceding) as c from sp where k >= 30 and e > s)
 select event_id, user_id, s as start, case when r = 1 then least(e, s + {120 * HOUR}) else e end as "end", r as rank from x where r <= 10 and (c <= {120 * HOUR} or r = 1)""")
def budget_topk(spark, d):
    out = select.budgeted_top_k(_spans(spark, d), "user_id", "k", 10, 120 * HOUR, 30, tie=["event_id"])
    return out.select("event_id", "user_id", "start", "end", "rank")


@query(f"""with {EV}, r as (select user_id, event_id, cents > 5000 as moving, row_number() over (partition by user_id order by us, event_id) - 1 as i from ev),
 n as (select user_id, max(i) as last_i from r group by user_id), m as (select *, case when i - lag(i) over (partition by user_id order by i) > 3 then 1 else 0 end as b from r where moving),
 g as (select *, sum(b) over (partition by user_id order by i rows unbounded preceding) as g from m), q as (select user_id, min(i) as first, max(i) as last from g group by user_id, g)
 select user_id, first, last, case when last + 3 <= last_i then last + 3 end as closed from q join n using (user_id)""")
def hysteresis_runs(spark, d):
    from pyspark.sql import Window

    e = tables.events(spark, d)
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1).cast("long")
    return motion.hysteresis_runs(e.select("user_id", (F.col("cents") > 5000).alias("moving"), i.alias("i")), "user_id", "i", "moving", 3)


@query(f"""with {EV}, x as (select *, count(*) over (partition by user_id) as n, abs(cents - lag(cents) over (partition by user_id order by us, event_id)) as dist,
 greatest(1, us - lag(us) over (partition by user_id order by us, event_id)) as dt from ev) select event_id, user_id, us, cast(dist as double) as distance from x where n >= 3 and dist >= 300 and cast(dist as double) / dt >= 0.0000001""")
def velocity_filter(spark, d):
    e = tables.events(spark, d).withColumn("zero", F.lit(0))
    return motion.velocity_filter(e, "user_id", "us", "cents", "zero", 0.0000001, 300, 1, tie=["event_id"]).select("event_id", "user_id", "us", "distance")


TOL = 2 * HOUR


@query(f"""with {EV}, a as (select user_id, event_id as seed, us as ts from ev where event_type = 'click'), b as (select user_id, k % 10 as track, us as tt, event_id as point from ev where event_type = 'view'),
 v as (select a.user_id, track, count(distinct seed) as votes, min(seed) as first_seed from a join b on a.user_id = b.user_id and abs(ts - tt) <= {TOL} group by a.user_id, track),
 r as (select *, row_number() over (partition by user_id order by votes desc, first_seed, track) as r from v) select user_id, track, votes, first_seed from r where r = 1""")
def interval_vote(spark, d):
    e = tables.events(spark, d)
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("seed"), F.col("us").alias("ts"))
    b = e.where("event_type = 'view'").select("user_id", (F.col("k") % 10).alias("track"), F.col("us").alias("tt"))
    return association.elect(association.votes(association.within(a, b, "user_id", "ts", "tt", TOL), "user_id", "seed", "track", "seed"), "user_id", "track")


@query("""with x as (select vec_id, label, embedding, lag(embedding) over (partition by label order by vec_id) as b from embeddings)
 select vec_id, label, cast(len(list_filter(range(1, len(embedding) + 1), lambda i: abs(cast(embedding[i] as double) - cast(b[i] as double)) > 0.2)) as double) / len(embedding) as changed from x where b is not null""")
def frame_diff(spark, d):
    e = tables.read(spark, d, "embeddings").withColumn("cells", F.transform("embedding", lambda x: x.cast("double")))
    return motion.frame_diff(e, ["label"], "vec_id", "cells", 0.2).select("vec_id", "label", "changed")


@query("""select label, cast(i - 1 as integer) as dim, round(avg(cast(embedding[i] as double)), 6) as mean from embeddings, range(1, 65) t(i) group by label, i""")
def mean_pool_centroid(spark, d):
    return dataset.mean_pool(tables.read(spark, d, "embeddings"), "label", "embedding", 6).withColumnRenamed("pos", "dim")


@query(f"""with {EV}, r as (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) as rank from ev) select event_id, user_id, event_type, value from r where rank = 1""")
def top1_per_key(spark, d):
    return select.top_per_key(tables.events(spark, d), ["user_id", "event_type"], [F.desc("value"), "event_id"]).select("event_id", "user_id", "event_type", "value")


@query(f"""with {EV}, r as (select *, row_number() over (partition by user_id order by us, event_id) as r from ev) select event_id, case when r <= 40 then k / 100.0::double else 0.0::double end as score from r""")
def scored_then_rest(spark, d):
    return select.scored_then_rest(tables.events(spark, d), "user_id", ["us", "event_id"], 40, F.col("k") / 100.0).select("event_id", "score")


@query("""with n as (select count(*) as n from labels) select 'validation' as split, cast(floor(n * 0.1::double) as bigint) as rows from n union all select 'test', cast(floor(n * 0.2::double) as bigint) from n
 union all select 'train', n - cast(floor(n * 0.1::double) as bigint) - cast(floor(n * 0.2::double) as bigint) from n""")
def split_sizes(spark, d):
    return dataset.split(tables.read(spark, d, "labels"), "doc_id", 0.1, 0.2).groupBy("split").agg(F.count("*").alias("rows"))


@query("""select toxic, cast(sum(case when quality = 1 then 0 else 1 end) as double) / greatest(1, count(*)) as loss, cast(sum(case when (toxic = 0) = (quality = 1) then 1 else 0 end) as double) / greatest(1, count(*)) as accuracy from labels group by toxic""")
def confusion_accuracy(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    return dataset.metrics(tables.read(spark, d, "labels"), ["toxic"], t == 0, q == 1, F.when(q == 1, 0).otherwise(1), F.lit(1))


@query(f"""with {EV}, m as (select *, case when event_type <> 'view' then event_type end as status, case when k % 3 = 0 then k end as progress from ev)
 select user_id, arg_max(status, (us, event_id)) filter (status is not null) as status, arg_max(progress, (us, event_id)) filter (progress is not null) as progress, max(us) as updated_at from m group by user_id""")
def latest_status(spark, d):
    e = tables.events(spark, d).withColumn("status", F.when(F.col("event_type") != "view", F.col("event_type"))).withColumn("progress", F.when(F.col("k") % 3 == 0, F.col("k")))
    return jobs.latest(e, "user_id", ["us", "event_id"], ["status", "progress"])


@query(f"""with {EV}, r as (select *, row_number() over (partition by user_id order by us, event_id) as r from ev where event_type = 'signup') select user_id, event_id, us from r where r = 1""")
def fifo_next(spark, d):
    e = tables.events(spark, d).withColumn("status", F.when(F.col("event_type") == "signup", "queued").otherwise("done"))
    return jobs.next_queued(e, ["user_id"], ["us", "event_id"]).select("user_id", "event_id", "us")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 20 offset 40")
def paginate(spark, d):
    o = tables.read(spark, d, "orders").where("o_orderstatus = 'O'")
    return select.paginate(o, [F.desc("o_orderdate"), "o_orderkey"], 3, 20).select("o_orderkey", "o_totalprice")


@query("select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as pages from orders")
def page_counts(spark, d):
    return select.page_counts(tables.read(spark, d, "orders"), 20)


@query(f"""with {EV}, a as (select user_id, event_id, us from ev where event_type = 'purchase' and cents > 12000), b as (select user_id, event_id, us from ev where event_type = 'view')
 select * from a union all select * from b where user_id not in (select user_id from a)""")
def if_empty_fallback(spark, d):
    e = tables.events(spark, d)
    return select.if_empty(e.where("event_type = 'purchase' and cents > 12000").select("user_id", "event_id", "us"), e.where("event_type = 'view'").select("user_id", "event_id", "us"), "user_id")


@query("""with x as (select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as q from lineitem), y as (select *, unnest(range(case when q > 20 then cast(ceil(q / 15.0) as bigint) else 1 end)) as c from x)
 select l_orderkey, l_linenumber, l_partkey, cast(c as integer) as chunk, case when q > 20 then c * 15 else 0 end as start, case when q > 20 then least(q, (c + 1) * 15) else q end as "end" from y""")
def chunk_explode(spark, d):
    x = tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(0).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("end"))
    return intervals.chunk(x, 15, 20)


@query(f"""with {EV}, r as (select *, row_number() over (partition by user_id order by us, event_id) as r from ev) select event_id, user_id, cast(floor((r - 1) / 5) as bigint) as batch from r""")
def batch_of_five(spark, d):
    return select.batches(tables.events(spark, d), "user_id", ["us", "event_id"], 5).select("event_id", "user_id", F.col("batch").cast("long").alias("batch"))


@query(f"""with {SPANS}, r as (select *, row_number() over (partition by user_id order by s, event_id) as ordinal from sp) select event_id, user_id, cast(ordinal as integer) as ordinal, s as start, least(e, s + {100 * HOUR}) as "end" from r where ordinal <= 25 and e - s >= {10 * HOUR}""")
def dataset_capture(spark, d):
    return dataset.capture(_spans(spark, d), "user_id", ["start", "event_id"], "start", "end", 25, 10 * HOUR, 100 * HOUR).select("event_id", "user_id", "ordinal", "start", "end")


@query("select event_type as label, cast(row_number() over (order by event_type) - 1 as integer) as label_index from (select distinct event_type from events)")
def label_index(spark, d):
    return dataset.label_index(tables.read(spark, d, "events").withColumnRenamed("event_type", "label"), "label")


@query(f"""with {EV}, l as (select event_type, row_number() over (order by event_type) - 1 as i from (select distinct event_type from events)) select event_id, cast(i as integer) as label_index from ev join l using (event_type)""")
def label_join(spark, d):
    e = tables.read(spark, d, "events")
    return e.join(dataset.label_index(e, "event_type"), "event_type").select("event_id", "label_index")


@query(f"""with {EV}, x as (select *, greatest(0.0, coalesce(max(value) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding), 0.0)) as b from ev) select event_id, greatest(b, value) as best, value > b as improved from x""")
def running_best(spark, d):
    from pyspark.sql import Window

    e = tables.events(spark, d)
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    return dataset.running_best(e, ["user_id"], "i", "value").select("event_id", "best", "improved")


@query("""select c_custkey, list_transform(range(5), lambda i: least(c_custkey - 1, cast(floor(i * c_custkey / 5 + c_custkey / 10) as bigint))) as positions from customer where c_custkey > 0""")
def uniform_positions(spark, d):
    c = tables.read(spark, d, "customer").where("c_custkey > 0")
    return c.select("c_custkey", dataset.sample_positions(5, F.col("c_custkey")).alias("positions"))


@query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as best from embeddings")
def class_argmax(spark, d):
    return tables.read(spark, d, "embeddings").select("vec_id", dataset.argmax(F.col("embedding")).cast("long").alias("best"))


def _text(d: str) -> Column:
    return F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 7 == 1, "a:b").when(F.col("event_id") % 7 == 2, F.concat_ws(":", F.lit("1"), "k", "k", "k")).when(F.col("event_id") % 7 == 3, F.concat_ws(":", "k", F.col("event_id") % 60)).otherwise(F.concat_ws(":", F.col("event_id") % 5, "k", F.col("event_id") % 60))


TC = "case event_id % 7 when 0 then '' when 1 then 'a:b' when 2 then '1:' || k || ':' || k || ':' || k when 3 then k || ':' || event_id % 60 else event_id % 5 || ':' || k || ':' || event_id % 60 end"


@query(f"""with {EV}, t as (select event_id, {TC} as t from ev), p as (select event_id, t, string_split(t, ':') as p from t)
 select event_id, case when t = '' or len(p) > 3 then null when len(p) = 2 then try_cast(p[1] as double) * 60 + try_cast(p[2] as double) when len(p) = 3 then (try_cast(p[1] as double) * 60 + try_cast(p[2] as double)) * 60 + try_cast(p[3] as double) else try_cast(p[1] as double) end as seconds from p""")
def timecode_parse(spark, d):
    return tables.events(spark, d).select("event_id", scalar.timecode(_text(d)).alias("seconds"))


@query(f"""with {EV} select event_id, case when event_id % 3 = 0 then least(1.0, greatest(0.0, k / 50.0)) when event_id % 3 = 1 then 0.5 else 0.0 end::double as score from ev""")
def score_json_parse(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"score": '), F.col("k") / 50.0, F.lit("}"))).when(F.col("event_id") % 3 == 1, "about 0.5 I think").otherwise("none")
    return tables.events(spark, d).select("event_id", scalar.score_json(t).alias("score"))


@query(f"""with {EV}, s as (select event_id, cents // 10 as s, value from ev) select event_id, lpad(cast(s // 3600 as varchar), 2, '0') || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as clock,
 case when s >= 3600 then cast(s // 3600 as varchar) || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') else cast(s // 60 as varchar) end || ':' || lpad(cast(s % 60 as varchar), 2, '0') as short_clock from s""")
def clock_format(spark, d):
    s = F.floor(F.col("cents") / 10)
    return tables.events(spark, d).select("event_id", scalar.clock(s).alias("clock"), scalar.short_clock(s).alias("short_clock"))


@query(r"""select p_partkey, lower(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^a-zA-Z0-9.\-]', '_', 'g'), '_+', '_', 'g')) as name, cast(p_size as varchar) || ' KB' as size from part""")
def file_names_sizes(spark, d):
    p = tables.read(spark, d, "part")
    return p.select("p_partkey", scalar.safe_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"), scalar.file_size(F.col("p_size").cast("long") * 1024).alias("size"))


COLOR_ROWS = [("white", 255, 255, 255), ("navy", 128, 0, 0), ("#0a141e", 30, 20, 10), ("#abc", 204, 187, 170), ("1, 2,3", 3, 2, 1)]


@query("select c_custkey, case c_custkey % 6 when 0 then [255, 255, 255] when 1 then [128, 0, 0] when 2 then [30, 20, 10] when 3 then [204, 187, 170] when 4 then [3, 2, 1] else null end as bgr from customer")
def color_parse(spark, d):
    t = F.lit("no color")
    for i, row in enumerate(COLOR_ROWS):
        t = F.when(F.col("c_custkey") % 6 == i, row[0]).otherwise(t)
    return tables.read(spark, d, "customer").select("c_custkey", vision.color(t).alias("bgr"))


@query("""with x as (select a.vec_id, list_transform(a.embedding, lambda v: abs(cast(v as double))) as a, list_transform(b.embedding, lambda v: abs(cast(v as double))) as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
 select vec_id, round(greatest(0.0, 1 - sqrt(greatest(0.0, 1 - list_sum(list_transform(range(1, len(a) + 1), lambda i: sqrt(a[i] * b[i]))) / sqrt(list_sum(a) * list_sum(b))))), 6) as similarity from x""")
def histogram_similarity(spark, d):
    e = tables.read(spark, d, "embeddings")
    v = lambda n: F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias(n)
    pairs = e.select("vec_id", v("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), v("b")), "vec_id")
    return pairs.select("vec_id", F.round(vision.histogram_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""with {EV}, b as (select event_id, k as x1, event_id % 50 as y1, k + 20 + event_id % 30 as x2, event_id % 50 + 40 as y2 from ev), c as (select *, lead(x1) over (order by event_id) as u1, lead(y1) over (order by event_id) as v1, lead(x2) over (order by event_id) as u2, lead(y2) over (order by event_id) as v2 from b),
 i as (select *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) as i from c where u1 is not null)
 select event_id, round(i / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - i + 1e-6), 6) as iou from i""")
def box_iou(spark, d):
    b = tables.events(spark, d).select("event_id", F.col("k").cast("double").alias("x1"), (F.col("event_id") % 50).cast("double").alias("y1"), (F.col("k") + 20 + F.col("event_id") % 30).cast("double").alias("x2"), (F.col("event_id") % 50 + 40).cast("double").alias("y2"))
    n = b.select((F.col("event_id") - 1).alias("event_id"), *(F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")))
    j = b.join(n, "event_id")
    side = lambda p: {c: F.col(p + c) for c in ("x1", "y1", "x2", "y2")}
    return j.select("event_id", F.round(vision.iou(side(""), side("o")), 6).alias("iou"))


@query(f"""with {EV} select event_id, round(0.7 * (1 - abs(k / 100.0 - 0.5)) + 0.6 * case when event_id % 100 >= 45 then 1.0 else 0.25 end + 0.4 * least(1.0, cents / 100000.0 * 8), 9)::double as team,
 round(case when event_id % 5 = 0 then 2.0 else 0.0 end + 0.8 * k / 100.0 + 0.6 * (event_id % 10) / 10.0 + 0.3 * (event_id % 4) / 4.0 + 0.2 * (event_id % 7) / 7.0, 9)::double as player from ev""".replace("100.0", "100.0::double").replace("100000.0", "100000.0::double").replace("10.0 +", "10.0::double +").replace("4.0 +", "4.0::double +").replace("7.0,", "7.0::double,"))
def candidate_scores(spark, d):
    i = F.col("event_id")
    team = vision.team_score(F.col("k") / 100.0, (i % 100) / 100.0, F.col("cents") / 100000.0)
    player = vision.player_score(i % 5 == 0, F.lit(False), F.col("k") / 100.0, (i % 10) / 10.0, (i % 4) / 4.0, (i % 7) / 7.0)
    return tables.events(spark, d).select("event_id", F.round(team, 9).alias("team"), F.round(player, 9).alias("player"))


@query(f"""with {EV}, r as (select *, row_number() over (partition by user_id order by us, event_id) as r, count(*) over (partition by user_id) as c from ev) select event_id, user_id, greatest(0, c - 6) as more from r where r <= 6""")
def preview_more(spark, d):
    return select.preview(tables.events(spark, d), "user_id", ["us", "event_id"]).select("event_id", "user_id", "more")


@query(f"""with {EV}, x as (select *, floor(k / 10.0) as level, lag(floor(k / 10.0)) over (partition by user_id order by us, event_id) as b from ev) select event_id, user_id, cast(level as bigint) as level from x where b is null or b <> level""")
def progress_changes(spark, d):
    return motion.changes_only(tables.events(spark, d), "user_id", ["us", "event_id"], "k", 10).select("event_id", "user_id", "level")


@query(f"""with {EV} select event_id, case when cents > 120000 then 10 when cents > 60000 then 8 when cents > 30000 then 5 else 3 end as fast, case when cents > 120000 then 5 when cents > 60000 then 3 when cents > 30000 then 2 else 1 end as detailed,
 case when value > 30 then 120 when value > 15 then 90 when value > 10 then 60 else 30 end as timeout from ev""")
def strides_timeouts(spark, d):
    s = F.col("cents") / 100
    return tables.events(spark, d).select("event_id", motion.stride(s).alias("fast"), motion.stride(s, True).alias("detailed"), scalar.extraction_timeout(F.col("value")).alias("timeout"))


@query(f"""with {EV} select event_id, user_id, k from ev where event_id >= 100 and (event_id - 100) % 3 = 0 and ((event_id - 100) // 3) % 2 = 0""")
def frame_sampling(spark, d):
    return motion.sampled(tables.events(spark, d), "event_id", 3, 2, 100).select("event_id", "user_id", "k")


@query(f"""with {EV} select event_id, case when k >= 100 then 'Complete' when k < 20 then '5-10 minutes' when k < 40 then '3-5 minutes' when k < 60 then '2-3 minutes' when k < 80 then '1-2 minutes' else 'Less than 1 minute' end as eta,
 least(25.0, k * 0.25)::double as download, cast(floor((event_id % 5 + k / 100.0) / 5 * 100 + 0.5) as bigint) as overall from ev""")
def job_progress(spark, d):
    return tables.events(spark, d).select("event_id", jobs.eta(F.col("k")).alias("eta"), jobs.download_progress(F.col("k")).alias("download"), jobs.overall_progress(F.col("event_id") % 5, F.col("k").cast("double"), F.lit(5)).alias("overall"))


@query("""select c_custkey, c_mktsegment in ('BUILDING', 'MACHINERY') as team, case when c_custkey % 4 = 0 then null else cast(c_custkey % 4 as varchar) end as jersey, list_filter([case when c_custkey % 3 = 0 then 'a' end, case when c_custkey % 5 = 0 then 'b' end], lambda x: x is not null) as missing from customer""")
def request_fields(spark, d):
    c = tables.read(spark, d, "customer")
    i = F.col("c_custkey")
    scope = F.when(F.col("c_mktsegment") == "BUILDING", " Team ").when(F.col("c_mktsegment") == "MACHINERY", "ANY").otherwise("player")
    return c.select("c_custkey", scalar.is_team(scope).alias("team"), scalar.jersey(F.when(i % 4 == 0, " N/A ").otherwise((i % 4).cast("string"))).alias("jersey"), scalar.missing_fields(a=F.when(i % 3 != 0, "x"), b=F.when(i % 5 == 0, "").otherwise("y")).alias("missing"))


@query(f"""with {EV}, a as (select user_id, event_id, us, row_number() over (partition by user_id order by us, event_id) as o from ev where event_type = 'click'), b as (select user_id, event_id, us, row_number() over (partition by user_id order by us, event_id) as o from ev where event_type = 'view')
 select a.user_id, cast(a.o as integer) as ordinal, a.event_id as clip, b.event_id as label from a join b on a.user_id = b.user_id and a.o = b.o""")
def zip_ordinal(spark, d):
    e = tables.events(spark, d)
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("clip"), F.col("us").alias("ua"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("label"), F.col("us").alias("ub"))
    return select.zip_by_ordinal(a, b, "user_id", ["ua", "clip"], ["ub", "label"]).select("user_id", "ordinal", "clip", "label")


@query(f"""with {EV} select user_id, list(event_id order by us, event_id) as items from ev group by user_id""")
def ordered_concat(spark, d):
    e = tables.events(spark, d).withColumn("o", F.struct("us", "event_id"))
    return select.ordered_manifest(e, "user_id", "o", "event_id")


@query("select o_custkey, count(*) as orders, count_if(o_orderstatus = 'F') as done, count_if(o_orderstatus <> 'F') as open, round(sum(o_totalprice), 2) as total from orders group by o_custkey")
def user_stats(spark, d):
    return jobs.user_totals(tables.read(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_totalprice")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def cascade_anti(spark, d):
    """Rows whose parent isn't among the deleted."""
    gone = tables.read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return jobs.cascade(tables.read(spark, d, "customer"), gone, "c_custkey").select("c_custkey")


@query("select distinct s_suppkey from supplier semi join lineitem on s_suppkey = l_suppkey and l_quantity > 49")
def existence_semi(spark, d):
    listed = tables.read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("path"))
    return tables.existing(tables.read(spark, d, "supplier"), listed, "s_suppkey").select("s_suppkey")


@query("""with b as (select vec_id, least(15, cast(floor(abs(cast(unnest(embedding) as double)) * 16) as integer)) as bin from embeddings), c as (select vec_id, bin, count(*) as c from b group by all) select vec_id, bin, round(c / sqrt(sum(c * c) over (partition by vec_id)), 9) as weight from c""")
def histogram_bins(spark, d):
    """Counts of a vector's components by size, over their norm: one array expression for each row."""
    bins = F.transform("embedding", lambda x: F.least(F.lit(15), F.floor(F.abs(x.cast("double")) * 16)).cast("int"))
    counted = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter("bins", lambda x: x == b)).cast("long"))
    c = tables.read(spark, d, "embeddings").select("vec_id", bins.alias("bins")).select("vec_id", counted.alias("c"))
    c = c.select("vec_id", F.sqrt(F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x * x)).alias("norm"), F.posexplode("c").alias("bin", "n"))
    return c.where("n > 0").select("vec_id", "bin", F.round(F.col("n") / F.col("norm"), 9).alias("weight"))


@query(f"""with recursive {EV}, r as (select user_id, event_id, us, row_number() over (partition by user_id order by us, event_id) as i from ev),
 w(user_id, event_id, i, n, upto, allowed) as (select user_id, event_id, i, 1, us + {24 * HOUR}, true from r where i = 1 union all
 select r.user_id, r.event_id, r.i, case when r.us > upto then 1 when n >= 2 then n else n + 1 end, case when r.us > upto then r.us + {24 * HOUR} else upto end, r.us > upto or n < 2 from w join r on r.user_id = w.user_id and r.i = w.i + 1)
 select user_id, event_id, us, allowed from w join ev using (user_id, event_id)""")
def rate_limit(spark, d):
    return streams.rate_limited(tables.events(spark, d).select("user_id", "event_id", "us"), "user_id", "us", "event_id", 2, 24 * HOUR)


@query(f"""with {EV}, e as (select user_id, us // {6 * HOUR} as frame, event_id as box, k / 100.0::double as base, k >= 90 as hit, k::double as a, event_id % 10 + 1.0::double as b from ev),
 f as (select *, row_number() over (partition by user_id, frame order by base desc, box) as r from e),
 t as (select user_id, frame, box as spot, a, b from f where hit union all select user_id, frame, 2147483647 as spot, a, b from f where r = 1 and base >= 0.25),
 l as (select user_id, frame as lf, spot as lb, a as ra, b as rb from (select *, row_number() over (partition by user_id order by frame, spot, a, b) as q from t) where q = 1),
 s as (select user_id, frame, box, base + case when frame > lf or (frame = lf and box >= lb) then 0.6::double * greatest(0, 1 - sqrt(greatest(0, 1 - (sqrt(a * ra) + sqrt(b * rb)) / sqrt((a + b) * (ra + rb))))) else 0 end as score from e left join l using (user_id)),
 o as (select *, row_number() over (partition by user_id, frame order by score desc, box) as r from s) select user_id, frame, box, round(score, 9) as score from o where r = 1 and score >= 0.25""")
def reference_lock(spark, d):
    e = tables.events(spark, d).select("user_id", F.floor(F.col("us") / (6 * HOUR)).alias("frame"), F.col("event_id").alias("box"), (F.col("k") / 100.0).alias("base"), (F.col("k") >= 90).alias("hit"), F.array(F.col("k").cast("double"), F.col("event_id") % 10 + 1.0).alias("vector"))
    return association.lock_on(e, "user_id", "frame", "box", "base", "hit", 0.25, vision.histogram_similarity).select("user_id", "frame", "box", F.round("score", 9).alias("score"))


@query(f"""with {EV}, r as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as i from ev), f as (select user_id, i, k % 4 <> 0 as found, k / 100.0 as sim from r),
 g as (select *, i - coalesce(max(case when found then i end) over (partition by user_id order by i), -1) as run from f),
 s as (select *, min(case when run > 2 or (found and i % 5 = 0 and sim < 0.2) then i end) over (partition by user_id) as stop from g)
 select user_id, max(case when found then i end) as last, count(*) as samples from s where stop is null or i <= stop group by user_id""")
def tracker_follow(spark, d):
    """Forward tracking until a run of lost samples or an unlike one."""
    from pyspark.sql import Window

    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1).cast("long")
    s = tables.events(spark, d).select("user_id", i.alias("i"), (F.col("k") % 4 != 0).alias("found"), (F.col("k") / 100.0).alias("sim"))
    return tracks.follow(s, "user_id", "i", "found", "sim", 2, 5, 0.2)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = tables.events(spark, d)
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("seed"), F.col("us").alias("ts"))
    b = e.where("event_type = 'view'").select("user_id", (F.col("k") % 10).alias("track"), F.col("us").alias("tt"))
    return a, b


VOTED = f"""a as (select user_id, event_id as seed, us as ts from ev where event_type = 'click'), b as (select user_id, k % 10 as track, us as tt, event_id from ev where event_type = 'view'),
 v as (select a.user_id, track, count(distinct seed) as votes, min(seed) as first_seed from a join b on a.user_id = b.user_id and abs(ts - tt) <= {TOL} group by a.user_id, track),
 w as (select user_id, track from (select *, row_number() over (partition by user_id order by votes desc, first_seed, track) as r from v) where r = 1)"""


@query(f"""with {EV}, {VOTED}, x as (select user_id, tt, event_id, case when tt - lag(tt) over (partition by user_id order by tt, event_id) > {12 * HOUR} then 1 else 0 end as n from b semi join w using (user_id, track)),
 y as (select *, sum(n) over (partition by user_id order by tt, event_id rows unbounded preceding) as g from x), z as (select user_id, greatest(0, min(tt) - {2 * HOUR}) as start, max(tt) + {4 * HOUR} as "end", count(*) as n from y group by user_id, g)
 select * from z union all select user_id, min(us), max(us), count(*) from ev where user_id not in (select user_id from z) group by user_id""")
def seeded_track(spark, d):
    """Sessions of the track that seeds elect; the whole span of users without one."""
    a, b = _sides(spark, d)
    first = tables.events(spark, d).groupBy("user_id").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.count("*").alias("n"))
    return tracks.seeded_segments(a, b, first, "user_id", 12 * HOUR, 2 * HOUR, 4 * HOUR, TOL, None)


@query(f"""with {EV} select user_id, k % 10 as track, list(event_id order by us, event_id) as sightings from ev where k % 3 <> 0 and k % 2 = 0 group by all""")
def track_histories(spark, d):
    e = tables.events(spark, d).select("user_id", (F.col("k") % 10).alias("track"), "us", "event_id", (F.col("k") % 3 != 0).alias("confirmed"), (F.col("k") % 2).alias("time_since_update"))
    return tracks.histories(tracks.fresh(e), "user_id", "track", "us", "event_id").select("user_id", "track", F.col("history.event_id").alias("sightings"))


@query(f"""with {EV}, b as (select event_id, unnest([0, 1, 2]) as box, k from ev), x as (select event_id, box, k + 10 * box as x1, k as y1, k + 10 * box + 15 + k % 10 as x2, k + 30 + k % 20 as y2, (k + box) % 2 as cls from b)
 select event_id, box, x1, y1, x2, y2 from x where cls = 0 and x2 - x1 >= 20 and y2 - y1 >= 40""")
def person_boxes(spark, d):
    k = F.col("k")
    box = lambda i: F.struct((k + 10 * i).alias("x1"), k.alias("y1"), (k + 10 * i + 15 + k % 10).alias("x2"), (k + 30 + k % 20).alias("y2"), ((k + i) % 2).alias("cls"))
    e = tables.events(spark, d).select("event_id", F.array(*(box(i) for i in range(3))).alias("boxes"))
    return tracks.boxes(e)


@query("""select event_id, case when event_id % 3 = 0 then null else cast(json_extract_string(props, '$.k') as integer) end as k, case when event_id % 3 = 0 then event_type end as raw from events""")
def parsed_requests(spark, d):
    """JSON texts as variants; a text that is none stays as it is."""
    e = tables.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("props")).alias("request_json"))
    r = jobs.parsed(e, "request_json")
    text = F.col("event_id") % 3 == 0
    return r.select("event_id", F.when(~text, F.try_variant_get("request", "$.k", "int")).alias("k"), F.when(text, F.try_variant_get("request", "$", "string")).alias("raw"))


@query("select o_orderkey, o_orderstatus from orders where o_custkey = 7")
def owned_jobs(spark, d):
    return jobs.owned(tables.read(spark, d, "orders"), 7, "o_custkey").select("o_orderkey", "o_orderstatus")


@query("select c_custkey as key from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def missing_keys(spark, d):
    required = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    present = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_totalprice") > 300000, F.col("o_orderstatus")).otherwise("").alias("value"))
    return jobs.missing_keys(required, present)


@query("""select c_custkey, list_filter([case when not c_acctbal >= 0 then 'balance' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'segment' end], lambda x: x is not null) as broken
 from customer where c_acctbal < 0 or c_mktsegment not in ('BUILDING', 'MACHINERY')""")
def rejected_requests(spark, d):
    """Rows that break a rule, with the names of the rules."""
    c = tables.read(spark, d, "customer")
    out = c.select("c_custkey", scalar.broken_rules(balance=F.col("c_acctbal") >= 0, segment=F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("broken"))
    return out.where(F.size("broken") > 0)


STAGES = "['YOLO Detection', 'MediaPipe Pose', 'DeepFace Recognition', 'OSNet Tracking', 'Highlight Generation']"


@query(f"""with t as (select c_custkey, c_custkey % 70 as tick, case when c_custkey % 3 = 0 then c_custkey % 50 end as cut from customer), a as (select *, case when cut is not null and tick >= cut then cut - 1 else tick end as tk, coalesce(tick >= cut, false) as off from t)
 select c_custkey, case when tk < 0 then null when tk // 11 >= 5 then 'Complete' else {STAGES}[tk // 11 + 1] end as stage, case when tk < 0 then 0 when tk // 11 >= 5 then 100 else cast(floor((tk // 11 + (tk % 11 * 10) / 100.0::double) / 5 * 100 + 0.5) as bigint) end as progress,
 case when off and tk // 11 < 5 then 'cancelled' when tk // 11 >= 5 then 'completed' else 'processing' end as status from a""")
def simulated_stages(spark, d):
    i = F.col("c_custkey")
    t = tables.read(spark, d, "customer").select("c_custkey", (i % 70).alias("tick"), F.when(i % 3 == 0, i % 50).alias("cut"))
    return jobs.simulated(t, "tick", "cut").select("c_custkey", "stage", "progress", "status")


@query(f"""with {EV}, l as (select user_id, list(event_id order by us, event_id) as items from ev group by user_id) select user_id, list_append(items, -1) as added, list_concat(items[1:1], items[3:]) as removed from l""")
def list_edits(spark, d):
    e = tables.events(spark, d).withColumn("o", F.struct("us", "event_id"))
    items = F.col("items")
    return select.ordered_manifest(e, "user_id", "o", "event_id").select("user_id", scalar.appended(items, F.lit(-1).cast("long")).alias("added"), scalar.removed_at(items, 1).alias("removed"))


@query(f"""with {EV} select event_id, 'job-' || (us // 1000) || '-' || left(sha256(user_id || '|' || event_id), 9) as id, left(sha256(cast(event_id as varchar)), 8) as short from ev""")
def new_ids(spark, d):
    e = tables.events(spark, d)
    return e.select("event_id", scalar.new_id("job", F.floor(F.col("us") / 1000).cast("long"), F.col("user_id"), F.col("event_id")).alias("id"), scalar.short_id(F.col("event_id")).alias("short"))


@query("select o_orderkey, round_even(cast(o_totalprice as decimal(18, 2)), 1)::double as total from orders")
def rounded_values(spark, d):
    return tables.read(spark, d, "orders").select("o_orderkey", scalar.rounded(F.col("o_totalprice"), 1).alias("total"))


@query("select c_custkey, case when c_custkey % 2 = 0 then ['format', 'innings', 'tournament', 'venue'] else cast([] as varchar[]) end as fields from customer")
def sport_fields(spark, d):
    return tables.read(spark, d, "customer").select("c_custkey", scalar.sport_fields(F.when(F.col("c_custkey") % 2 == 0, "cricket").otherwise("chess")).alias("fields"))


@query(f"""with {EV}, s as (select event_id, value as s, value + cents % 7 as e, cast(event_id % 4 as integer) as c from ev), t as (select event_id, s, e, c, unnest(range(3)) as i from s)
 select event_id, cast(i as integer) as pos, case i when 0 then s + 0.2::double when 1 then (s + e) / 2 else greatest(s + 0.2::double, e - 0.2::double) end as at from t where i < c""")
def still_times(spark, d):
    e = tables.events(spark, d)
    s = e.select("event_id", F.posexplode(scalar.stills(F.col("value"), F.col("value") + F.col("cents") % 7, (F.col("event_id") % 4).cast("int"))).alias("pos", "at"))
    return s


@query(f"""with {SPANS}, p as (select *, coalesce(sum(e - s) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding), 0) as p from sp where e > s),
 q as (select *, least(e, s + ({300 * HOUR} - p)) as f, row_number() over (partition by user_id order by s, event_id) - 1 as i from p where p < {300 * HOUR}),
 r as (select *, event_id % 5 <> 0 as ok, 'out/v' || user_id || '_clips/clip_' || lpad(cast(i as varchar), 3, '0') || '.mp4' as clip from q)
 select user_id, count_if(ok) as made, count_if(not ok) as failed, cast(sum(case when ok then f - s end) as bigint) as seconds, list('file ' || chr(39) || clip || chr(39) order by i) filter (ok) as lines from r group by user_id having count_if(ok) > 0""")
def clip_plans(spark, d):
    """Planned clips of each user, what came of them, and the list that joins those that were made."""
    s = _spans(spark, d).withColumn("source", F.concat(F.lit("in/v"), F.col("user_id"), F.lit(".mp4")))
    p = clips.plan(s, "user_id", "source", "out", 300 * HOUR, tie=["event_id"])
    p = p.withColumn("done", F.when(F.col("event_id") % 5 != 0, "copy")).withColumn("bytes", F.lit(2048))
    made = clips.outcomes(p, "user_id").select("user_id", "made", "failed", F.col("seconds").cast("long").alias("seconds"))
    return made.join(clips.join_list(p, "user_id"), "user_id")


@query("""select vec_id, list_transform(range(1, len(embedding) + 1), lambda i: round((floor(abs(cast(embedding[i] as double)) * 255) / 255.0::double - (cast([0.485, 0.456, 0.406] as double[]))[(i - 1) % 3 + 1]) / (cast([0.229, 0.224, 0.225] as double[]))[(i - 1) % 3 + 1], 6)) as x from embeddings""")
def channel_norm(spark, d):
    e = tables.read(spark, d, "embeddings")
    raw = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255))
    return e.select("vec_id", F.transform(vision.normalised(raw), lambda x: F.round(x, 6)).alias("x"))


RUNS = f"""r as (select user_id, cents > 5000 as moving, row_number() over (partition by user_id order by us, event_id) - 1 as i from ev), n as (select user_id, max(i) as last_i from r group by user_id),
 m as (select *, case when i - lag(i) over (partition by user_id order by i) > 3 then 1 else 0 end as b from r where moving), g as (select *, sum(b) over (partition by user_id order by i rows unbounded preceding) as g from m),
 q as (select user_id, min(i) as f, max(i) as l from g group by user_id, g)"""


@query(f"""with {EV}, {RUNS}, v as (select user_id, last_i, (last_i + 1) * 3 as total, ((last_i + 1) * 3 - 2) / 30.0::double as duration from n),
 p as (select user_id, greatest(0, f * 3 / 30.0::double - 0.5) as s, least(duration, case when l + 3 <= last_i then (l + 3) * 3 else total end / 30.0::double + 2.0) as e from q join v using (user_id)),
 x as (select *, case when s <= max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) + 0.2 then 0 else 1 end as b from p where e - s >= 0.3),
 y as (select *, sum(b) over (partition by user_id order by s, e rows unbounded preceding) as g from x) select user_id, min(s) as start, max(e) as "end" from y group by user_id, g""")
def practice_segments(spark, d):
    """Movement segments of practice videos, bounded by the length of the video."""
    from pyspark.sql import Window

    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1).cast("long")
    samples = tables.events(spark, d).select("user_id", i.alias("sample_idx"), (F.col("cents") > 5000).alias("moving"))
    total = F.count("*") * 3
    videos = samples.groupBy("user_id").agg(total.alias("total_frames"), ((total - 2) / 30.0).alias("duration"))
    return pipelines.practice(samples, videos, "user_id")


#: Events on a coarse clock: one row for each user and four hours, as second t and position x.
COARSE = f"""{EV}, c as (select user_id, cast((us - {BASE_US}) // {4 * HOUR} as double) as t, cast(max(cents) as double) as x from ev group by 1, 2)"""


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    return tables.events(spark, d).groupBy("user_id", F.floor((F.col("us") - BASE_US) / (4 * HOUR)).cast("double").alias("t")).agg(F.max("cents").cast("double").alias("x"))


MOVING = f"""{COARSE}, mv as (select *, abs(x - lag(x) over (partition by user_id order by t)) as dist, greatest(0.001, t - lag(t) over (partition by user_id order by t)) as dt, count(*) over (partition by user_id) as n from c),
 mf as (select user_id, t from mv where n >= 3 and dist >= 3 and dist / dt >= 20)"""


def _sessions(rows: str, out: str) -> str:
    return f"""{out}_x as (select *, case when t - lag(t) over (partition by user_id order by t) > 2.5 then 1 else 0 end as b from {rows}), {out}_y as (select *, sum(b) over (partition by user_id order by t rows unbounded preceding) as g from {out}_x),
 {out} as (select user_id, min(t) as s, max(t) as e, count(*) as n from {out}_y group by user_id, g)"""


@query(f"""with {MOVING}, {_sessions("mf", "z")} select user_id, greatest(0, s - 1.5) as start, e + 4.0 as "end", n from z""")
def motion_sessions(spark, d):
    return motion.motion_segments(_coarse(spark, d).withColumn("y", F.lit(0.0)), "user_id", "t", "x", "y", 4.0, speed=20.0)


@query(f"""with {MOVING}, {_sessions("mf", "z")}, {_sessions("c", "w")}, v as (select user_id, user_id % 3 = 0 as bowling, max(t) as duration from c group by user_id),
 a as (select user_id, greatest(0, s - 1.5) as s, e + case when bowling then 10 else 4 end as e from z join v using (user_id)),
 b as (select user_id, greatest(0, s - 2.0) as s, e + case when bowling then 12 else 4 end as e from w join v using (user_id)),
 o as (select * from a union all select * from b where user_id not in (select user_id from a)),
 f as (select *, row_number() over (partition by user_id order by s, e) as r from o), g as (select user_id, greatest(0, s) as s, least(duration, e) as e from f join v using (user_id) where r <= 50 and e > 0),
 h as (select *, coalesce(sum(e - s) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding), 0) as used from g where e > s)
 select user_id, s as start, least(e, s + (120 - used)) as "end" from h where used < 120""")
def highlight_segments(spark, d):
    """Motion segments or else sessions, padded by action, the first of them clamped and capped."""
    c = _coarse(spark, d)
    seeds = c.select("user_id", F.col("t").alias("time_s"), "x", F.lit(0.0).alias("y"))
    videos = c.groupBy("user_id").agg(F.max("t").alias("duration")).withColumn("action", F.when(F.col("user_id") % 3 == 0, "bowling").otherwise("batting"))
    return pipelines.highlights(c.select("user_id", "t"), seeds, videos, "user_id")


@query("select c_custkey, case c_custkey % 3 when 0 then 12.0 else 4.0 end::double as post, case c_custkey % 3 when 0 then 10.0 else 4.0 end::double as motion_post, 2.0::double as pre, 1.5::double as motion_pre from customer")
def padding_presets(spark, d):
    action = F.when(F.col("c_custkey") % 3 == 0, "bowling").when(F.col("c_custkey") % 3 == 1, "Bowling").otherwise("batting")
    (a, b), (x, y) = intervals.padding(action), intervals.padding(action, True)
    return tables.read(spark, d, "customer").select("c_custkey", b.alias("post"), y.alias("motion_post"), a.alias("pre"), x.alias("motion_pre"))


@query(f"""with {EV} select event_id, contains(replace('ab ' || k || ' 7', ' ', ''), 'b' || k // 10) as held, k % 3 = 0 as flag, case when k % 4 = 0 then 25 else k end as clips,
 k % 5 = 0 or k % 3 > 0 or k % 7 = 0 as named, (k % 4 = 1 and cents * 40000 <= 524288000) or (k % 4 = 2 and cents * 40000 <= 10485760) or (k % 4 = 3 and cents * 40000 <= 52428800) as fits from ev""")
def text_rules(spark, d):
    """Labels in read texts, flags and numbers of settings, requests that name somebody, uploads within their limits."""
    k = F.col("k")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), k % 4 + 1)
    return tables.events(spark, d).select("event_id", scalar.contains_label(F.concat(F.lit("ab "), k, F.lit(" 7")), F.concat(F.lit("b"), F.floor(k / 10))).alias("held"),
        scalar.truthy(F.when(k % 3 == 0, " Yes").otherwise("off")).alias("flag"), scalar.whole_number(F.when(k % 4 == 0, "x").otherwise(k.cast("string"))).alias("clips"),
        scalar.identified(F.when(k % 5 == 0, "Team").otherwise("one"), F.when(k % 3 == 0, "N/A").otherwise(k.cast("string")), F.when(k % 7 == 0, "red").otherwise(" ")).alias("named"),
        scalar.acceptable_upload(pick("video", "video", "image", "audio"), pick("video/ogg", "video/mp4", "image/png", "audio/wav"), F.col("cents") * 40000).alias("fits"))


@query(f"""with {EV} select event_id, greatest(0, (k - 5 + cents) / 2.0::double) as middle, case k % 3 when 0 then '5-10 minutes' when 1 then '10-20 minutes' else '20-40 minutes' end as eta,
 case when k % 10 = 0 then 0 else floor(k / (k % 10)::double * 100 + 0.5) end::bigint as percent, case when k % 3 = 0 then 0.0 else k * 60 + k % 60 end::double as seconds from ev""")
def time_estimates(spark, d):
    k = F.col("k")
    choice = F.when(k % 3 == 0, "10").when(k % 3 == 1, "10-20").otherwise("20+")
    return tables.events(spark, d).select("event_id", scalar.midpoint(k - 5, F.col("cents")).alias("middle"), scalar.eta_by_length(choice).alias("eta"), scalar.percent(k, k % 10).cast("long").alias("percent"), scalar.timecode_strict(F.when(k % 3 == 0, " ").otherwise(F.concat_ws(":", k, k % 60))).alias("seconds"))


PIXELS = """px as (select vec_id, i, list_transform([embedding[i], embedding[i + 1], embedding[i + 2]], lambda x: coalesce(cast(floor(abs(cast(x as double)) * 255) as integer) % 256, 0)) as p from embeddings, unnest(range(1, len(embedding) + 1, 3)) t(i))"""


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as regions of pixels of three components each; what the last one lacks is 0."""
    byte = lambda i: F.coalesce(F.floor(F.abs(F.get("embedding", i).cast("double")) * 255).cast("int") % 256, F.lit(0))
    return tables.read(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(3)), lambda i: F.array(byte(i), byte(i + 1), byte(i + 2))).alias("pixels"))


@query(f"""with {PIXELS} select vec_id, [floor(sum(p[1]) / count(*)), floor(sum(p[2]) / count(*)), floor(sum(p[3]) / count(*))]::integer[] as mean,
 list(cast(round(p[1] * 0.114::double + p[2] * 0.587::double + p[3] * 0.299::double) as integer) order by i) as gray from px group by vec_id""")
def region_colors(spark, d):
    """Mean color of a region, and its pixels in gray."""
    return _pixels(spark, d).select("vec_id", images.mean_color(F.col("pixels")).alias("mean"), images.gray(F.col("pixels")).alias("gray"))


HSV8 = f"""{PIXELS}, hs as (select vec_id, p[1]::double as b, p[2]::double as g, p[3]::double as r, greatest(p[1], p[2], p[3])::double as top, (greatest(p[1], p[2], p[3]) - least(p[1], p[2], p[3]))::double as d from px),
 hh as (select *, case when d = 0 then 0 when top = r then (g - b) * 30.0::double / d when top = g then (b - r) * 30.0::double / d + 60 else (r - g) * 30.0::double / d + 120 end as h0, case when top = 0 then 0 else round(d * 255.0::double / top) end as sat from hs)"""


@query(f"""with {HSV8}, bn as (select vec_id, cast(floor(round(case when h0 < 0 then h0 + 180 else h0 end) % 180 * 16 / 180) * 16 + floor(sat * 16 / 256) as integer) as bin from hh),
 cn as (select vec_id, bin, count(*) as n from bn group by all) select vec_id, bin, round(n / sqrt(sum(n * n) over (partition by vec_id)), 9) as weight from cn""")
def color_histograms(spark, d):
    """The filled bins of each region's histogram of 16 hues by 16 saturations."""
    h = images.color_histogram(_pixels(spark, d), ["vec_id"], "pixels")
    return h.select("vec_id", F.posexplode("histogram").alias("bin", "weight")).where("weight > 0").select("vec_id", "bin", F.round("weight", 9).alias("weight"))


@query("""with g as (select vec_id, list_transform(embedding, lambda x: cast(floor(abs(cast(x as double)) * 255) as integer) % 256) as c from embeddings),
 i as (select vec_id, c, y, x from g, unnest(range(0, len(c) // 8 // 4)) a(y), unnest(range(0, 2)) b(x))
 select vec_id, list(cast(round((c[(y * 4 + 1) * 8 + x * 4 + 2] + c[(y * 4 + 1) * 8 + x * 4 + 3] + c[(y * 4 + 2) * 8 + x * 4 + 2] + c[(y * 4 + 2) * 8 + x * 4 + 3]) / 4.0::double) as integer) order by y, x) as cells from i group by vec_id""")
def quarter_frames(spark, d):
    """Vectors as gray frames of eight columns, at a quarter of their size."""
    cells = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255).cast("int") % 256)
    return tables.read(spark, d, "embeddings").select("vec_id", images.quarter(cells, F.lit(8)).alias("cells"))


HUE = lambda c: f"case when greatest({c}[1], {c}[2], {c}[3]) = least({c}[1], {c}[2], {c}[3]) then 0 when {c}[3] = greatest({c}[1], {c}[2], {c}[3]) then ({c}[2] - {c}[1]) / (greatest({c}[1], {c}[2], {c}[3]) - least({c}[1], {c}[2], {c}[3])) when {c}[2] = greatest({c}[1], {c}[2], {c}[3]) then 2 + ({c}[1] - {c}[3]) / (greatest({c}[1], {c}[2], {c}[3]) - least({c}[1], {c}[2], {c}[3])) else 4 + ({c}[3] - {c}[2]) / (greatest({c}[1], {c}[2], {c}[3]) - least({c}[1], {c}[2], {c}[3])) end / 6"
SAT = lambda c: f"case when greatest({c}[1], {c}[2], {c}[3]) = 0 then 0 else (greatest({c}[1], {c}[2], {c}[3]) - least({c}[1], {c}[2], {c}[3])) / greatest({c}[1], {c}[2], {c}[3]) end"


@query(f"""with {EV}, c as (select event_id, [k % 7 * 40 / 255.0::double, k % 5 * 60 / 255.0::double, k % 3 * 120 / 255.0::double] as a, [event_id % 4 * 80 / 255.0::double, k % 11 * 25 / 255.0::double, event_id % 6 * 50 / 255.0::double] as b from ev),
 x as (select event_id, {HUE("a")} as h1, {HUE("b")} as h2, {SAT("a")} as s1, {SAT("b")} as s2, greatest(a[1], a[2], a[3]) as v1, greatest(b[1], b[2], b[3]) as v2 from c),
 y as (select event_id, h1 - floor(h1) as h1, h2 - floor(h2) as h2, s1, s2, v1, v2 from x)
 select event_id, round(h1, 9) as hue, round(sqrt(power(least(abs(h1 - h2), 1 - abs(h1 - h2)) * 2, 2) + power(s1 - s2, 2) + power(v1 - v2, 2)), 9) as distance from y""")
def color_distances(spark, d):
    k, i = F.col("k"), F.col("event_id")
    a, b = F.array(k % 7 * 40, k % 5 * 60, k % 3 * 120), F.array(i % 4 * 80, k % 11 * 25, i % 6 * 50)
    return tables.events(spark, d).select("event_id", F.round(vision.hsv(a)[0], 9).alias("hue"), F.round(vision.color_distance(a, b), 9).alias("distance"))


@query(f"""with {EV}, s as (select event_id, k % 4 = 0 as team, k % 3 > 0 as hinted, k % 2 = 0 as colored, k / 100.0::double as score from ev)
 select event_id, team or not hinted or score >= case when colored then 0.45 else 0.25 end as accepted, cast(trunc(event_id % 1000 / 0.5::double) as integer) as x from s""")
def acceptance_rules(spark, d):
    """Which candidates are accepted, and their place in the frame before it was resized."""
    k = F.col("k")
    return tables.events(spark, d).select("event_id", vision.accepted(k / 100.0, k % 4 == 0, k % 2 == 0, k % 3 > 0).alias("accepted"), vision.rescaled(F.col("event_id") % 1000, 0.5).alias("x"))


@query(f"""with {EV}, b as (select event_id, greatest(0, k - 20) as x1, greatest(0, k % 30 - 5) as y1, least(k + 40, 99) as x2, least(k % 30 + 90, 99) as y2 from ev), c as (select *, y2 - y1 as h, x2 - x1 as w from b),
 r as (select *, cast(floor(h * 0.15::double) as integer) as t, cast(floor(h * 0.6::double) as integer) as m from c),
 o as (select event_id, unnest([{{'name': 'helmet', 'a': x1, 'b': y1, 'c': x2, 'd': y1 + greatest(1, t)}}, {{'name': 'torso', 'a': x1, 'b': y1 + t, 'c': x2, 'd': y1 + m}}, {{'name': 'lower', 'a': x1, 'b': y1 + m, 'c': x2, 'd': y2}},
 {{'name': 'glove_left', 'a': x1, 'b': y1 + m, 'c': x1 + greatest(1, w // 3), 'd': y2}}, {{'name': 'glove_right', 'a': x1 + w * 2 // 3, 'b': y1 + m, 'c': x2, 'd': y2}}]) as z from r)
 select event_id, z.name as name, z.a as x1, z.b as y1, z.c as x2, z.d as y2, z.c > z.a and z.d > z.b as filled from o""")
def body_regions(spark, d):
    """Parts of each box, cut to a frame of 100 by 100, one row for each."""
    k, size = F.col("k"), F.lit(100)
    r = tables.events(spark, d).select("event_id", F.explode(vision.regions(k - 20, k % 30 - 5, k + 40, k % 30 + 90, size, size)).alias("r")).select("event_id", "r.*")
    return r.withColumn("filled", vision.has_pixels(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size, size))


@query("""with h as (select label, list(list_transform(embedding, lambda x: abs(cast(x as double))) order by vec_id) as h from embeddings group by label)
 select label, list_transform(list_reduce(h, lambda s, v: list_transform(list_zip(s, v), lambda z: (z[1] + z[2]) / 2)), lambda x: round(x, 9)) as mean from h""")
def folded_histograms(spark, d):
    """Each step of the fold halves what came before, so the last 64 rows of a label (kept before the shuffle) decide all digits of a double."""
    e = tables.read(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"))
    last = select.top_per_key(e, "label", [F.desc("vec_id")], 64)
    h = last.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "h"))).alias("s"))
    return h.select("label", F.transform(vision.folded_mean(F.col("s.h")), lambda x: F.round(x, 9)).alias("mean"))


@query("select o_custkey, count(*) as segments, round_even(max(o_totalprice), 1) as duration from orders group by o_custkey")
def job_summary(spark, d):
    return jobs.summary(tables.read(spark, d, "orders"), "o_custkey", F.col("o_totalprice").cast("decimal(18,2)")).select("o_custkey", "segments", F.col("duration").cast("double").alias("duration"))


LOG = f"""{EV}, lg as (select user_id, us, event_id, case k % 6 when 0 then 'queued' when 1 then 'downloading' when 2 then 'processing' when 3 then 'compiling' when 4 then 'done' end as status from ev)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k") % 6
    return tables.events(spark, d).select("user_id", "us", "event_id", F.when(k < 5, F.element_at(F.array(*map(F.lit, jobs.STATES)), k + 1)).alias("status"))


@query(f"with {LOG} select user_id, arg_max(status, (us, event_id)) filter (status is not null) as status, max(us) as updated_at from lg where user_id in (1, 2, 3, 5, 8, 13) group by user_id")
def job_polls(spark, d):
    """What polls of six jobs return (a poll names its jobs)."""
    return jobs.status_of(_log(spark, d), "user_id", [1, 2, 3, 5, 8, 13], ["us", "event_id"], ["status"])


@query(f"""with {LOG}, s as (select user_id, arg_max(status, (us, event_id)) filter (status is not null) as status from lg group by user_id)
 select user_id, case when user_id % 2 = 0 and status not in ('done', 'failed', 'completed') then 'cancelled' else status end as status from s""")
def cancelled_jobs(spark, d):
    state = jobs.latest(_log(spark, d), "user_id", ["us", "event_id"], ["status"]).select("user_id", "status")
    return jobs.cancel(state, state.where("user_id % 2 = 0"), "user_id").select("user_id", "status")


@query(f"""with {LOG}, x as (select *, lag(status) over (partition by user_id order by us, event_id) as p from lg where status is not null)
 select event_id, user_id, p as before, status from x where case when p is null then status <> 'queued' else not (p = status or (p = 'queued' and status in ('downloading', 'processing')) or (p = 'downloading' and status = 'processing') or (p = 'processing' and status in ('compiling', 'done')) or (p = 'compiling' and status = 'done')) end""")
def broken_transitions(spark, d):
    return jobs.broken_transitions(_log(spark, d), "user_id", ["us", "event_id"]).select("event_id", "user_id", "before", "status")


@query(f"""with {EV} select 'job-' || event_id as id, 'queued' as status, 'queued' as stage, 'Job queued' as message, 0.0::double as download_percent, 0.0::double as progress, props as request_json, us as created_at, us as updated_at from ev join events using (event_id)""")
def created_jobs(spark, d):
    e = tables.read(spark, d, "events").select("event_id", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return jobs.created(e.withColumn("id", F.concat(F.lit("job-"), F.col("event_id"))), "id", "props", "us")


@query(f"""with {EV} select event_id, map_from_entries(list_filter([{{'k': 'fps', 'v': k}}, {{'k': 'mode', 'v': k % 7}}, {{'k': 'n' || k % 3, 'v': 1}}], lambda x: x.k in ('fps', 'mode', 'n1'))) as given from ev""")
def known_arguments(spark, d):
    """Of given arguments those that a function takes."""
    k = F.col("k")
    given = F.create_map(F.lit("fps"), k, F.lit("mode"), k % 7, F.concat(F.lit("n"), k % 3), F.lit(1))
    return tables.events(spark, d).select("event_id", scalar.known_arguments(given, ["fps", "mode", "n1"]).alias("given"))


@query(None)
def trained_head(spark, d):
    """Labels predicted by a linear head trained on the vectors."""
    e = tables.read(spark, d, "embeddings")
    return models.apply_head(e, models.train_head(e, "embedding", "label"), "embedding").select("vec_id", "label", "predicted")


@query(f"""with {EV} select event_id, ['-i', 'in.mp4', '-ss', k || '.0', '-t', '5.0', '-c:v', 'libx264', '-preset', 'ultrafast', '-tune', 'fastdecode', '-crf', '28', '-c:a', 'aac', '-b:a', '96k', '-avoid_negative_ts', 'make_zero', '-y', 'c.mp4'] as encode,
 ['-i', 'a' || k, '-i', 'b', '-filter_complex', '[0:v]setpts=PTS-STARTPTS[v0];[0:a]asetpts=PTS-STARTPTS[a0];[1:v]setpts=PTS-STARTPTS[v1];[1:a]asetpts=PTS-STARTPTS[a1];[v0][v1]concat=n=2:v=1:a=0[outv];[a0][a1]concat=n=2:v=0:a=1[outa]',
 '-map', '[outv]', '-map', '[outa]', '-c:v', 'libx264', '-preset', 'fast', '-crf', '23', '-c:a', 'aac', '-b:a', '128k', '-avoid_negative_ts', 'make_zero', '-y', 'out.mp4'] as joined, greatest(120, k * 3) as timeout from ev""")
def clip_commands(spark, d):
    """The encoder's arguments of a cut and of a join by a filter graph."""
    k = F.col("k")
    encode = clips.encode_args(F.lit("in.mp4"), k.cast("double"), k + 5.0, F.lit("c.mp4"))
    joined = clips.graph_args(F.array(F.concat(F.lit("a"), k), F.lit("b")), F.lit("out.mp4"))
    return tables.events(spark, d).select("event_id", encode.alias("encode"), joined.alias("joined"), clips.second_timeout(k).alias("timeout"))


for more in (long_keys, media, tracked):
    QUERIES |= more.QUERIES
    ORACLE_SQL |= getattr(more, "ORACLE_SQL", {})
