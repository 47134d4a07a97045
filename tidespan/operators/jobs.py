"""A job table as an append-only status log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a job and the progress at which each stage starts.
STATES = ("queued", "downloading", "processing", "compiling", "done", "failed")
STAGE_PROGRESS = {"downloading": 5, "detecting": 40, "tracking": 60, "selecting": 75, "compiling": 90, "done": 100}


#: Which states may follow a state.
NEXT = {"queued": ("downloading", "processing", "failed"), "downloading": ("processing", "failed"), "processing": ("compiling", "done", "failed"), "compiling": ("done", "failed"), "done": (), "failed": ()}


def created(requests: DataFrame, job_id: str, payload: str, at: str) -> DataFrame:
    """First log rows of new jobs: queued, without progress, with their request as JSON text."""
    fixed = {"status": "queued", "stage": "queued", "message": "Job queued"}
    return requests.select(F.col(job_id).alias("id"), *(F.lit(v).alias(k) for k, v in fixed.items()), F.lit(0.0).alias("download_percent"), F.lit(0.0).alias("progress"), F.col(payload).alias("request_json"), F.col(at).alias("created_at"), F.col(at).alias("updated_at"))


def broken_transitions(log: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """Rows whose state may not follow the one before of their job (rows without a state change nothing and are passed over)."""
    w = Window.partitionBy(key).orderBy(*order)
    d = log.where(F.col(status).isNotNull()).withColumn("before", F.lag(status).over(w))
    allowed = F.lit(False)
    for a, after in NEXT.items():
        allowed = allowed | ((F.col("before") == a) & F.col(status).isin(a, *after))
    return d.where(F.when(F.col("before").isNull(), F.col(status) != "queued").otherwise(~allowed))


def user_totals(df: DataFrame, key: str, done: Column, amount: str) -> DataFrame:
    """Rows of each key, how many of them are done and open, and the rounded sum of an amount."""
    return df.groupBy(key).agg(F.count("*").alias("orders"), F.count_if(done).alias("done"), F.count_if(~done).alias("open"), F.round(F.sum(amount), 2).alias("total"))


def latest(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The state of each job: for each field the last value that is not null (an update with null changes nothing)."""
    at = F.struct(*order)
    return log.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields), F.max(order[0]).alias("updated_at"))


def next_queued(state: DataFrame, by: list[str], order: list, status: str = "status") -> DataFrame:
    """The oldest queued job of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return state.where(F.col(status) == "queued").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def cancel(state: DataFrame, wanted: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Set jobs in ``wanted`` to cancelled unless they are over."""
    w = wanted.select(key).distinct().withColumn("__w", F.lit(True))
    over = F.col(status).isin("done", "failed", "completed")
    return state.join(w, key, "left").withColumn(status, F.when(F.col("__w") & ~over, "cancelled").otherwise(F.col(status))).drop("__w")


def stage_progress(stage: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in STAGE_PROGRESS.items():
        out = F.when(stage == name, value).otherwise(out)
    return out


def download_progress(percent: Column) -> Column:
    return F.least(F.lit(25.0), percent * 0.25)


def overall_progress(done: Column, current: Column, stages: Column) -> Column:
    """Percent of all stages, half rounded up."""
    return F.floor((done + current / 100) / stages * 100 + 0.5)


def eta(progress: Column) -> Column:
    """Fixed texts by progress."""
    return F.when(progress >= 100, "Complete").when(progress < 20, "5-10 minutes").when(progress < 40, "3-5 minutes").when(progress < 60, "2-3 minutes").when(progress < 80, "1-2 minutes").otherwise("Less than 1 minute")


def summary(df: DataFrame, key: str, duration: Column) -> DataFrame:
    """Segments of each key and its duration, rounded to one place (half to even)."""
    return df.groupBy(key).agg(F.count("*").alias("segments"), F.bround(F.max(duration), 1).alias("duration"))


#: The stages of a simulated analysis.
SIMULATED = ("YOLO Detection", "MediaPipe Pose", "DeepFace Recognition", "OSNet Tracking", "Highlight Generation")


def simulated(ticks: DataFrame, tick: str, cancelled_at: str) -> DataFrame:
    """Adds stage, progress and status of a simulated job after each tick (from 0): a stage goes from 0 to 100 in tens, then the next
    begins.  From ``cancelled_at`` on (null: never) the job stands still at what it was."""
    c = F.col(cancelled_at)
    at = F.when(c.isNotNull() & (F.col(tick) >= c), c - 1).otherwise(F.col(tick))
    stage, inside = F.floor(at / 11), at % 11 * 10
    over = stage >= len(SIMULATED)
    name = F.when(at < 0, F.lit(None)).when(over, "Complete").otherwise(F.element_at(F.array(*map(F.lit, SIMULATED)), F.least(stage, F.lit(len(SIMULATED) - 1)).cast("int") + 1))
    progress = F.when(at < 0, 0).when(over, 100).otherwise(overall_progress(stage, inside.cast("double"), F.lit(len(SIMULATED))))
    status = F.when(c.isNotNull() & (F.col(tick) >= c) & ~over, "cancelled").when(over, "completed").otherwise("processing")
    return ticks.withColumn("stage", name).withColumn("progress", progress.cast("long")).withColumn("status", status)


def parsed(df: DataFrame, *columns: str) -> DataFrame:
    """Columns ``x_json`` become variants ``x``; a text that is no JSON stays that text."""
    for c in columns:
        df = df.withColumn(c.removesuffix("_json"), F.coalesce(F.try_parse_json(c), F.col(c).cast("variant"))).drop(c)
    return df


def owned(state: DataFrame, user: str, owner: str = "user_id") -> DataFrame:
    return state.where(F.col(owner) == user)


def status_of(log: DataFrame, key: str, wanted: list, order: list[str], fields: list[str]) -> DataFrame:
    """What a poll returns: the state of the wanted jobs.  The filter reaches the scan of the log."""
    return latest(log.where(F.col(key).isin(wanted)), key, order, fields)


def cascade(children: DataFrame, deleted: DataFrame, parent: str) -> DataFrame:
    """Rows whose parent was not deleted."""
    return children.join(deleted.select(parent).distinct(), parent, "left_anti")


def missing_keys(required: DataFrame, present: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Required keys that have no value (or an empty one)."""
    has = present.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").select(key)
    return required.select(key).distinct().join(has, key, "left_anti")


def snapshot(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """A log in one row for each job: for each field a struct of ``order`` and ``value``, the last that is not null, and updated_at.  The form that ``merged`` adds up."""
    last = lambda f: F.max(F.when(F.col(f).isNotNull(), F.struct(*order, F.col(f).alias("value"))))
    return log.groupBy(key).agg(*(last(f).alias(f) for f in fields), F.max(order[0]).alias("updated_at"))


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One snapshot of two, field by field.  Rows that both have seen do no harm, nor does the order in which they came."""
    both = first.unionByName(second)
    return both.groupBy(key).agg(*(F.max(c).alias(c) for c in first.columns if c != key))


def state_of(snapshots: DataFrame, key: str) -> DataFrame:
    """What ``latest`` gives for the whole log."""
    return snapshots.select(key, *(F.col(c) if c == "updated_at" else F.col(f"{c}.value").alias(c) for c in snapshots.columns if c != key))


def compact(log: DataFrame, folder: str, key: str, order: list[str], fields: list[str], batch: str = "batch") -> DataFrame:
    """The snapshot of a log that grows by numbered batches: the newest one in ``folder``, merged with the batches after it, is written beside it and returned.

    A snapshot is a folder ``upto=<batch>``, complete when its success file is there; one that was cut off is not seen and is written again.  Without new batches nothing is written.  Batches
    must not change once a later one has been compacted; only the tail of the log is read if it is partitioned by ``batch``.
    """
    spark = log.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [p.getPath() for p in store.listStatus(at)] if store.exists(at) else []
    upto = max((int(p.getName()[5:]) for p in done if p.getName().startswith("upto=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=None)
    tail = log if upto is None else log.where(F.col(batch) > upto)
    new = tail.agg(F.max(batch)).first()[0]
    before = None if upto is None else spark.read.parquet(f"{folder}/upto={upto}")
    if new is None:
        return snapshot(log, key, order, fields) if before is None else before
    some = snapshot(tail, key, order, fields)
    (some if before is None else merged(before, some, key)).write.mode("overwrite").parquet(f"{folder}/upto={new}")
    return spark.read.parquet(f"{folder}/upto={new}")


def as_rows(df: DataFrame, table) -> DataFrame:
    """``df`` with all fields of the job table, in its order; what a job does not have yet is null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.fields))
