"""Structured Streaming: session windows, the job loop, and a keyed rate limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(stream: DataFrame, key: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """(key, start, end, n) of sessions; events exactly ``gap`` apart are one session, as in the batch operator."""
    w = F.session_window(ts, gap)
    g = stream.withWatermark(ts, watermark).groupBy(key, w).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    return g.select(key, "start", "end", "n")


def job_loop(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Run ``handle`` on each batch of new jobs, every ``seconds`` (or once over what is there)."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def allow(times: list[int], limit: int, window: int, count: int = 0, reset: int | None = None) -> tuple[list[bool], int, int | None]:
    """Fixed windows that begin at the first event after the last one ended (strictly later than its end)."""
    out = []
    for t in times:
        if reset is None or t > reset:
            count, reset = 1, t + window
            out.append(True)
        elif count >= limit:
            out.append(False)
        else:
            count += 1
            out.append(True)
    return out, count, reset


def rate_limited(df: DataFrame, key: str, t: str, tie: str, limit: int, window: int) -> DataFrame:
    """Batch: adds ``allowed``.  State is one pair of numbers per key, but a key's rows are read in order by one task; the window begins at
    an event, so which rows open a window can't be told from a row alone."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([t, tie])
        return pdf.assign(allowed=allow(pdf[t].tolist(), limit, window)[0])

    return df.groupBy(key).applyInPandas(run, schema)


def rate_limited_stream(stream: DataFrame, key: str, t: str, limit: int, window: int, forget_ms: int | None = None) -> DataFrame:
    """Streaming: (key, t, allowed); the state of a key is its count and the end of its window.

    With ``forget_ms``, a key without events for so long (of wall time; its window must be over by then) loses its state, so that state doesn't grow with all keys ever seen.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset = state.get if state.exists else (0, -1)
        pdf = pd.concat(list(batches)).sort_values(t)
        flags, count, reset = allow(pdf[t].tolist(), limit, window, count, None if reset < 0 else reset)
        state.update((count, reset))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({key: k[0], t: pdf[t], "allowed": flags})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {t} long, allowed boolean", "count long, reset long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout)


#: What a webhook delivers: one JSON document for each call.
HOOK = "kind string, job_id string, status string, progress double, payload string, received_at timestamp"


def webhooks(spark, path: str, kinds: tuple[str, ...] = ("analysis", "highlight", "upload", "payment")) -> DataFrame:
    """A stream of calls that a receiver writes as JSON lines under ``path``; other kinds and broken lines are left out."""
    return spark.readStream.schema(HOOK).option("mode", "DROPMALFORMED").json(path).where(F.col("kind").isin(*kinds))


def log_sink(records: DataFrame, path: str, checkpoint: str | None = None):
    """Append log records as JSON, in a folder for each level (a reader of errors prunes the rest); a stream needs ``checkpoint``."""
    if records.isStreaming:
        return records.writeStream.format("json").partitionBy("level").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return records.write.mode("append").partitionBy("level").json(path)


class ProgressListener(StreamingQueryListener):
    """Calls ``tell(name, batch, rows)`` after each batch of a stream, and ``tell(name, None, None)`` when it ends."""

    def __init__(self, tell: Callable[[str | None, int | None, int | None], None]):
        self.tell, self.names = tell, {}

    def onQueryStarted(self, event):
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event):
        p = event.progress
        self.tell(p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell(self.names.pop(str(event.id), None), None, None)
