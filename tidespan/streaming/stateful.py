"""Streams whose operators keep state: hysteresis runs and the rate limiter, in event time.

A key's rows may come late and out of order within the watermark.  They wait in a list state until the watermark has passed them, then go through the operator's step in
order; so the results are those of the batch operators, whatever the micro-batches, and a restart goes on from the checkpoint.  One event-time timer for each key stands for
what is next: the earliest row that waits, or the time at which the key's state may be forgotten.  Both need the RocksDB state store (``enable``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder(StatefulProcessor):
    """Rows (micros, ...) of a key in order of time; ``step`` gets the state and one row, and gives the new state and the rows to put out."""

    row: str  # fields that wait; the first is ``us long``
    kept: str  # fields of the state
    forget_us: int  # the state goes when the watermark is so far beyond the key's last row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.state = handle.getValueState("state", self.kept + ", last_us long")
        self.timer = handle.getValueState("timer", "ms long")

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def end(self, state: tuple) -> list[tuple]:
        """Rows to put out when the state is forgotten."""
        return []

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=self.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = [tuple(x.item() if hasattr(x, "item") else x for x in r) for pdf in rows for r in pdf[self.columns].itertuples(index=False)]
        self.waiting.appendList(some)
        self._next(min(r[0] for r in some) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: tuple((x is None, x) for x in r))
        now, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        held = self.state.get() if self.state.exists() else None
        state, last, out = (tuple(held[:-1]), held[-1], []) if held else (None, None, [])
        for r in now:
            if last is not None and r[0] - last > self.forget_us:  # as if the timer had come between them
                out += self.end(state)
                state = None
            state, more = self.step(state, r)
            last = r[0]
            out += more
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if state is not None and mark - last > self.forget_us:
            out += self.end(state)
            state = None
        if state is None:
            self.state.clear()
        else:
            self.state.update((*state, last))
        if later:
            self._next(later[0][0] // 1000 + 1)
        elif state is not None:
            self._next((last + self.forget_us) // 1000 + 1)
        yield self.frame(key, out)

    def _next(self, ms: int) -> None:
        """Only the earliest timer of a key stands."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and old <= ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def close(self) -> None:
        pass


class Limiter(InOrder):
    row, kept, columns, names = "us long, tie long", "n long, upto long", ["us", "tie"], ["key", "us", "tie", "allowed"]

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us, self.forget_us = limit, window_us, window_us

    def step(self, state, row):
        us, tie = row[0], row[1]
        if state is None or us > state[1]:
            return (1, us + self.window_us), [(us, tie, True)]
        if state[0] >= self.limit:
            return state, [(us, tie, False)]
        return (state[0] + 1, state[1]), [(us, tie, True)]


class Hysteresis(InOrder):
    row, kept, columns, names = "us long, i long, moving boolean", "first long, last long, open boolean", ["us", "i", "moving"], ["key", "first", "last", "closed"]

    def __init__(self, still: int, forget_us: int):
        self.still, self.forget_us = still, forget_us

    def step(self, state, row):
        i, moving = row[1], row[2]
        first, last, is_open = state or (0, 0, False)
        out = []
        if is_open and i - last >= self.still and not (moving and i - last == self.still):
            out, is_open = [(first, last, last + self.still)], False
        if moving:
            first, last, is_open = (first if is_open else i), i, True
        return (first, last, is_open), out

    def end(self, state):
        return [(state[0], state[1], None)] if state[2] else []


def limited(stream: DataFrame, key: str, ts: str, tie: str, limit: int, window_us: int, late: str) -> DataFrame:
    """(key, us, tie, allowed), as ``limits.rate_limited`` has them, once the watermark has passed a row; rows later than ``late`` are dropped by it.

    A key's state goes when its window is over.  Rows with a null key or time are left out.
    """
    x = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    x = x.select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_micros(ts).alias("us"), F.col(tie).cast("long").alias("tie"))
    return x.groupBy("key").transformWithStateInPandas(Limiter(limit, window_us), "key string, us long, tie long, allowed boolean", "Append", "EventTime")


def runs(stream: DataFrame, key: str, ts: str, index: str, moving: str, still: int, late: str, forget_us: int) -> DataFrame:
    """(key, first, last, closed), as ``motion.hysteresis_runs`` has them: a run is put out when ``still`` samples without movement close it, or with a null ``closed`` when its video has had no samples for ``forget_us`` of event time."""
    x = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    x = x.select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_micros(ts).alias("us"), F.col(index).cast("long").alias("i"), F.col(moving).alias("moving"))
    return x.groupBy("key").transformWithStateInPandas(Hysteresis(still, forget_us), "key string, first long, last long, closed long", "Append", "EventTime")
