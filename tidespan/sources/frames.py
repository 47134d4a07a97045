"""A data source of frames (``spark.read.format("frames")``), partitioned by ranges of frames, that reads the bytes asked for and no others.

Frames are raw, ``width`` x ``height`` bytes each; a decoder would take the place of ``_cut``.  Bounds of ``frame_idx`` and ``t_sec`` and names of ``video`` in a filter are pushed to the
source (``register`` turns that on), which then opens only those files and only those ranges.  Files are opened where the tasks run, through pyarrow's file systems (local paths and the stores
that those know); ``scan`` reads any store that Spark itself can.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from . import stores

#: Bytes of a partition and of a batch, about.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
SCHEMA = pa.schema([("video", pa.string()), ("frame_idx", pa.int64()), ("t_sec", pa.float64()), ("pixels", pa.binary())])


class FramesSource(DataSource):
    """Options: ``paths`` (files, by commas), ``width``, ``height``, ``fps`` (30), ``skip`` (1), ``begin``, ``stop``, ``part_frames`` (frames of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "video string, frame_idx long, t_sec double, pixels binary"

    def reader(self, schema) -> DataSourceReader:
        return FramesReader(self.options)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    stop: int


def opened(path: str):
    """(size, how to open it) of a path or URI."""
    store, at = stores.resolve(path)
    return store.get_file_info(at).size, lambda: store.open_input_file(at)


class FramesReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.size = int(options["width"]) * int(options["height"])
        self.fps = float(options.get("fps", "0")) or 30.0
        self.skip = int(options.get("skip", "1"))
        self.begin, self.stop = int(options.get("begin", "0")), int(options.get("stop", str(2**62)))
        if self.begin < 0 or self.stop <= self.begin:
            self.begin, self.stop = 0, 2**62  # an invalid range stands for the whole video
        self.low, self.high = self.begin, self.stop  # what filters leave of it
        self.part = int(options.get("part_frames", "0")) or max(1, PART_BYTES // self.size)

    def _first(self, t: float, beyond: bool) -> int:
        """The first frame at ``t`` or later (``beyond``: later than it), as frame / fps is rounded."""
        if not math.isfinite(t) or abs(t * self.fps) >= 2**62:
            return 2**62 if t > 0 or t != t else 0
        i = max(0, math.floor(t * self.fps) - 1)
        while i / self.fps < t or (beyond and i / self.fps == t):
            i += 1
        return i

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute if hasattr(f, "attribute") else ()
            if name == ("video",) and isinstance(f, (EqualTo, EqualNullSafe, In)):
                some = f.value if isinstance(f, In) else [f.value]
                self.paths = [p for p in self.paths if p in some]
            elif name in (("frame_idx",), ("t_sec",)) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                at = (lambda beyond, v=f.value: int(v) + beyond) if name == ("frame_idx",) else (lambda beyond, v=f.value: self._first(float(v), beyond))
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, at(isinstance(f, GreaterThan)))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, at(not isinstance(f, LessThan)))
            elif not (isinstance(f, IsNotNull) and name in (("video",), ("frame_idx",), ("t_sec",))):
                yield f

    def partitions(self) -> list[Range]:
        out = []
        # Every skip-th frame from ``begin`` on, whatever range a filter leaves.
        first = self.begin + -(-max(0, self.low - self.begin) // self.skip) * self.skip
        step = -(-self.part // self.skip) * self.skip
        for path in self.paths:
            stop = min(self.high, opened(path)[0] // self.size)
            out += [Range(path, i, min(stop, i + step)) for i in range(first, stop, step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no partitions at all
            return
        most = max(1, BATCH_BYTES // self.size)
        with opened(partition.path)[1]() as f:
            index, pixels = [], []
            for i, raw in self._cut(f, partition, most):
                index.append(i)
                pixels.append(raw)
                if len(index) == most:
                    yield self._batch(partition.path, index, pixels)
                    index, pixels = [], []
            if index:
                yield self._batch(partition.path, index, pixels)

    def _cut(self, f, partition: Range, most: int) -> Iterator[tuple[int, bytes]]:
        at = range(partition.first, partition.stop, self.skip)
        if self.skip > 1:
            for i in at:
                yield i, f.read_at(self.size, i * self.size)
            return
        for i in range(partition.first, partition.stop, most):
            n = min(most, partition.stop - i)
            raw = f.read_at(n * self.size, i * self.size)
            yield from ((i + k, raw[k * self.size : (k + 1) * self.size]) for k in range(n))

    def _batch(self, path: str, index: list[int], pixels: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(index)), pa.array(index, pa.int64()), pa.array([i / self.fps for i in index]), pa.array(pixels, pa.binary())], schema=SCHEMA)


def scan(spark: SparkSession, path: str, width: int, height: int, fps: float = 30.0, skip: int = 1, begin: int = 0, stop: int | None = None, count: int | None = None) -> DataFrame:
    """The same rows from any store that Spark reads (files of up to 2 GB), cut to frames in the JVM: every ``skip``-th frame of a range (the whole video if the
    range is invalid), or ``count`` evenly spaced ones.  A frame that the file holds in part is left out.
    """
    from ..operators.dataset import sample_positions

    size = width * height
    total = F.floor(F.length("content") / size).cast("int")
    low, high = (begin, stop if stop is not None else 2**31 - 1) if begin >= 0 and (stop is None or stop > begin) else (0, 2**31 - 1)
    some = sample_positions(count, total) if count else F.sequence(F.lit(low), F.least(total, F.lit(high)) - 1, F.lit(skip))
    index = F.when(total > (0 if count else low), some.cast("array<int>")).otherwise(F.array().cast("array<int>"))
    cut = F.transform(index, lambda i: F.struct(i.cast("long").alias("frame_idx"), (i / (fps or 30.0)).alias("t_sec"), F.substring("content", i * size + 1, F.lit(size)).alias("pixels")))
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("video"), F.explode(cut).alias("f")).select("video", "f.*")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FramesSource)
