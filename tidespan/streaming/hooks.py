"""A stream of webhook calls (``spark.readStream.format("hooks")``) from the logs of a receiver, with offsets that can be replayed.

A receiver appends one JSON document for each call to files in a folder.  An offset holds, for each file, the bytes up to the end of its last whole line, so a line that is still being written waits for the
next batch; a batch is the lines between two offsets and is the same however often it is read.  Files only grow or go; one that has gone is no longer in the offset.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import stores
from .streams import HOOK

#: Bytes of a partition.
PART_BYTES = 16 << 20


class HookSource(DataSource):
    """Options: ``path`` (a folder of .jsonl files), ``kinds`` (by commas; none: all), ``part_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "hooks"

    def schema(self) -> str:
        return HOOK

    def streamReader(self, schema) -> DataSourceStreamReader:
        return HookReader(self.options)


@dataclass
class Lines(InputPartition):
    path: str
    first: int
    stop: int


class HookReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.part = options["path"], int(options.get("part_bytes", PART_BYTES))
        self.kinds = {k for k in options.get("kinds", "").split(",") if k}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, at = stores.resolve(self.path)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return {}
        found = (f for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and f.path.endswith(".jsonl"))
        return {f.path: n for f in sorted(found, key=lambda f: f.path) if (n := self._whole(store, f.path, f.size))}

    @staticmethod
    def _whole(store: fs.FileSystem, path: str, size: int) -> int:
        """Bytes up to the end of the last whole line."""
        with store.open_input_file(path) as f:
            end = size
            while end > 0:
                first = max(0, end - (1 << 16))
                if (i := f.read_at(end - first, first).rfind(b"\n")) >= 0:
                    return first + i + 1
                end = first
        return 0

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        return [Lines(path, i, min(stop, i + self.part)) for path, stop in end.items() for i in range(start.get(path, 0), stop, self.part)]

    def read(self, partition: Lines | None) -> Iterator[tuple]:
        """Calls whose lines begin in the partition; lines that aren't JSON objects, and other kinds, are left out."""
        if partition is None:
            return
        store, at = stores.resolve(self.path)
        with store.open_input_file(partition.path) as f:
            first = partition.first
            f.seek(max(0, first - 1))
            if first and f.read(1) != b"\n":
                first += len(self._line(f)) if first < partition.stop else 0
            while first < partition.stop:
                line = self._line(f)
                if not line:
                    return
                first += len(line)
                if (row := self._call(line)) and (not self.kinds or row[0] in self.kinds):
                    yield row

    @staticmethod
    def _line(f) -> bytes:
        out = bytearray()
        at = f.tell()
        while not out.endswith(b"\n"):
            more = f.read(1 << 12)
            if not more:
                break
            i = more.find(b"\n")
            out += more if i < 0 else more[: i + 1]
        f.seek(at + len(out))
        return bytes(out)

    @staticmethod
    def _call(line: bytes) -> tuple | None:
        try:
            x = json.loads(line)
            at = x.get("received_at")
            when = None if at is None else datetime.fromisoformat(at)
            progress = x.get("progress")
            text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
            return (text(x.get("kind")), text(x.get("job_id")), text(x.get("status")), None if progress is None else float(progress), text(x.get("payload")), when if when is None or when.tzinfo else when.replace(tzinfo=timezone.utc))
        except (ValueError, AttributeError, TypeError):
            return None

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HookSource)
