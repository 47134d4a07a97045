"""A sink for clips with a commit (``df.write.format("clips")``): what a job wrote is there as a whole or not at all.

Each attempt of a task writes clips and a list of them into a folder of its own.  Only when all tasks are done does the driver write one manifest, by a rename, that names the
attempts that count; a reader sees clips through manifests.  Attempts that failed or ran twice are named by none.  A job that is given a name writes once: if a manifest of that name
is there, a second run adds nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import stores

#: Fixed value: bytes below which a clip counts as failed.
LEAST_BYTES = 1000
LISTED = "video string, clip string, start double, end double, bytes long"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    clips: int
    bytes: int


class ClipSink(DataSource):
    """Rows: video, clip (its name), start, end, content.  Options: ``path``, ``job`` (a name; none: one of its own), ``least_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "clips"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("clips are only appended")
        if missing := {"video", "clip", "start", "end", "content"} - set(schema.names):
            raise ValueError(f"rows lack {', '.join(sorted(missing))}")
        return ClipWriter(self.options)


class ClipWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.job = options["path"].rstrip("/"), options.get("job") or uuid.uuid4().hex
        self.least = int(options.get("least_bytes", LEAST_BYTES))
        if "/" in self.job:
            raise ValueError("a job's name is part of a file's name")

    def write(self, iterator) -> Attempt:
        """A clip below ``least_bytes`` is left out, as one that failed; a row without content or name is an error."""
        store, at = stores.resolve(self.path)
        folder = f"{self.job}-{uuid.uuid4().hex}"
        store.create_dir(f"{at}/clips/{folder}", recursive=True)
        lines, total = [], 0
        for i, row in enumerate(iterator):
            if row["content"] is None or not row["clip"]:
                raise ValueError("a clip without content or name")
            size = len(row["content"])
            if size < self.least:
                continue
            name = f"clips/{folder}/{i:06d}-{row['clip'].replace('/', '_')}"
            with store.open_output_stream(f"{at}/{name}") as f:
                f.write(bytes(row["content"]))
            lines.append(json.dumps({"video": row["video"], "clip": name, "start": row["start"], "end": row["end"], "bytes": size}))
            total += size
        with store.open_output_stream(f"{at}/clips/{folder}/list.json") as f:
            f.write("".join(x + "\n" for x in lines).encode())
        return Attempt(folder, len(lines), total)

    def _manifest(self, at: str) -> str:
        return f"{at}/manifests/{self.job}.json"

    def commit(self, messages) -> None:
        store, at = stores.resolve(self.path)
        if store.get_file_info(self._manifest(at)).type != fs.FileType.NotFound:
            self.abort(messages)
            return
        store.create_dir(f"{at}/manifests", recursive=True)
        temp = f"{at}/manifests/.{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as f:
            for m in messages:
                f.write((json.dumps({"job": self.job, "folder": m.folder, "clips": m.clips, "bytes": m.bytes}) + "\n").encode())
        store.move(temp, self._manifest(at))

    def abort(self, messages) -> None:
        """Folders of attempts that are known go; of others no manifest speaks."""
        store, at = stores.resolve(self.path)
        for m in messages:
            if m is not None and store.get_file_info(f"{at}/clips/{m.folder}").type != fs.FileType.NotFound:
                store.delete_dir(f"{at}/clips/{m.folder}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(job, video, clip, start, end, bytes) of all clips that a manifest stands for."""
    names = spark.read.schema("job string, folder string, clips long, bytes long").json(f"{path}/manifests/*.json")
    listed = spark.read.schema(LISTED).json(f"{path}/clips/*/list.json").withColumn("folder", F.element_at(F.split("clip", "/"), -2))
    return listed.join(names.select("job", "folder"), "folder").select("job", "video", "clip", "start", "end", "bytes")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipSink)
