"""Copies of whole files between stores, with attempts and waits: fetched from a remote address, or put into a store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stores

#: Defaults: attempts for each file, seconds before the second one (twice as long before each further one), bytes of a read.
ATTEMPTS, WAIT, CHUNK = 3, 1.0, 4 << 20


def read_stream(source: str):
    """A file-like object with ``read(n)``: of http(s) addresses by a plain request, of anything else by pyarrow's file systems."""
    if source.startswith(("http://", "https://")):
        from urllib.request import urlopen

        return urlopen(source, timeout=60)
    store, at = stores.resolve(source)
    return store.open_input_stream(at)


def copy(source: str, target: str, open_source: Callable = read_stream) -> int:
    """Copies to a name of its own beside the target and moves it there, so that a target is never half a file.  Bytes copied; an empty source is an error."""
    store, at = stores.resolve(target)
    folder, _, _ = at.rpartition("/")
    if folder:
        store.create_dir(folder, recursive=True)
    part, total = f"{at}.{uuid.uuid4().hex}.part", 0
    try:
        with open_source(source) as f, store.open_output_stream(part) as out:
            while chunk := f.read(CHUNK):
                out.write(chunk)
                total += len(chunk)
        if not total:
            raise OSError("nothing was read")
        store.move(part, at)
    except BaseException:
        try:
            store.delete_file(part)
        except OSError:
            pass
        raise
    return total


def transferred(rows: DataFrame, source: str, target: str, attempts: int = ATTEMPTS, wait: float = WAIT, open_source: Callable = read_stream) -> DataFrame:
    """The columns of ``rows``, then bytes, tries and error: each row's file is copied where the row is, again after a failure, with longer and longer waits.

    ``error`` is the last failure's text where all attempts failed, and bytes are null there; null names fail at once.  A task that runs again copies again, over the same targets.
    """
    rest = [c for c in rows.columns if c not in ("bytes", "tries", "error")]
    given = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.col(f"`{source}`").cast("string").alias("__s"), F.col(f"`{target}`").cast("string").alias("__t"))
    fields = ", ".join([*(f"c{i} {given.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(rest))), "bytes bigint, tries int, error string"])

    def one(a: str | None, b: str | None) -> tuple:
        if not a or not b:
            return None, 0, "no name"
        for k in range(attempts):
            try:
                return copy(a, b, open_source), k + 1, None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
            if k + 1 < attempts:
                time.sleep(wait * 2**k)
        return None, attempts, error

    def run(batches):
        for batch in batches:
            got = [one(a, b) for a, b in zip(batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist())]
            cols = list(zip(*got)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=[*(f"c{i}" for i in range(len(rest))), "bytes", "tries", "error"])

    return given.mapInArrow(run, fields).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), "bytes", "tries", "error")
