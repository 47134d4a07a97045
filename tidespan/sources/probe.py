"""Duration and frame rate of MP4 files, from the few bytes of their header boxes.

A box is a size, a four-letter name and its content.  Boxes are stepped over until ``moov`` comes, whether it is at the start or the end of the file, so that a file of any size costs some
reads of a few bytes; its sound and pictures are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import opened

OUT = "path string, duration double, fps double, width int, height int"
#: Bytes of the ``moov`` box that are read at most, a safeguard against broken sizes (an hour of video has about 1 MB).
MOST = 256 << 20


def boxes(read, first: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte of the content, byte after it) of the boxes from ``first`` to ``stop``; ends at one that can't be."""
    at = first
    while at + 8 <= stop:
        size, name = struct.unpack(">I4s", read(8, at))
        head = 8
        if size == 1:
            if at + 16 > stop:
                return
            size, head = struct.unpack(">Q", read(8, at + 8))[0], 16
        end = stop if size == 0 else at + size
        if end > stop or end < at + head:
            return
        yield name, at + head, end
        at = end


def header(read, size: int) -> dict | None:
    """duration (seconds), and fps, width and height of the first track of pictures, where they are known; None for a file without a header."""
    moov = next(((a, b) for name, a, b in boxes(read, 0, size) if name == b"moov"), None)
    if moov is None or moov[1] - moov[0] > MOST:
        return None
    raw = read(moov[1] - moov[0], moov[0])
    part = lambda n, at: raw[at : at + n]
    out = {"duration": None, "fps": None, "width": None, "height": None}
    for name, a, b in boxes(part, 0, len(raw)):
        if name == b"mvhd":
            rate, length = _clock(raw, a)
            out["duration"] = length / rate if rate else None
        elif name == b"trak" and out["width"] is None:
            out |= _track(raw, part, a, b)
    return out


def _clock(raw: bytes, at: int) -> tuple[int, int]:
    """Ticks a second and length in ticks; both forms of the box."""
    return struct.unpack_from(">IQ", raw, at + 20) if raw[at] else struct.unpack_from(">II", raw, at + 12)


def _track(raw: bytes, part, first: int, stop: int) -> dict:
    found = {}
    todo = [(first, stop)]
    while todo:
        a, b = todo.pop()
        for name, x, y in boxes(part, a, b):
            found.setdefault(name, (x, y))
            if name in (b"mdia", b"minf", b"stbl"):
                todo.append((x, y))
    if b"hdlr" not in found or part(4, found[b"hdlr"][0] + 8) != b"vide":
        return {}
    out = {}
    if b"tkhd" in found:
        width, height = struct.unpack_from(">II", raw, found[b"tkhd"][1] - 8)
        out = {"width": width >> 16, "height": height >> 16}
    if b"mdhd" in found and b"stts" in found:
        rate, length = _clock(raw, found[b"mdhd"][0])
        at = found[b"stts"][0]
        frames = sum(struct.unpack_from(">I", raw, at + 8 + 8 * i)[0] for i in range(struct.unpack_from(">I", raw, at + 4)[0]))
        out["fps"] = frames * rate / length if length and frames else None
    return out


def durations(files: DataFrame, path: str = "path") -> DataFrame:
    """The columns of ``files``, then duration, fps, width and height; all null where a file is missing, or has no header that can be read."""
    rest = [c for c in files.columns if c not in ("duration", "fps", "width", "height")]

    def one(at: str | None) -> dict:
        try:
            size, make = opened(at)
            with make() as f:
                return header(lambda n, i: f.read_at(n, i), size) or {}
        except (OSError, ValueError, TypeError, struct.error):
            return {}

    def run(batches):
        for b in batches:
            got = [one(x) for x in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([g.get(n) for g in got], t) for n, t in (("duration", pa.float64()), ("fps", pa.float64()), ("width", pa.int32()), ("height", pa.int32())))], names=[*(f"c{i}" for i in range(len(rest))), "duration", "fps", "width", "height"])

    given = files.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.col(f"`{path}`").alias("__p"))
    fields = ", ".join([*(f"c{i} {given.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(rest))), "duration double, fps double, width int, height int"])
    return given.mapInArrow(run, fields).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), "duration", "fps", "width", "height")
