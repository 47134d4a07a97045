"""Exchange of sorted key slices between blocks of documents and ranges of keys.

Documents are dealt into blocks by a hash of their id.  A block reduces its documents to sorted distinct 64-bit keys
and sends each range of the key space one packed slice, so a shuffle moves a few large rows rather than one for each token.
The range merges the slices of all blocks, and answers each with values in the order in which its keys came; keys never
travel back.  A key counts once per block, so however frequent a word or passage is, it can't load one range; blocks and
ranges grow in number with the input and keep their size.

Of n blocks each sends a row to each of n ranges, n * n in all.  Beyond ``DIRECT`` blocks rows pass through relays: a block sends one row to each
of about sqrt(n) bands of ranges, and a relay, which serves about sqrt(n) blocks and one band, sends each range one row for all of them.  That
is 2 * n ** 1.5 rows for twice the bytes; answers go back the same way.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import size_in_bytes

#: Input bytes (as the scan reports them) of one block.
BLOCK_BYTES = 5 << 20
#: Bytes up to which the planner's estimate is taken, and the share of a text's bytes that its file has, about.
SURE, COMPRESSED = 1 << 42, 0.5
#: Blocks up to which they send rows to ranges directly.
DIRECT = 16384
REQUEST = "block int, p int, payload binary"


def number(df: DataFrame) -> int:
    """Blocks for ``df``: by its bytes, and as many as there are slots unless it is tiny.

    Beyond ``SURE`` bytes the estimate may be that of a product of sizes, so the texts are measured instead.
    """
    n = size_in_bytes(df)
    if n > SURE:
        texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
        n = COMPRESSED * (df.select(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(16).cast("long")).alias("n")).agg(F.sum("n")).first()[0] or 0)
    slots = df.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(n / BLOCK_BYTES), min(slots, math.ceil(n / (BLOCK_BYTES >> 5))))


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with an int column ``__block``."""
    return df.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def pack(arrays: list[np.ndarray]) -> bytes:
    head = [struct.pack("<B", len(arrays))]
    return b"".join([*(head + [struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)) for a in arrays]), *(a.tobytes() for a in arrays)])


def unpack(raw: bytes | memoryview) -> list[np.ndarray]:
    n, i, out, kinds = raw[0], 1, [], []
    for _ in range(n):
        kinds.append(struct.unpack_from("<2sI", raw, i))
        i += struct.calcsize("<2sI")
    for code, size in kinds:
        kind = np.dtype("<" + code.decode())
        out.append(np.frombuffer(raw, kind, size, i))
        i += size * kind.itemsize
    return out


def bundle(owner: int, parts: list[tuple[int, bytes]]) -> bytes:
    """Numbered parts of one row; ``owner`` is who they are from, or -1 for rows that go directly."""
    sizes = np.array([len(x) for _, x in parts], np.int64)
    return b"".join([struct.pack("<iI", owner, len(parts)), np.array([i for i, _ in parts], np.int32).tobytes(), sizes.tobytes(), *(x for _, x in parts)])


def unbundle(raw: bytes) -> tuple[int, list[tuple[int, memoryview]]]:
    """The parts are views; nothing is copied."""
    owner, n = struct.unpack_from("<iI", raw)
    at = 8 + 12 * n
    ends = at + np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 4 * n))
    view = memoryview(raw)
    return owner, [(i, view[b - s : b]) for i, s, b in zip(np.frombuffer(raw, np.int32, n, 8).tolist(), np.frombuffer(raw, np.int64, n, 8 + 4 * n).tolist(), ends.tolist())]


def band(n: int) -> int:
    """Blocks of a relay and ranges of a band; 0 where rows go directly."""
    return 0 if n <= DIRECT else math.isqrt(n - 1) + 1


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "p": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _turned(table: pa.Table) -> list[tuple[int, bytes]]:
    """Rows of parts by owner become parts of owners by number."""
    out: dict[int, list] = {}
    for raw in table.column("payload").to_pylist():
        owner, parts = unbundle(raw)
        for i, x in parts:
            out.setdefault(i, []).append((owner, x))
    return sorted(out.items())


#: Low bits of a key in which no two ranges differ, so that the bits above them name the range.
LOW = 24


@functools.lru_cache(2)
def edges(n: int) -> np.ndarray:
    """First key of each of ``n`` equal ranges of the key space; a multiple of ``1 << LOW``.  ``n`` is below 2 ** 24."""
    step, rest = divmod(1 << (64 - LOW), n)
    p = np.arange(n, dtype=np.uint64)
    return (p * np.uint64(step) + (p * np.uint64(rest) + np.uint64(n - 1)) // np.uint64(n)) << np.uint64(LOW)


def requests(docs: DataFrame, ranges: int, emit) -> DataFrame:
    """``emit(table)`` gives (sorted distinct keys, cut); ``cut(a, b)`` gives the arrays to send for keys[a:b]."""
    first, w = edges(ranges), band(ranges)

    def run(table: pa.Table) -> pa.Table:
        keys, cut = emit(table)
        at = [*np.searchsorted(keys, first).tolist(), len(keys)]
        block = table.column("__block")[0].as_py()
        some = [p for p in range(ranges) if at[p + 1] > at[p]]
        if not w:
            return _rows([(block, p, bundle(-1, [(block, pack(cut(at[p], at[p + 1])))])) for p in some])
        bands: dict[int, list] = {}
        for p in some:
            bands.setdefault(p // w, []).append((p, pack(cut(at[p], at[p + 1]))))
        return _rows([(block // w, b, bundle(block, parts)) for b, parts in bands.items()])

    def relay(table: pa.Table) -> pa.Table:
        group = table.column("block")[0].as_py()
        return _rows([(group, p, bundle(group, parts)) for p, parts in _turned(table)])

    out = docs.groupBy("__block").applyInArrow(run, REQUEST)
    return out.groupBy("block", "p").applyInArrow(relay, REQUEST) if w else out


def slices(table: pa.Table) -> list[tuple[int, int, list[np.ndarray]]]:
    """(row, block, arrays) of all blocks that asked one range, in order of the blocks."""
    got = [(row, block, unpack(x)) for row, raw in enumerate(table.column("payload").to_pylist()) for block, x in unbundle(raw)[1]]
    return sorted(got, key=lambda g: g[1])


def replies(asked: DataFrame, ranges: int, merge, side: DataFrame | None = None) -> DataFrame:
    """``merge(p, [arrays of each block])`` gives one list of arrays for each block.

    With ``side``, a frame of (p, payload) with one row for a range at most, the arrays of that row (none: no arrays) are its third argument.
    """
    w = band(ranges)

    def run(table: pa.Table, other: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        got, p = slices(table), table.column("p")[0].as_py()
        parts: list[list] = [[] for _ in range(table.num_rows)]
        more = () if other is None else (unpack(other.column("payload")[0].as_py()) if other.num_rows else [],)
        for (row, block, _), x in zip(got, merge(p, [g[2] for g in got], *more)):
            parts[row].append((block if w else p, pack(x)))
        payload = [bundle(p if w else -1, x) for x in parts]
        return pa.table({"block": table.column("block"), "p": pa.array([p // w if w else p] * len(payload), pa.int32()), "payload": pa.array(payload, pa.binary())})

    def relay(table: pa.Table) -> pa.Table:
        b = table.column("p")[0].as_py()
        return _rows([(block, b, bundle(b, parts)) for block, parts in _turned(table)])

    if side is None:
        out = asked.groupBy("p").applyInArrow(lambda table: run(table), REQUEST)
    else:
        out = asked.groupBy("p").cogroup(side.groupBy("p")).applyInArrow(lambda table, other: run(table, other), REQUEST)
    return out.groupBy("block", "p").applyInArrow(relay, REQUEST) if w else out


def finish(docs: DataFrame, answered: DataFrame, then, schema) -> DataFrame:
    """``then(table, arrays)``: each array of the replies, end to end in the order of the block's keys."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(((p, unpack(x)) for raw in (right.column("payload").to_pylist() if right.num_rows else []) for p, x in unbundle(raw)[1]), key=lambda y: y[0])
        return then(left, [np.concatenate(x) for x in zip(*(x for _, x in parts))])

    return docs.groupBy("__block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that sorts ``keys`` and where each run of equal ones begins in it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def spread(values: np.ndarray, order: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One value of each run, put at all places of that run in the unsorted order."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(begins, len(order))))
    return out


def split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if sizes else []
