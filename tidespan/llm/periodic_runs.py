"""Periodic runs of words: stretches that repeat one passage at least four times in a row, found by string synchronising sets.

For each scale tau = 4, 8, 16, ... a hash names the window of tau words at every position, and a position is *synchronising* if its name, or that tau words
on, is the least of the tau + 1 names between them.  Whether it is depends on the 2 * tau words from it alone, so equal contexts choose equal places, and any tau positions in a
row hold one unless the words around them have a period of at most tau / 4.  Such highly periodic regions are left out of the names of a scale: the runs that
make them up were found at a smaller scale or, for periods of 1 to 3 words, by comparing words directly.  A run of period q, tau <= q < 2 * tau, then
has a synchronising position in its first tau words, and the next one with the same context lies exactly q words on; so pairs of neighbours with equal contexts
propose every period, and each proposal is extended word by word, which is exact.  All of it is linear in the words for each scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

U64 = np.uint64
#: Bytes of text that are worked on at once (or one longer document).
SLICE = 1 << 21
NEVER = U64(2**64 - 1)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(h: np.ndarray, doc: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the longest stretches whose words equal those ``q`` on."""
    same = np.zeros(max(0, len(h) - q) + 2, np.int8)
    if len(h) > q:
        same[1:-1] = (h[:-q] == h[q:]) & (doc[:-q] == doc[q:])
    edge = np.flatnonzero(np.diff(same))
    return edge[::2], edge[1::2] - edge[::2] + q


def _reach(h: np.ndarray, x: np.ndarray, room: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """How many positions from ``x`` on, going by ``step`` and at most ``room``, have the word of ``q`` positions on."""
    out, at, k = np.zeros(len(x), np.int64), np.flatnonzero(room > 0), 8
    while len(at):
        go = out[at, None] + np.arange(k)
        inside = go < room[at, None]
        place = x[at, None] + step * np.where(inside, go, 0)
        ok = inside & (h[place] == h[place + q[at, None]])
        far = np.where(ok.all(1), k, ok.argmin(1))
        out[at] += far
        at, k = at[far == k], min(2 * k, 256)
    return out


def find(h: np.ndarray, at: np.ndarray, least: int = 6, power: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of documents given by word hashes and n+1 word offsets: document, start (word of the document), length, period; by document, start and period.

    A run is longest, has its smallest period, and holds at least ``least`` words and ``power`` (4 or more) periods.
    """
    doc, rows = T.doc_of(at), []

    def keep(start, length, period):
        long = length >= np.maximum(least, power * period)
        rows.append(np.stack([start, length, np.broadcast_to(period, start.shape)])[:, long])

    for q in (1, 2, 3):
        start, length = _stretches(h, doc, q)
        keep(start, length, np.int64(q))
    tau, size = 4, np.diff(at)
    place, name, span = np.arange(len(h)), h, 1
    while len(place) and (size >= power * tau).any():
        use = (size >= power * tau)[doc[place]]
        if not use.all():
            place, name = place[use], name[use]
        n = len(place)
        while span < tau:
            name = _double(name, span)
            span *= 2
        context = _double(name, tau)
        # Highly periodic windows have no name: those inside a run, found already, of at most tau / 4.
        local = np.concatenate([[0], np.cumsum(np.bincount(doc[place], minlength=len(size)))])  # first place of each document that is left
        known = np.concatenate(rows, 1)
        known = known[:, (known[2] * 4 <= tau) & (known[1] >= tau)]
        change = np.zeros(n + 1, np.int64)
        first = local[doc[known[0]]] + known[0] - at[doc[known[0]]]
        fits = first + known[1] - tau + 1 <= n
        whole = size[doc[known[0]]] >= power * tau
        np.add.at(change, first[whole & fits], 1)
        np.add.at(change, (first + known[1] - tau + 1)[whole & fits], -1)
        given = np.where(np.cumsum(change[:n]) > 0, NEVER, name)
        low, width = given, 1
        while width < tau:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[:-1], low[1:]) if len(low) > 1 else low[:0]
        i = np.arange(len(low))
        i = i[((given[: len(low)] == low) | (given[tau : tau + len(low)] == low)) & (low != NEVER)]
        i = i[place[i] + 2 * tau <= at[doc[place[i]] + 1]]
        order = np.argsort(context[i], kind="stable")
        a, b = i[order[:-1]], i[order[1:]]
        near = (context[a] == context[b]) & (b - a >= tau) & (b - a < 2 * tau)
        near[near] &= doc[place[a[near]]] == doc[place[b[near]]]
        a, q = place[a[near]], (b - a)[near]
        if len(a):
            # Proposals of one period whose contexts touch belong to one stretch.
            order = np.lexsort((a, q))
            a, q = a[order], q[order]
            new = np.ones(len(a), bool)
            new[1:] = (q[1:] != q[:-1]) | (a[1:] > a[:-1] + 2 * tau)
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(a)) - 1
            begin, end, q = a[head], a[last] + 2 * tau, q[head]
            d = doc[begin]
            left = _reach(h, begin - 1, begin - at[d], q, -1)
            # Words are compared from the first proposal on, so a stretch never rests on equal hashes of windows.
            right = _reach(h, begin, at[d + 1] - q - begin, q, 1)
            odd = right < end - begin
            for x, p in zip(d[odd].tolist(), q[odd].tolist()):  # two windows with one hash: look at the whole document
                s, l = _stretches(h[at[x] : at[x + 1]], doc[at[x] : at[x + 1]], p)
                keep(s + at[x], l, np.int64(p))
            keep((begin - left)[~odd], (left + right + q)[~odd], q[~odd])
        name, span, tau = context, 2 * tau, 2 * tau
    start, length, period = np.concatenate(rows, 1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # the same stretch again, by the same or a multiple of its smallest period
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    own = doc[start] if len(start) else np.zeros(0, np.int64)
    return own, start - at[own], length, period


def _double(name: np.ndarray, span: int) -> np.ndarray:
    """Names of windows of twice the length; those that reach beyond the end are of no use."""
    out = name * T.ODD[700]
    out[: len(out) - span] += name[span:] * T.ODD[701]
    return T.mix(out)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    n = np.add.reduceat(np.append(kept, 0), at[:-1]) * (np.diff(at) > 0) if len(at) > 1 else np.zeros(0, int)
    starts, size = starts[kept], (ends - starts)[kept] + 1
    last = np.cumsum(n)[n > 0] - 1
    size[last] -= 1  # no space after the last word
    edge = np.concatenate([[0], np.cumsum(size)])
    # Every byte comes from where its word begins plus its place in the word; the byte after a word is a space.
    source = np.arange(edge[-1]) + np.repeat(starts - edge[:-1], size)
    out = data[np.minimum(source, max(0, len(data) - 1))] if len(source) else np.zeros(0, np.uint8)
    out = out.copy()
    space = np.ones(len(size), bool)
    space[last] = False
    out[edge[1:][space] - 1] = 0x20
    offsets = edge[np.concatenate([[0], np.cumsum(n)])]
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    _, offsets = T.buffer(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield texts.slice(a, b - a)
        a = b


def detect(docs: DataFrame, text: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """The columns of ``docs`` without ``text``, then n_words, runs and collapsed; columns of ``docs`` with one of these names are replaced.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``runs`` holds (start, length, period) of each run, in words from 0, by start and then period; ``collapsed`` the words, joined by one
    space, that no run contains after its first period.  A null or empty text has no words, no runs and an empty ``collapsed``.  Documents don't meet: there is no shuffle, and rows
    with equal ids or texts are answered one by one.  A task needs about 200 bytes for each word of its longest document beside ``SLICE`` bytes of texts.
    """
    added = ("n_words", "runs", "collapsed")
    rest = [c for c in docs.columns if c != text and c not in added]
    given = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.col(f"`{text}`").cast("string").alias("__text"))
    fields = ", ".join([*(f"c{i} {given.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(rest))), f"n_words bigint, runs {RUNS}, collapsed string"])

    def run(batches):
        for batch in batches:
            out = []
            for part in _slices(batch.column(len(rest)), SLICE):
                data, offsets = T.buffer(part)
                starts, ends, at = T.spans(data, offsets)
                d, start, length, period = find(T.hashes(data, starts, ends), at, least, power)
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, at[d] + start + period, 1)
                np.add.at(change, at[d] + start + length, -1)
                kept = np.cumsum(change)[:-1] == 0
                list_at = np.searchsorted(d, np.arange(len(at))).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(list_at), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], names=["start", "length", "period"]))
                out.append((pa.array(np.diff(at).astype(np.int64)), runs, _joined(data, starts, ends, at, kept).cast(pa.string())))
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.concat_arrays(list(x)) for x in zip(*out))], names=[*(f"c{i}" for i in range(len(rest))), *added])

    return given.mapInArrow(run, fields).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), *added)


def strongest(runs) -> "F.Column":
    """The run with the greatest length / period, compared exactly; of equals the first."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, none, lambda a, b: F.when(better(a, b), b).otherwise(a))


def listed(runs) -> "F.Column":
    """One line ``start,length,period`` for each run."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
