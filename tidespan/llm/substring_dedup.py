"""Removal of long repeated word sequences by recompression.

Each round names runs of one symbol and then pairs whose first symbol falls on the left side and whose second falls on the
right side of a hashed split.  A name is a hash of what it stands for, so it is global without a naming table: equal substrings
get the same symbols except near their ends.  For each symbol we keep its *support*, the words that settled it; a
symbol is interior to a window if its support lies in it, and then every copy of that window has the symbol too.  So a
window can only repeat if all its interior symbols occur in another document.  What is left after that exchange is verified window by
window in a second one, on 128 bits of two hashes of the words themselves that have nothing in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import blocks, common
from . import text as T

U64 = np.uint64


def recompress(h: np.ndarray, at: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after ``rounds`` rounds: name, first and last+1 word of the support, document.

    A document's border counts as one unseen neighbour: supports there reach one word beyond it.
    """
    doc = T.doc_of(at)
    sym, lo, hi = h, np.arange(len(h)), np.arange(1, len(h) + 1)
    for r in range(rounds):
        for pairs in (False, True):
            n = len(sym)
            if not n:
                break
            same = doc[1:] == doc[:-1]
            join = np.zeros(n, bool)  # this symbol goes on the one before
            if pairs:
                side = (T.mix(sym ^ T.ODD[200 + r]) & U64(1)).astype(bool)
                join[1:] = side[:-1] & ~side[1:] & same
            else:
                join[1:] = (sym[1:] == sym[:-1]) & same
            first = np.flatnonzero(~join)
            last = np.append(first[1:], n) - 1
            name = sym[first].copy()
            many = np.flatnonzero(last > first)
            if pairs:
                name[many] = T.mix(sym[first[many]] * T.ODD[300 + r] + sym[last[many]] * T.ODD[400 + r])
            else:
                name[many] = T.mix(name[many] * T.ODD[500 + r] + (last - first)[many].astype(U64) * T.ODD[600 + r])
            d = doc[first]
            left, right = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
            lo = np.where((first > 0) & (doc[left] == d), lo[left], at[d] - 1)
            hi = np.where((last < n - 1) & (doc[right] == d), hi[right], at[d + 1] + 1)
            sym, doc = name, d
    return sym, lo, hi, doc


def depth(window: int) -> int:
    """Rounds after which a support is expected to cover at most 0.6 of a window, so that windows have interior symbols.

    A round makes symbols 4/3 as long, and adds a neighbour at each side for runs and for pairs.
    """
    r, length, support = 0, 1.0, 1.0
    while True:
        length, support = length * 4 / 3, support + length / 3 + 4 * length
        if support > 0.6 * window:
            return r
        r += 1


def _long(table: pa.Table, window: int, other: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, offsets, and ids (null: none) of a block; documents that hold no window are emptied.

    ``other``: a second hash of each word, over byte values of its own.
    """
    h, at = T.words(table.column("__text"), other=other)
    ids = table.column("__id")
    n = np.diff(at)
    use = (n >= window) & ids.is_valid().to_numpy()
    h = h[np.repeat(use, n)]
    at = np.concatenate([[0], np.cumsum(np.where(use, n, 0))])
    return h, at, ids.fill_null(0).to_numpy()


def _symbols(table: pa.Table, window: int, rounds: int):
    h, at, _ = _long(table, window)
    sym, lo, hi, doc = recompress(h, at, rounds)
    order, begin = blocks.runs(sym)
    end = np.append(begin[1:], len(order)) - 1
    several = (doc[order[begin]] != doc[order[end]]).astype(np.uint8) if len(order) else np.zeros(0, np.uint8)
    return sym[order[begin]], several, (at, lo, hi, order, begin)


def _candidates(table: pa.Table, shared: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the windows all whose interior symbols occur in another document, and the word offsets."""
    _, _, (at, lo, hi, order, begin) = _symbols(table, window, rounds)
    n = int(at[-1])
    alone = ~blocks.spread(shared.astype(bool), order, begin) if len(order) else np.zeros(0, bool)
    doc = np.searchsorted(at, np.maximum(lo, 0), "right") - 1
    inside = alone & (hi - lo <= window) & (lo >= 0)
    inside[inside] &= (lo[inside] >= at[doc[inside]]) & (hi[inside] <= at[doc[inside] + 1])
    change = np.zeros(n + 2, np.int64)
    np.add.at(change, np.maximum(hi[inside] - window, at[doc[inside]]), 1)
    np.add.at(change, lo[inside] + 1, -1)
    ok = np.cumsum(change)[:n] == 0
    place = np.arange(n)
    return ok & (place + window <= np.repeat(at[1:], np.diff(at))), at


def _window_keys(table: pa.Table, window: int):
    """Distinct candidate windows of a block with check hash and smallest id; and all candidates' ids, spots and order."""
    h, at, ids = _long(table, window)
    ranges = table.column("__ranges").to_pylist()
    spots = [np.zeros(0, np.int64)]
    docs = [np.zeros(0, np.int64)]
    for i in sorted(range(len(ranges)), key=lambda i: int(ids[i])):
        for a, b in zip(ranges[i][::2], ranges[i][1::2]):
            spots.append(np.arange(at[i] + a, at[i] + b))
            docs.append(np.full(b - a, i))
    spot, doc = np.concatenate(spots), np.concatenate(docs)
    key = T.windows(h, window)[spot] if len(spot) else np.zeros(0, U64)
    check = T.windows(_long(table, window, other=True)[0], window)[spot] if len(spot) else np.zeros(0, U64)
    order, begin = blocks.runs(key)  # stable, and spots come by id: a run begins with its smallest id
    return key[order[begin]], check[order[begin]], ids[doc[order[begin]]], (at, ids, spot, doc, check, order, begin)


def _merge_windows(_, got: list) -> list:
    sizes = [len(g[0]) for g in got]
    key, check, low = (np.concatenate([g[i] for g in got]) for i in range(3))
    order = np.lexsort((check, key)) if len(key) else np.zeros(0, int)
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    begin = np.flatnonzero(new)
    least = blocks.spread(np.minimum.reduceat(low[order], begin), order, begin) if len(begin) else low
    return [[np.packbits(x)] for x in blocks.split(least < low, sizes)]


def _bits(replies: list, counts: np.ndarray) -> np.ndarray:
    """Unpack bit replies that were padded to whole bytes for each range."""
    if not replies:
        return np.zeros(0, bool)
    raw, out, i = replies[0], [], 0
    for n in counts:
        size = (n + 7) // 8
        out.append(np.unpackbits(raw[i : i + size], count=n))
        i += size
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def _counts(keys: np.ndarray, ranges: int) -> np.ndarray:
    at = np.append(np.searchsorted(keys, blocks.edges(ranges)), len(keys))
    return np.diff(at)


def dedup(docs: DataFrame, window: int = 50, text: str = "text", doc_id: str = "doc_id", rounds: int | None = None, texts: bool = False) -> DataFrame:
    """Each document without the words of any ``window``-word sequence that also starts in a document of smaller id.

    Columns: ``doc_id``, n_words, n_removed, spans (word positions [from, to) that go, flat), kept_sha256 (of the kept words joined by one space).  With ``texts``, all
    columns of ``docs`` instead, ``text`` replaced by the kept words joined by one space where something was removed and unchanged
    elsewhere, and n_removed.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null text has no words (and stays null); windows are judged on the input.  Rows with one id are no repeats
    of each other; a row with a null id is kept whole and removes nothing.  Ties can't occur, as only a smaller id removes.
    """
    spark = docs.sparkSession
    n = blocks.number(docs)
    rounds = depth(window) if rounds is None else rounds
    rest = list(docs.columns) if texts else [doc_id]
    inner = {c: f"c{i}" for i, c in enumerate(rest)}
    cols = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"), *(F.col(c).alias(v) for c, v in inner.items() if c != text))
    given = [c for c in cols.columns if c not in ("__id", "__text")]
    dealt = blocks.dealt(cols, "__id", n)

    def emit(table):
        keys, several, _ = _symbols(table, window, rounds)
        return keys, lambda a, b: [keys[a:b], several[a:b]]

    def merge(_, got):
        sizes = [len(g[0]) for g in got]
        key, several = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order, begin = blocks.runs(key)
        count = np.diff(np.append(begin, len(order)))
        shared = (count > 1) | (np.maximum.reduceat(several[order], begin) > 0)
        return [[x] for x in blocks.split(blocks.spread(shared.astype(np.uint8), order, begin), sizes)]

    base = dealt.schema
    middle = S.StructType([*(base[c] for c in ("__block", "__id", *given)), S.StructField("__text", S.StringType()), S.StructField("__ranges", S.ArrayType(S.IntegerType())), S.StructField("n_words", S.LongType()), S.StructField("kept_sha256", S.StringType())])

    def narrow(table, answer):
        if not table.num_rows:
            return None
        ok, at = _candidates(table, answer[0] if answer else np.zeros(0, np.uint8), window, rounds)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
        doc = np.searchsorted(at, edge[::2], "right") - 1
        ranges = [[] for _ in range(table.num_rows)]
        for d, a, b in zip(doc.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
            ranges[d] += [a - int(at[d]), b - int(at[d])]
        words, sha, keep = [], [], []
        for t, r in zip(table.column("__text").to_pylist(), ranges):
            w = (t or "").encode().split()
            words.append(len(w))
            sha.append(None if r or texts else hashlib.sha256(b" ".join(w)).hexdigest())
            keep.append(t if r or texts else None)
        return pa.table([*(table.column(c) for c in ("__block", "__id", *given)), pa.array(keep, pa.string()), pa.array(ranges, pa.list_(pa.int32())), pa.array(words, pa.int64()), pa.array(sha, pa.string())], names=middle.names)

    asked = blocks.requests(dealt, n, emit)
    found = blocks.finish(dealt, blocks.replies(asked, n, merge), _or_empty(narrow, middle), middle)
    found = common.materialize(found, "substring")
    common.release(spark)
    has = F.size("__ranges") > 0

    def emit_windows(table):
        keys, check, low, _ = _window_keys(table, window)
        return keys, lambda a, b: [keys[a:b], check[a:b], low[a:b]]

    out_fields = [*(base[c] for c in given), S.StructField("__text", S.StringType()), S.StructField("n_words", S.LongType()), S.StructField("n_removed", S.LongType()), S.StructField("spans", S.ArrayType(S.IntegerType())), S.StructField("kept_sha256", S.StringType())]
    schema = S.StructType(out_fields)

    def cut(table, answer):
        keys, check, low, (at, ids, spot, doc, each, order, begin) = _window_keys(table, window)
        earlier = _bits(answer, _counts(keys, n))
        gone = blocks.spread(earlier, order, begin) | (blocks.spread(low, order, begin) < ids[doc])
        gone &= blocks.spread(check, order, begin) == each
        change = np.zeros(int(at[-1]) + window + 1, np.int64)
        np.add.at(change, spot[gone], 1)
        np.add.at(change, spot[gone] + window, -1)
        covered = np.cumsum(change)[: int(at[-1])] > 0
        texts_out, removed, spans, sha = [], [], [], []
        for i, t in enumerate(table.column("__text").to_pylist()):
            c = covered[at[i] : at[i + 1]]
            w = t.encode().split()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
            left = b" ".join(x for x, y in zip(w, c.tolist()) if not y) if len(edge) else b" ".join(w)
            texts_out.append(None if not texts else left.decode() if len(edge) else t)
            removed.append(int(c.sum()))
            spans.append(edge.tolist())
            sha.append(hashlib.sha256(left).hexdigest())
        return pa.table([*(table.column(c) for c in given), pa.array(texts_out, pa.string()), table.column("n_words"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(sha, pa.string())], names=schema.names)

    some = found.where(has)
    cleaned = blocks.finish(some, blocks.replies(blocks.requests(some, n, emit_windows), n, _merge_windows), _or_empty(cut, schema), schema)
    others = found.where(~has).select(*given, "__text", "n_words", F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<int>").alias("spans"), "kept_sha256")
    out = cleaned.union(others)
    if not texts:
        return out.select(F.col(inner[doc_id]).alias(doc_id), "n_words", "n_removed", "spans", "kept_sha256")
    return out.select(*(F.col("__text" if c == text else v).alias(c) for c, v in inner.items()), *(["n_removed"] if "n_removed" not in inner else []))


def _or_empty(f, schema: S.StructType):
    """No rows for a block without documents."""
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema)
    return lambda table, answer: f(table, answer) if table.num_rows else empty.empty_table()
