"""A hierarchical Pitman-Yor language model over words, with Chinese-restaurant seating sampled by Gibbs.

The root restaurant serves every word.  Below it is one restaurant for each word that comes before another (and one for the beginning of a text), told apart
by 40 bits of its hash; all of them order their dishes from the root, their shared parent, and the root from a uniform base over the known words and
one unknown.  Restaurants and dishes grow with the corpus and stay distributed; nothing but a few scalars reaches the driver.

Seating: a sweep draws the number of tables of every dish that can have more than one, given the tables of all others as the last sweep left
them (``draw_tables``).  Dishes of one word lie in the range of that word.  Between sweeps the ranges exchange exact sums of the tables of each
restaurant, and the root's totals are sums over all ranges.  Random numbers are hashes of (word, restaurant, sweep, seed), so the seating
doesn't depend on the number of blocks, ranges or executors.

Averages: of each kept sweep the expected table counts given the rest are averaged, rather than the drawn ones, which varies less between seeds.  A
predictive probability is linear in the tables of each level; the two levels are averaged apart, so the probabilities after a word
add up to one.
"""

from __future__ import annotations

import functools
import operator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import blocks, common
from . import text as T

U64 = np.uint64
END = U64(0x5851F42D4C957F2D)
#: The restaurant of a text's first word.
BEGIN = U64(0x14057B7EF767814F)
#: Restaurants are told apart by the bits of a hash above these.
LOW = U64(blocks.LOW)
#: Customers up to which table counts are drawn from the exact conditional; larger dishes are seated in companies.
EXACT = 64
SCHEMA = S.StructType([S.StructField("__id", S.LongType()), S.StructField("n_tokens", S.LongType()), S.StructField("n_known", S.LongType()), S.StructField("base_score", S.DoubleType()), S.StructField("score", S.DoubleType())])
#: One row for a range: its arrays and the sums named in ``SUMS``.
STATE = S.StructType([S.StructField("p", S.IntegerType()), S.StructField("__block", S.IntegerType()), S.StructField("payload", S.BinaryType()), S.StructField("dishes", S.BinaryType()), S.StructField("x", S.ArrayType(S.DoubleType()))])
SUMS = ("tokens", "types", "c1", "c2", "ends", "hapax", "customers", "tables", "w1", "w2")


_TAG = U64((1 << 40) - 1)
_BYTES, _INTS, _REALS = np.zeros(0, np.uint8), np.zeros(0, np.uint32), np.zeros(0, np.float32)
#: A range without words, dishes and restaurants: words, dishes of each, restaurants of the dishes, customers; means; restaurants, customers, tables.
_NONE = [np.zeros(0, U64), _INTS, _INTS, _BYTES, _BYTES, _INTS, _REALS, _REALS, _REALS, _INTS, _BYTES, _BYTES, _INTS, _REALS]
#: Passes over the documents in which they are scored, so that only a share of what blocks and ranges exchange is on disk at once.
PASSES = 2


@functools.lru_cache(4)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t) for c, t <= ``most`` (the weight of all seatings of c customers at t tables)."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        s[c + 1, 1 : c + 1] = np.logaddexp(s[c, :c], s[c, 1 : c + 1] + stay)
        s[c + 1, c + 1] = 0.0
    return s


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each key, the same wherever it is drawn."""
    return ((T.mix(key * T.ODD[700] + U64(salt * int(T.ODD[701]) & (1 << 64) - 1)) >> U64(12)).astype(float) + 0.5) / 2.0**52


def _binomial(n: np.ndarray, q: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Binomial draws from hashed uniforms: by inversion where few are expected, by the normal law elsewhere."""
    u, mean = uniform(key, salt), n * q
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform(key, salt + 1))
    out = np.clip(np.rint(mean + z * np.sqrt(mean * (1 - q))), 0, n).astype(np.int64)
    few = np.flatnonzero(mean < 8)
    if len(few):
        m, r = n[few].astype(float), np.minimum(q[few], 1 - 1e-12)
        mass = np.exp(m * np.log1p(-r))
        total, k = mass.copy(), np.zeros(len(few), np.int64)
        for j in range(40):
            more = (u[few] > total) & (k < m)
            if not more.any():
                break
            mass = mass * np.maximum(m - j, 0) / (j + 1) * (r / (1 - r))
            total += mass
            k[more] += 1
        out[few] = k
    return out


def _later(seated: float, c: np.ndarray, p: np.ndarray, offset: np.ndarray, discount: float) -> np.ndarray:
    """What one more table at ``seated`` customers does to the weight of seating all ``c``: each later customer finds ``discount`` less room."""
    offset = np.maximum(offset, 0)
    return ((seated + offset) / (np.maximum(c, seated) + offset)) ** (discount * (1 - p))


def draw_tables(c: np.ndarray, p: np.ndarray, rest: np.ndarray, strength: float, discount: float, key: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """New table counts of dishes of ``c`` customers with parent probability ``p``, and their expectation.

    ``rest``: the other tables of the restaurant.  Up to ``EXACT`` customers the draw is from the conditional S(c, t) p^t [strength + discount rest]_t.  Beyond,
    the first ``EXACT`` are seated so and the others come in companies of a quarter of those seated, each of which opens its tables at the
    rate in its middle: an approximation, off by a few per cent in the expectation (tested against the conditional).
    """
    out, mean = np.minimum(c, 1).astype(np.int64), np.minimum(c, 1).astype(float)
    table = stirling(round(discount, 3))
    size = np.minimum(c, EXACT)
    order = np.argsort(size, kind="stable")
    edge = np.searchsorted(size[order], np.arange(2, EXACT + 2))
    u = uniform(key, salt)
    for k, (a, b) in enumerate(zip(edge[:-1], edge[1:]), 2):
        j = np.arange(k)
        for i in range(a, b, 50_000):
            at = order[i : min(b, i + 50_000)]
            logs = table[k, 1 : k + 1] + (j + 1) * np.log(p[at])[:, None] + np.cumsum(np.log(strength + discount * (rest[at][:, None] + j)), 1)
            if k == EXACT:
                logs += (j + 1) * np.log(_later(k, c[at], p[at], (strength + discount * rest[at]) * p[at], discount))[:, None]
            mass = np.exp(logs - logs.max(1, keepdims=True))
            mass /= mass.sum(1, keepdims=True)
            out[at] = 1 + np.minimum((np.cumsum(mass, 1) < u[at][:, None]).sum(1), k - 1)
            mean[at] = mass @ (j + 1)
    at, seated, step = np.flatnonzero(c > EXACT), EXACT, 1
    while len(at):
        more = np.minimum(c[at] - seated, max(1, seated // 4))
        middle = seated + more / 2
        new = (strength + discount * (rest[at] + out[at])) * p[at]
        new *= _later(middle, c[at], p[at], new - discount * out[at], discount)
        q = np.clip(new / (new + middle - discount * out[at]), 0, 1)
        mean[at] += more * q
        out[at] += _binomial(more, q, key[at], salt + 2 * step)
        seated, step = seated + max(1, seated // 4), step + 1
        at = at[c[at] > seated]
    return out, mean


def discount_of(n1: float, n2: float) -> float:
    return round(float(np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1.5), 0.1, 0.95)), 3)


def _tokens(table: pa.Table, modulus: int, held_out: int):
    """Words of a block (sorted hashes, with the beginning), the pairs of word and word before, and where each token's word and pair are."""
    h, at = T.words(table.column("__text"), lower=True)
    n = np.diff(at)
    tok = np.empty(len(h) + len(n), U64)
    is_end = np.zeros(len(tok), bool)
    is_end[at[1:] + np.arange(len(n))] = True
    tok[~is_end] = h
    tok[is_end] = END
    learn = np.array([i is None or zlib.crc32(str(i).encode()) % modulus != held_out for i in table.column("__id").to_pylist()], bool)
    doc = np.repeat(np.arange(len(n)), n + 1)
    word = np.unique(np.append(tok, BEGIN))
    w = np.searchsorted(word, tok)
    before = np.empty(len(tok), np.int64)
    before[1:] = w[:-1]
    before[at[:-1] + np.arange(len(n))] = np.searchsorted(word, BEGIN)
    pair, where = np.unique(w * len(word) + before, return_inverse=True)
    count = np.bincount(where[learn[doc]], minlength=len(pair))
    return word, w, before, pair, where, count, doc, len(n)


def _merged(got: list) -> dict:
    """Words and pairs of one range over all blocks, with counts."""
    word, index = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    code, where = np.unique(_codes(index, got), return_inverse=True)
    w = (code >> U64(40)).astype(np.int64)
    c = np.bincount(where, np.concatenate([_counts(g[4], g[5]) for g in got]), len(w)).astype(np.int64)
    return {"word": word, "w": w, "tag": code & _TAG, "c": c, "cw": np.bincount(w, c, len(word)).astype(np.int64)}


def _codes(index: np.ndarray, got: list) -> np.ndarray:
    """Place of the word (in the order of the range's words) and restaurant of each pair that blocks ask for, in one number."""
    if len(index) and index.max() >= 1 << 24:
        raise OverflowError("a range has more than 16 million words: use more blocks")
    return (np.repeat(index.astype(U64), np.concatenate([g[1] for g in got])) << U64(40)) | np.concatenate([_whole(g[2], g[3]) for g in got])


def _small(count: np.ndarray) -> list[np.ndarray]:
    """Counts in a byte each; those of 255 and more in a list of their own."""
    return [np.minimum(count, 255).astype(np.uint8), count[count >= 255].astype(np.uint32)]


def _counts(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def _halves(tag: np.ndarray) -> list[np.ndarray]:
    """40 bits as 32 and 8."""
    return [(tag >> U64(8)).astype(np.uint32), (tag & U64(255)).astype(np.uint8)]


def _whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(U64) << U64(8)) | low


def _first(p: int, got: list) -> dict:
    """The state of a range before the first sweep: each dish has one table."""
    m = _merged(got)
    live, wide = np.flatnonzero(m["c"] > 1), np.flatnonzero(m["cw"] > 1)
    place = np.zeros(len(m["cw"]), np.int64)
    place[wide] = np.arange(len(wide))
    alone = m["c"] == 1
    singles = np.bincount(m["w"][alone], minlength=len(m["cw"]))
    arrays = [m["word"][wide], singles[wide].astype(np.uint32), np.ones(len(wide), np.uint32), np.zeros(len(wide)), place[m["w"][live]].astype(np.uint32), m["tag"][live], m["c"][live].astype(np.uint32), np.ones(len(live), np.uint32), np.zeros(len(live))]
    some, known = m["c"] > 0, m["cw"] > 0
    dishes = [m["word"][known], np.bincount(m["w"][some], minlength=len(known))[known].astype(np.uint32), *_halves(m["tag"][some]), *_small(m["c"][some])]
    ends = m["cw"][m["word"] == END].sum()
    x = [m["cw"].sum(), (m["cw"] > 0).sum(), alone.sum(), (m["c"] == 2).sum(), ends, (m["cw"] == 1).sum()]
    return _row(p, arrays, blocks.pack(dishes), x)


def _row(p: int, arrays: list, dishes: bytes | None, x: list) -> dict:
    """A state row; the root's sums are counted from the arrays, words of one customer included."""
    hapax = x[5]
    tw = arrays[1].astype(np.int64) + np.bincount(arrays[4], arrays[7], len(arrays[0])).astype(np.int64)
    x = [*map(float, x[:6]), float(tw.sum() + hapax), float(arrays[2].sum() + hapax), float((tw == 1).sum() + hapax), float((tw == 2).sum())]
    return {"p": p, "__block": p, "payload": blocks.pack(arrays), "dishes": dishes, "x": x}


def _sums(state: DataFrame) -> dict[str, float]:
    row = state.agg(*(F.sum(F.col("x")[i]).alias(k) for i, k in enumerate(SUMS))).first()
    return {k: row[k] or 0.0 for k in SUMS}


def _restaurants(table: pa.Table) -> pa.Table:
    """Customers and tables of dishes of one customer, of each restaurant of a range."""
    got = [g[2] for g in blocks.slices(table)]
    tag, where = np.unique(np.concatenate([_whole(g[0], g[1]) for g in got]), return_inverse=True)
    sums = [np.bincount(where, np.concatenate([_counts(g[i], g[i + 1]) for g in got]), len(tag)) for i in (2, 4)]
    return pa.table({"p": table.column("p").slice(0, 1), "payload": pa.array([blocks.pack([tag, *sums])], pa.binary())})


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``values`` at the wanted keys, zero where there is none."""
    if not len(keys):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0.0)


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted keys are, ``len(keys)`` for those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, i, len(keys))


def _by_restaurant(table: pa.Table, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Restaurants of a range's live dishes, sums over them of one of its arrays, and where each dish's restaurant is."""
    arrays = blocks.unpack(table.column("payload")[0].as_py())
    tag, where = np.unique(arrays[5], return_inverse=True)
    return tag, np.bincount(where, arrays[column], len(tag)), where


def _asks(column: int, kind=None):
    def emit(table):
        tag, sums, _ = _by_restaurant(table, column)
        sums = sums if kind is None else sums.astype(kind)
        return tag << LOW, lambda a, b: [tag[a:b], sums[a:b]]

    return emit


def _sweep(state: DataFrame, side: DataFrame, n: int, k: int, kept: bool, strengths: tuple[float, float], seed: int) -> DataFrame:
    g = _sums(state)
    d1, d0, u = discount_of(g["c1"], g["c2"]), discount_of(g["w1"], g["w2"]), 1.0 / (g["types"] + 1)
    salt = (seed * 1_000_003 + k) * 1024

    def merge(_, got, *owned):
        tag, where = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
        total = np.bincount(where, np.concatenate([x[1] for x in got]), len(tag))
        total += _at(owned[0][0], owned[0][2], tag) if owned[0] else 0.0
        return [[x.astype(np.float64)] for x in blocks.split(total[where], [len(x[0]) for x in got])]

    def then(table, answer):
        arrays = [a.copy() for a in blocks.unpack(table.column("payload")[0].as_py())]
        word, singles, s, s_sum, at, tag, c, t, t_sum = arrays
        _, _, where = _by_restaurant(table, 7)
        rest = answer[0][where] - t if len(t) else np.zeros(0)
        tw = singles.astype(np.int64) + np.bincount(at, t, len(word)).astype(np.int64)
        p1 = (tw - d0 * s + (strengths[0] + d0 * g["tables"]) * u) / (strengths[0] + g["customers"])
        t, mean = draw_tables(c.astype(np.int64), p1[at], np.maximum(rest, 0.0), strengths[1], d1, word[at] + tag * T.ODD[702], salt)
        tw = singles.astype(np.int64) + np.bincount(at, t, len(word)).astype(np.int64)
        s, s_mean = draw_tables(tw, np.full(len(tw), u), np.maximum(g["tables"] - s, 0.0), strengths[0], d0, word, salt + 512)
        if kept:
            s_sum, t_sum = s_sum + s_mean, t_sum + mean
        row = _row(table.column("p")[0].as_py(), [word, singles, s.astype(np.uint32), s_sum, at, tag, c, t.astype(np.uint32), t_sum], None, table.column("x")[0].as_py())
        return _state_table([row])

    asked = blocks.requests(state, n, _asks(7, np.uint32))
    return blocks.finish(state, blocks.replies(asked, n, merge, side), or_empty(then, STATE), STATE)


def _state_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=arrow_schema(STATE))


def arrow_schema(schema: S.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def or_empty(f, schema: S.StructType):
    """No rows for a block without documents."""
    return lambda table, answer: f(table, answer) if table.num_rows else arrow_schema(schema).empty_table()


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 5, held_out: int = 1, sweeps: int = 6, keep: int = 4, strengths: tuple[float, float] = (5.0, 1.0), seed: int = 7) -> DataFrame:
    """The model's log10 probability of every text, learnt from texts whose crc32(id as text) mod ``modulus`` is not ``held_out``.

    Tokens: lower-cased words (A-Z) and one end for each text; a null text is empty and is its end alone.  Columns: ``doc_id``, n_tokens, n_known, train_tokens,
    base_score (smoothed unigram), score.  One row for each row, repeats included, which count as often as they occur.  Ids are read as long; a row with a null id is
    learnt from.  A word never learnt has the probability of the one unknown, so scores compare with the base.
    ``keep`` of the ``sweeps`` are averaged.  All dishes of a word lie in one range: as many as words that come before it.
    """
    n = blocks.number(docs)
    dealt = blocks.dealt(docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")), "__id", n)

    def emit(table, counted=False):
        word, _, _, pair, _, count, _, _ = _tokens(table, modulus, held_out)
        at = np.searchsorted(pair, np.arange(len(word) + 1) * len(word))
        tag = (word >> LOW)[pair % len(word)]
        sizes = np.diff(at).astype(np.uint32)

        def cut(a, b):
            x = slice(at[a], at[b])
            return [word[a:b], sizes[a:b], *_halves(tag[x]), *(_small(count[x]) if counted else ())]

        return word, cut

    def first(table: pa.Table) -> pa.Table:
        return _state_table([_first(table.column("p")[0].as_py(), [g[2] for g in blocks.slices(table)])])

    state = begun = common.materialize(blocks.requests(dealt, n, functools.partial(emit, counted=True)).groupBy("p").applyInArrow(first, STATE), "seating")
    common.release(docs.sparkSession)

    def emit_singles(table):
        _, _, high, low, small, large = blocks.unpack(table.column("dishes")[0].as_py())
        count = _counts(small, large)
        tag, where = np.unique(_whole(high, low), return_inverse=True)
        c, t = (np.bincount(where, x, len(tag)).astype(np.int64) for x in (count, count == 1))
        return tag << LOW, lambda a, b: [*_halves(tag[a:b]), *_small(c[a:b]), *_small(t[a:b])]

    side = common.materialize(blocks.requests(state, n, emit_singles).groupBy("p").applyInArrow(_restaurants, "p int, payload binary"), "restaurants")
    for k in range(sweeps):
        after = common.materialize(_sweep(state, side, n, k, k >= sweeps - keep, strengths, seed), "seating")
        if state is not begun:
            common.discard(state)
        state = after
    g = _sums(state)
    d1, d0, u = discount_of(g["c1"], g["c2"]), discount_of(g["w1"], g["w2"]), 1.0 / (g["types"] + 1)
    tokens, types = int(g["tokens"]), int(g["types"])

    def means(table: pa.Table) -> pa.Table:
        """Averages of a range's dishes and words, and the root's mean customers and tables."""
        word, singles, _, s_sum, at, tag, c, _, t_sum = blocks.unpack(table.column("payload")[0].as_py())
        t = t_sum / keep
        tw = singles + np.bincount(at, t, len(word))
        s = np.minimum(s_sum / keep, tw)
        x = table.column("x")[0].as_py()
        return pa.table({"p": table.column("p"), "__block": table.column("p"), "payload": pa.array([blocks.pack([word, tw, s, np.zeros(0), at, tag, c, t])], pa.binary()), "dishes": pa.nulls(1, pa.binary()), "x": pa.array([[tw.sum() + x[5], s.sum() + x[5]]], pa.list_(pa.float64()))}).cast(arrow_schema(STATE))

    mean = common.materialize(state.groupBy("p").applyInArrow(lambda table: means(table), STATE), "seating")
    if state is not begun:
        common.discard(state)
    row = mean.agg(F.sum(F.col("x")[0]).alias("c"), F.sum(F.col("x")[1]).alias("t")).first()
    customers, tables = row.c or 0.0, row.t or 0.0
    root = lambda tw, s: (tw - d0 * s + (strengths[0] + d0 * tables) * u) / (strengths[0] + customers)

    def settle(table: pa.Table, other: pa.Table) -> pa.Table:
        """Customers and mean tables of each restaurant of a range."""
        tag, c, t = blocks.unpack(other.column("payload")[0].as_py()) if other.num_rows else (np.zeros(0, U64), np.zeros(0), np.zeros(0))
        t = t.copy()
        for _, _, (x, sums) in blocks.slices(table) if table.num_rows else []:
            t[np.searchsorted(tag, x)] += sums
        return pa.table({"p": pa.array([(table if table.num_rows else other).column("p")[0].as_py()], pa.int32()), "kind": pa.array([1], pa.int32()), "payload": pa.array([blocks.pack([*_halves(tag), *_small(c.astype(np.int64)), t.astype(np.float32)])], pa.binary())})

    asked = blocks.requests(mean, n, _asks(7))
    settled = asked.groupBy("p").cogroup(side.groupBy("p")).applyInArrow(settle, "p int, kind int, payload binary")
    model = common.materialize(settled.unionByName(mean.select("p", F.lit(0).alias("kind"), "payload")).unionByName(begun.select("p", F.lit(2).alias("kind"), F.col("dishes").alias("payload"))).groupBy("p").applyInArrow(lambda table: _joined(table), "p int, payload binary"), "model")
    for x in (mean, side, begun):
        common.discard(x)
    common.release(docs.sparkSession)

    def answer(_, got, owned):
        word, sizes, high, low, small, large, tw, s, t, *owned = owned or _NONE
        tag, c_u, t_u = _whole(owned[0], owned[1]), _counts(owned[2], owned[3]), owned[4]
        # What each of the range's words and dishes is worth, the last of either for those never learnt.
        c = _counts(small, large)
        of = np.repeat(np.arange(len(word)), sizes)
        cw = np.append(np.bincount(of, c, len(word)).astype(np.int64), 0)
        p1 = np.append(np.full(len(word), root(1.0, 1.0)), root(0.0, 0.0))
        p1[np.flatnonzero(cw > 1)] = root(tw, s)
        a = np.append(c - d1, 0.0)
        live = np.flatnonzero(c > 1)
        a[live] = c[live] - d1 * t
        code = (of.astype(U64) << U64(40)) | _whole(high, low)
        asked = np.concatenate([x[0] for x in got])
        at = _place(word, asked)
        pairs = _place(code, _codes(at, got))
        own = asked >> LOW
        more = [cw[at].astype(np.uint32), p1[at].astype(np.float32), _at(tag, t_u, own).astype(np.float32), (_at(tag, c_u, own) - cw[at]).astype(np.int32)]
        parts = [blocks.split(x, [len(x[0]) for x in got]) for x in more]
        return [[x, *y] for x, *y in zip(blocks.split(a[pairs].astype(np.float32), [len(x[2]) for x in got]), *parts)]

    def then(table, replies):
        word, w, before, pair, where, _, doc, rows = _tokens(table, modulus, held_out)
        # Each range answers its pairs and words in key order, so the ranges end to end are the block's order.
        a, cw, p1, t_u, more = replies
        i, j = pair // len(word), pair % len(word)
        p = (a + (strengths[1] + d1 * t_u[j].astype(float)) * p1[i]) / (strengths[1] + cw[j].astype(float) + more[j])
        c = cw[w]
        base = np.log10((c + 0.5) / (tokens + 0.5 * (types + 1)))
        total = lambda v: np.bincount(doc, v, rows)
        return pa.table([table.column("__id"), pa.array(total(np.ones(len(doc))).astype(np.int64)), pa.array(total(c > 0).astype(np.int64)), pa.array(total(base)), pa.array(total(np.log10(p)[where]))], names=SCHEMA.names)

    out = None
    for i in range(PASSES):
        some = dealt.where(F.col("__block") % PASSES == i)
        part = common.materialize(blocks.finish(some, blocks.replies(blocks.requests(some, n, emit), n, answer, model), or_empty(then, SCHEMA), SCHEMA), "scores")
        common.release(docs.sparkSession)
        out = part if out is None else out.union(part)
    common.discard(model)
    return out.select(F.col("__id").alias(doc_id), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _joined(table: pa.Table) -> pa.Table:
    """The arrays of a range's words and dishes, then those of its restaurants."""
    by = dict(zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()))
    dishes = blocks.unpack(by[2]) if 2 in by else _NONE[:6]
    mean = [x.astype(np.float32) for x in operator.itemgetter(1, 2, 7)(blocks.unpack(by[0]))] if 0 in by else _NONE[6:9]
    owned = blocks.unpack(by[1]) if 1 in by else _NONE[9:]
    return pa.table({"p": table.column("p").slice(0, 1), "payload": pa.array([blocks.pack([*dishes, *mean, *owned])], pa.binary())})


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """tokens and perplexity over all rows; null for no tokens."""
    tokens = F.sum("n_tokens")
    return scored.agg(tokens.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum(column) / tokens).alias("perplexity"))
