"""Quality classifier: a generalised additive model with pairwise interactions (lookup tables from boosted trees)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import text as T
from .common import one_of_each, remainder

NAMES = ("log_words", "mean_word", "sd_word", "upper", "digit", "sign", "pipe", "line", "end_mark", "non_ascii", "distinct_words", "same_as_before", "distinct_lines", "longest_run", "sign_words", "distinct_bigrams")
_CLASS = np.zeros((256, 7))
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"], 2] = 1
_CLASS[ord("|"), 3] = 1
_CLASS[10, 4] = 1
_CLASS[[ord(c) for c in ".!?"], 5] = 1
_CLASS[128:, 6] = 1


def features(texts) -> np.ndarray:
    """One row of ``NAMES`` per text; an empty or null one is all zeros."""
    data, off = T.buffer(texts)
    starts, ends, at = T.spans(data, off)
    h = T.hashes(data, starts, ends)
    size = ends - starts
    out = np.zeros((len(off) - 1, len(NAMES)))
    odd = (_CLASS[data[ends - 1], 2] > 0) if len(ends) else np.zeros(0, bool)
    line_hash, line_at = _lines(data, off)
    for i in range(len(off) - 1):
        a, b, n = at[i], at[i + 1], at[i + 1] - at[i]
        if not n:
            continue
        raw = data[off[i] : off[i + 1]]
        c = np.bincount(raw, minlength=256) @ _CLASS / len(raw)
        w = h[a:b]
        same = w[1:] == w[:-1]
        cuts = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        s = np.sort(w)
        two = np.sort(w[1:] * T.ODD[1] + w[:-1])
        lines = line_hash[line_at[i] : line_at[i + 1]]
        out[i] = (np.log1p(n), size[a:b].mean(), size[a:b].std(), c[0], c[1], c[2], c[3], c[4], c[5], c[6], (1 + (s[1:] != s[:-1]).sum()) / n, same.mean() if n > 1 else 0.0, len(np.unique(lines)) / max(1, len(lines)), np.diff(cuts).max() / n, odd[a:b].mean(), (1 + (two[1:] != two[:-1]).sum()) / n if n > 1 else 1.0)
    return out


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line's bytes and the line offsets of the documents."""
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    cut[:-1] |= data == 10
    edge = np.flatnonzero(cut)
    s, e = edge[:-1], edge[1:]
    s = s + (data[s] == 10) if len(s) else s
    keep = e > s
    s, e = s[keep], e[keep]
    return T.hashes(data, s, e), np.searchsorted(s, off)


@dataclass
class Model:
    """score = sigmoid(bias + sum of tables[f][bin f] + sum of pair tables[bin f, bin g])."""

    edges: list[np.ndarray]
    bias: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for j in range(len(self.edges)):
            z += self.tables[j][b[:, j]]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            z += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values of a tree of up to three leaves over ordered bins: the best cut, then the best cut of one side."""

    def cut(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        lg, lh = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        sg, sh = g[a:b].sum(), h[a:b].sum()
        gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    _, k = cut(0, len(g))
    left, right = cut(0, k), cut(k, len(g))
    second = max(left, right)
    cuts = sorted({0, k, len(g)} | ({second[1]} if second[0] > 1e-9 else set()))
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _square(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree of four leaves on a pair: one cut of each axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    sg, sh = cg[-1, -1], ch[-1, -1]
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    b, bh = cg[:-1, -1:] - a, ch[:-1, -1:] - ah
    c, ch_ = cg[-1:, :-1] - a, ch[-1:, :-1] - ah
    d, dh = sg - a - b - c, sh - ah - bh - ch_
    gain = a**2 / (ah + ridge) + b**2 / (bh + ridge) + c**2 / (ch_ + ridge) + d**2 / (dh + ridge) - sg**2 / (sh + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for rows, cols, x, y in ((slice(0, i + 1), slice(0, j + 1), a, ah), (slice(0, i + 1), slice(j + 1, None), b, bh), (slice(i + 1, None), slice(0, j + 1), c, ch_), (slice(i + 1, None), slice(j + 1, None), d, dh)):
        out[rows, cols] = x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, pairs: int = 6, rate: float = 0.15, ridge: float = 3.0) -> Model:
    """Cyclic boosting: each round visits every feature with one shallow tree; then the best pairs, on what is left."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model([np.zeros(0)] * len(NAMES), float(np.log(p / (1 - p))), np.zeros((len(NAMES), 1)), [], [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    m = Model(edges, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros((x.shape[1], bins + 1)), [], [])
    b = m.bins(x)
    z = np.full(len(y), m.bias)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(x.shape[1]):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, bins + 1), np.bincount(b[:, j], h, bins + 1), ridge)
            m.tables[j] += step
            z += step[b[:, j]]
    g, h = slopes()
    flat = lambda f, k, w: np.bincount(b[:, f] * (bins + 1) + b[:, k], w, (bins + 1) ** 2).reshape(bins + 1, bins + 1)
    found = sorted(((_square(flat(f, k, g), flat(f, k, h), ridge)[0], f, k) for f in range(x.shape[1]) for k in range(f + 1, x.shape[1])), reverse=True)
    m.pairs = [(f, k) for _, f, k in found[:pairs]]
    m.pair_tables = [np.zeros((bins + 1, bins + 1)) for _ in m.pairs]
    for _ in range(rounds // 2):
        for t, (f, k) in zip(m.pair_tables, m.pairs):
            g, h = slopes()
            step = rate * _square(flat(f, k, g), flat(f, k, h), ridge)[1]
            t += step
            z += step[b[:, f], b[:, k]]
    return m


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, modulus: int = 5, held_out: int = 0) -> Model:
    """Learn from at most ``sample`` labelled documents (the first by a hash of the id) whose crc32 remainder is not ``held_out``.

    Rows with a null id or label are not used; of several labels of one id the least counts, and of several texts the one of least hash, so that an id weighs once however often it is repeated.  Ids are read as long.  Features are computed on the executors; only they reach the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    picked = docs.sparkSession.createDataFrame([Row(doc_id=r.doc_id, y=int(r.quality)) for r in ids], "doc_id long, y int")
    rows = one_of_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id"), ["doc_id", "y"]).select("doc_id", "text", "y")

    def measure(batches):
        for b in batches:
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(measure, "doc_id long, y int, x array<double>").orderBy("doc_id", "y").collect()
    return train(np.array([r.x for r in got], float).reshape(len(got), len(NAMES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Add ``out`` double in (0, 1); null and empty texts get the score of all-zero features; all rows and other columns are kept."""
    kept = [c for c in docs.columns if c != out]
    df = docs.select(*kept)

    def run(batches):
        for b in batches:
            s = model.score(features(b.column(kept.index(text))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, df.select("*", F.lit(0.0).alias(out)).schema)
