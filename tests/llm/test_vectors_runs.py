"""Centroid clustering, periodic runs and top-k over sorted lists against brute force, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidespan.llm import periodic_runs, ptolemaic_kmeans, topk_lists
from tidespan.llm import text as T
from tidespan.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, score int, d int, v int, row int, distance string"
INF, NAN = float("inf"), float("nan")


def vectors(n=200, dim=64, seed=3):
    """Loose groups, equal vectors, repeated ids, and rows that take no part."""
    rnd = np.random.default_rng(seed)
    centers = rnd.standard_normal((6, dim))
    rows = [(i, (centers[i % 6] * 0.3 + rnd.standard_normal(dim) * 0.1 * (1 + i % 3)).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # copies: ties
    rows += [(50, rows[9][1]), (50, rows[9][1]), (None, rows[11][1]), (100_000, None), (100_050, []), (100_100, [1.0] * (dim - 1)), (100_150, [2.0] * (dim - 1)), (100_200, [NAN] + [0.0] * (dim - 1)), (100_250, [INF] + [0.0] * (dim - 1)), (100_300, [None] + [0.0] * (dim - 1)), (100_350, [0.0] * dim), (100_400, [-0.0] * dim)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "a", 2, 3, 4, 5, "x") for i, v in rows], VECTORS).repartition(parts)


def plain_clusters(rows, k=8, rounds=10, scale=1024, dim=64):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    each = {j: sum(d for _, d, o in found if o == j) for j in range(len(at))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, j, d, each[j], sum(each.values()), sha[j]) for i, d, j in found]


def same(df, want):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_clusters(spark):
    rows = vectors()
    same(ptolemaic_kmeans.clusters(frame(spark, rows)), plain_clusters(rows))
    few = rows[:5] + rows[-12:]
    same(ptolemaic_kmeans.clusters(frame(spark, few), rounds=3), plain_clusters(few, rounds=3))
    one = [(i, rows[0][1]) for i in range(12)]  # all alike: one centroid wins every tie, seven stay empty
    same(ptolemaic_kmeans.clusters(frame(spark, one)), plain_clusters(one))


def test_clusters_of_large_and_small_components(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.standard_normal(64) * 10.0 ** (i % 5)).tolist()) for i in range(60)]
    same(ptolemaic_kmeans.clusters(frame(spark, rows), k=3, rounds=4), plain_clusters(rows, k=3, rounds=4))
    with pytest.raises(Exception, match="fit a long"):
        ptolemaic_kmeans.clusters(frame(spark, [(1, [1e300] * 64), (2, [0.0] * 64)])).collect()


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None), (2, [1.0])], [(None, [1.0] * 64)]):
        out = ptolemaic_kmeans.clusters(spark.createDataFrame([(i, v, 1, "a", 2, 3, 4, 5, "x") for i, v in rows], VECTORS))
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


def test_bounds_hold_and_rule_out():
    rnd = np.random.default_rng(1)
    centers = rnd.standard_normal((8, 64)) * 300
    x = np.floor(centers[np.arange(4000) % 8] + rnd.standard_normal((4000, 64)) * 100)
    pivots = ptolemaic_kmeans.learn_pivots(x[:500], x[:8])
    c = np.floor(centers + rnd.standard_normal((8, 64)) * 5)
    dq, true = pivots.distances(x), np.sqrt(((x[:, None] - c) ** 2).sum(2))
    assert (pivots.bounds(dq, pivots.distances(c)) <= true).all()
    cluster, best, measured = ptolemaic_kmeans.assign(x, dq, c, pivots)
    assert (cluster == true.argmin(1)).all() and (best == np.rint(true.min(1) ** 2)).all()
    assert measured < 1.2 * len(x)  # of 8 for each vector


def plain_top(rows, k=5, every=50, scale=256):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i % every == 0:
            score = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(kept) if other != at and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(score[:k])]
    return out


@pytest.mark.parametrize("block,batch", [(None, 8192), (37, 3), (1000, 2)])
def test_top_k(spark, block, batch):
    rows = vectors()
    same(topk_lists.search(frame(spark, rows), block=block, batch=batch), plain_top(rows))


def test_top_k_of_few_and_none(spark):
    for rows in ([], [(0, [1.0, -2.0])], [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (50, [0.0, 0.0])], [(None, [1.0]), (3, [1.0])], [(0, [1e5, 3.3]), (1, [-1e6, 7.0]), (50, [1e6, 1e6])]):
        out = topk_lists.search(spark.createDataFrame([(i, v, 1, "a", 2, 3, 4, 5, "x") for i, v in rows], VECTORS))
        assert out.columns == ["query_id", "rank", "vec_id", "score"]
        same(out, plain_top(rows))


@pytest.mark.parametrize("decay", [1.0, 0.8])
def test_lists_stop_early_and_lose_nothing(decay):
    rnd = np.random.default_rng(2)
    x = np.floor(256 * rnd.standard_normal((6000, 32)) * decay ** np.arange(32))
    lists, shares = topk_lists.Lists(x), []
    for q in x[:40]:
        score = x @ q
        alive, read = lists.top(q, 5, int(np.sort(score)[-8]))
        assert set(np.flatnonzero(score >= np.sort(score)[-5])) <= set(alive)
        assert set(np.flatnonzero(score >= np.sort(score)[-5])) <= set(lists.top(q, 5, None)[0])
        shares.append(read / x.size)
    assert np.mean(shares) < (0.7 if decay == 1 else 0.3)


def plain_runs(w, least=6, power=4):
    seen = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                seen.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in seen.items()), [x for k, x in enumerate(w) if not any(i + q <= k < i + n for (i, n), q in seen.items())]


def repetitive(rnd):
    w = [str(rnd.randrange(rnd.choice([1, 2, 3, 40]))) for _ in range(rnd.randrange(120))]
    for _ in range(rnd.randrange(3)):
        x = [str(rnd.randrange(4)) for _ in range(rnd.randrange(1, 30))]
        if rnd.random() < 0.5:
            x = (x[:2] * 20)[: len(x)] + x[-2:]  # a period within a period
        at = rnd.randrange(len(w) + 1)
        w[at:at] = (x * 9)[: rnd.randrange(2 * len(x), 7 * len(x) + 2)]
    return w


def texts():
    rnd = random.Random(4)
    fibonacci, other = ["a"], ["a", "b"]
    while len(other) < 700:
        fibonacci, other = other, other + fibonacci
    thue = [str(bin(i).count("1") % 2) for i in range(600)]
    long = [str(rnd.randrange(9)) for _ in range(700)]
    return [repetitive(rnd) for _ in range(150)] + [other, thue, ["x"] * 500, long * 4, long * 3 + long[:-1], (["é"] * 90 + ["ß"]) * 5, ["one"], ["one"] * 5, ["one"] * 6]


@pytest.mark.parametrize("size", [1 << 21, 700])
def test_runs(spark, monkeypatch, size):
    monkeypatch.setattr(periodic_runs, "SLICE", size)
    lists = texts()
    rows = [(i, (" " if i % 2 else "\n\t").join(w), "r", 1) for i, w in enumerate(lists)] + [(None, "b b b b b b b", "r", 1), (900, None, "r", 1), (901, "", "r", 1), (902, " \t\n", "r", 1), (5, "c d c d c d c d", "r", 1), (5, "c d c d c d c d", "r", 1)]
    out = periodic_runs.detect(spark.createDataFrame(rows, "doc_id long, text string, runs string, c0 int").repartition(3))
    assert out.columns == ["doc_id", "c0", "n_words", "runs", "collapsed"]
    got = sorted((repr(r.doc_id), r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out.collect())
    want = []
    for i, t, *_ in rows:
        w = (t or "").split()
        runs, kept = plain_runs(w)
        want.append((repr(i), len(w), tuple(runs), " ".join(kept)))
    assert got == sorted(want)


def test_windows_with_one_hash_are_compared_word_by_word(monkeypatch):
    rnd = random.Random(8)
    lists = [repetitive(rnd) for _ in range(40)]
    real = periodic_runs._double
    monkeypatch.setattr(periodic_runs, "_double", lambda name, span: real(name, span) % np.uint64(5))
    h = T.mix(np.array([int(x) + 1 for w in lists for x in w], np.uint64))
    at = np.concatenate([[0], np.cumsum([len(w) for w in lists])])
    got = set(zip(*(x.tolist() for x in periodic_runs.find(h, at))))
    assert got <= {(d, *r) for d, w in enumerate(lists) for r in plain_runs(w)[0]}


def test_registered_runs(spark, tmp_path):
    rows = [(i, " ".join(w)) for i, w in enumerate(texts())] + [(None, "a a a a a a"), (1000, None), (1001, "  "), (7, "e f e f e f e f")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    want = []
    for i, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
        runs, kept = plain_runs(w)
        best = None
        for r in sorted(runs, key=lambda r: (r[0], r[2])):
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        text = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    out = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert any(r[1] and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in want)
    same(out, want)
    assert QUERIES["op12_periodic_runs"](spark, f"{tmp_path}/none").count() == 0
