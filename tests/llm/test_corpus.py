"""Corpus-wide operators against brute force, on texts with copies, near copies, runs, shared passages and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidespan.llm import blocks, common, decontamination, jaccard_join, pitman_yor, substring_dedup, text as T, vector_join


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(seed=0, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdeéß", k=rnd.randrange(1, 6))) for _ in range(400)]
    passage = rnd.choices(vocab, k=70)
    out = []
    for i in range(n):
        kind = i % 8
        w = rnd.choices(vocab, k=rnd.randrange(1, 150))
        if kind == 1 and out:
            w = out[rnd.randrange(len(out))][1].split()
        elif kind in (2, 3) and out:
            w = out[rnd.randrange(len(out))][1].split()
            for _ in range(1 + len(w) // 60):
                w[rnd.randrange(len(w))] = "edited"
        elif kind == 4:
            w = w[:20] + passage[rnd.randrange(10) : 60 + rnd.randrange(10)] + w[20:40]
        elif kind == 5:
            w = ["run"] * rnd.randrange(40, 130) + w[:10]
        out.append((i * 3, (" " if i % 2 else "\n").join(w)))
    return out + [(1000, None), (1001, ""), (1002, " \t "), (1003, "One"), (1004, "one"), (1005, "a" * 3000 + " b")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, component string, n int").repartition(5).cache()


def test_words_match_a_split():
    import pyarrow as pa

    texts = [t for _, t in corpus()] + ["\x0b\x0c x\x1fy z \r\n", "é" * 300000 + " q"]
    h, at = T.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        assert at[i + 1] - at[i] == len(w)
        for word, x in zip(w, h[at[i] : at[i + 1]]):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(docs, window):
    first, words = {}, {}
    for i, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        words[i] = (t or "").split()
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    got = {r.doc_id: r for r in substring_dedup.dedup(docs, window).collect()}
    texts = {r.doc_id: r for r in substring_dedup.dedup(docs, window, texts=True).collect()}
    assert set(got) == set(words) == set(texts)
    removed = 0
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert [j for a, b in zip(r.spans[::2], r.spans[1::2]) for j in range(a, b)] == [j for j, g in enumerate(gone) if g]
        if sum(gone):
            assert texts[i].text == kept and texts[i].component == "x"
        removed += sum(gone)
    assert removed


def test_relays_change_nothing(docs, monkeypatch):
    """The same results where rows between blocks and ranges pass through relays."""
    monkeypatch.setattr(blocks, "number", lambda df: 11)
    run = lambda: [sorted(map(repr, x.collect())) for x in (substring_dedup.dedup(docs), jaccard_join.components(docs), pitman_yor.score(docs))]
    direct = run()
    monkeypatch.setattr(blocks, "DIRECT", 4)
    assert blocks.band(11) == 4 and run() == direct


def test_substring_repeated_ids_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(5, t), (5, t), (None, t), (9, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup(d).collect()) == [(0, 0), (5, 0), (5, 0), (9, 60)]
    assert substring_dedup.dedup(d.where("false")).count() == 0


def test_recompression_is_consistent():
    rng = np.random.default_rng(1)
    a = T.mix(rng.integers(0, 30, 300).astype(np.uint64))
    b = np.concatenate([T.mix(rng.integers(0, 30, 41).astype(np.uint64)), a[100:180], T.mix(rng.integers(0, 30, 20).astype(np.uint64))])
    for r in (1, 3, 5):
        one, two = ({(int(s), int(lo) - off, int(hi) - off) for s, lo, hi in zip(*x[:3]) if off <= lo and hi <= off + 80} for x, off in ((substring_dedup.recompress(a, np.array([0, 300]), r), 100), (substring_dedup.recompress(b, np.array([0, len(b)]), r), 41)))
        assert one == two
    assert len(substring_dedup.recompress(a, np.array([0, 300]), 4)[0]) < 150


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(docs, k, percent):
    sets = {}
    for r in docs.collect():
        w = ascii_lower(r.text).encode().split()
        sets[r.doc_id] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    expected = components(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs, k, percent).collect()}
    assert got == {i: (len(s), expected[i]) for i, s in sets.items()}
    assert len(set(expected.values())) < len(expected)


@pytest.mark.parametrize("leaf, salts", [(1024, 1024), (8, 2)])
def test_jaccard_family_needs_rounds(spark, monkeypatch, leaf, salts):
    """Many near copies of one text, some of which only reach each other through others: in one task, and in rounds."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "SALTS", salts)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(100)] = f"e{rnd.random()}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i % 3][1]) for i in range(20)]
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(97)} for i, t in rows}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.components(d, 4, 85).collect()} == components(sets, 85)


def test_region_join_against_all_pairs():
    rng = np.random.default_rng(3)
    for m in (2, 5, 40, 130):
        base = rng.integers(0, 400, 60)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.03, 0.1, 0.5]), rng.integers(0, 400, 60), base)) for _ in range(m)]
        extra = rng.integers(0, 6, m)  # shingles that no other document holds
        size = np.array([len(x) for x in sets]) + extra
        root = jaccard_join._join_region(size, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), 80)
        want = np.arange(m)
        linked = [(i, j) for i in range(m) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (size[i] + size[j] - k)]
        for _ in range(m):
            for i, j in linked:
                want[want == max(want[i], want[j])] = min(want[i], want[j])
        assert (root == want).all()


def test_jaccard_odd_rows(spark):
    d = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in jaccard_join.components(d, 4, 85).collect()) == [("7", 7), ("7", 7), ("8", 8), ("None", None)]
    assert jaccard_join.components(d.where("false")).count() == 0


def test_pitman_yor(docs):
    tokens = {r.doc_id: [*ascii_lower(r.text).encode().split(), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in pitman_yor.score(docs).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score < 0
    total = lambda col: sum(got[i][col] for i in tokens if held[i])
    assert total("score") > total("base_score")


def test_pitman_yor_adds_up_to_one(spark):
    """Over all known words and one unknown, the probabilities after a given word make one."""
    train = [(i, "a b c a b a d b a c a") for i in range(40)]
    learnt = [i for i, _ in train if zlib.crc32(str(i).encode()) % 5 != 1]
    probe = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 1)
    probes = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 5 == 1][:6]
    rows = train + list(zip(probes, ["a a", "a b", "a c", "a d", "a zzz", "a"]))
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # P(a | begin) P(w | a) P(end | w): single out P(w | a) with texts "w" for P(end | w).
    more = [i for i in range(4000, 6000) if zlib.crc32(str(i).encode()) % 5 == 1][:5]
    ends = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(train + list(zip(more, ["a", "b", "c", "d", "zzz"])), "doc_id long, text string")).collect()}
    first = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(train + [(probe, "")], "doc_id long, text string")).collect()}
    assert learnt and all(x < 0 for x in [*got.values(), *ends.values(), *first.values()])
    assert sum(10 ** got[i] for i in probes) < 1


def conditional(c, p, rest, theta, d):
    t = np.arange(1, c + 1)
    log = pitman_yor.stirling(d, max(c, 2))[c, 1 : c + 1] + t * np.log(p) + np.cumsum(np.log(theta + d * (rest + t - 1)))
    mass = np.exp(log - log.max())
    return mass / mass.sum()


@pytest.mark.parametrize("c, p, rest, d", [(2, 0.001, 0.0, 0.5), (6, 0.2, 10.0, 0.5), (64, 0.02, 300.0, 0.8)])
def test_table_counts_follow_the_conditional(c, p, rest, d):
    want, n = conditional(c, p, rest, 1.0, d), 40_000
    keys = T.mix(np.arange(n).astype(np.uint64))
    got, mean = pitman_yor.draw_tables(np.full(n, c), np.full(n, p), np.full(n, rest), 1.0, d, keys, 5)
    assert np.abs(np.bincount(got, minlength=c + 1)[1:] / n - want).max() < 0.02
    assert mean == pytest.approx(want @ np.arange(1, c + 1))


@pytest.mark.parametrize("c, p, rest, d", [(100, 0.01, 50.0, 0.5), (600, 0.002, 2000.0, 0.7), (1500, 0.05, 10.0, 0.3), (1500, 0.3, 5000.0, 0.9), (1000, 0.01, 1e5, 0.8)])
def test_companies_are_near_the_conditional(c, p, rest, d):
    want, n = conditional(c, p, rest, 1.0, d) @ np.arange(1, c + 1), 4000
    keys = T.mix(np.arange(n).astype(np.uint64))
    got, mean = pitman_yor.draw_tables(np.full(n, c), np.full(n, p), np.full(n, rest), 1.0, d, keys, 5)
    assert got.mean() == pytest.approx(want, rel=0.06) and mean.mean() == pytest.approx(want, rel=0.06)
    assert got.min() >= 1 and got.max() <= c


def test_binomial_draws():
    keys = T.mix(np.arange(20_000).astype(np.uint64))
    for n, q in ((5, 0.1), (40, 0.02), (900, 0.3), (3, 1.0), (7, 0.0)):
        x = pitman_yor._binomial(np.full(len(keys), n), np.full(len(keys), q), keys, 3)
        assert x.mean() == pytest.approx(n * q, rel=0.03, abs=0.01) and x.std() == pytest.approx(math.sqrt(n * q * (1 - q)), rel=0.04, abs=0.01)


def seated_one_by_one(train, probes, strengths=(5.0, 1.0), rounds=300, drop=60, seed=1):
    """Mean log10 probabilities of the probes by a plain sampler that takes single customers up and seats them again."""
    rnd, end = random.Random(seed), None
    pairs = Counter((u, w) for t in train for u, w in zip([0, *t], [*t, end]))
    words = Counter(w for (_, w), c in pairs.items() for _ in range(c))
    d1 = pitman_yor.discount_of(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    base, theta0, theta1 = 1 / (len(words) + 1), *strengths
    d0, seats, root = 0.5, {k: [] for k in pairs}, {w: [] for w in words}  # sizes of the tables of each dish
    inside, whole, opened = Counter(), 0, 0

    def p1(w):
        return (sum(root.get(w, ())) - d0 * len(root.get(w, ())) + (theta0 + d0 * opened) * base) / (theta0 + whole)

    def sit(tables, strength, d, others, parent):
        weights = [n - d for n in tables] + [(strength + d * others) * parent]
        k = rnd.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return k == len(tables) - 1 and tables[k] == 1

    def rise(tables):
        k = rnd.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def enter(u, w):
        nonlocal whole, opened
        if sit(seats[u, w], theta1, d1, inside[u], p1(w)):
            inside[u] += 1
            opened += sit(root[w], theta0, d0, opened, base)
            whole += 1

    def leave(u, w):
        nonlocal whole, opened
        if rise(seats[u, w]):
            inside[u] -= 1
            whole -= 1
            opened -= rise(root[w])

    for (u, w), c in pairs.items():
        for _ in range(c):
            enter(u, w)
    customers = Counter(u for (u, _), c in pairs.items() for _ in range(c))
    total = [0.0] * len(probes)
    for r in range(rounds):
        d0 = pitman_yor.discount_of(sum(sum(t) == 1 for t in root.values()), sum(sum(t) == 2 for t in root.values()))
        for (u, w), c in pairs.items():
            for _ in range(c):
                leave(u, w)
                enter(u, w)
        if r >= drop:
            for i, t in enumerate(probes):
                total[i] += sum(math.log10((pairs[u, w] - d1 * len(seats.get((u, w), ())) + (theta1 + d1 * inside[u]) * p1(w)) / (theta1 + customers[u])) for u, w in zip([0, *t], [*t, end]))
    return [x / (rounds - drop) for x in total]


def test_pitman_yor_against_single_customers(spark):
    rnd = random.Random(3)
    chain = {f"w{i}": [f"w{rnd.randrange(12)}" for _ in range(3)] for i in range(12)}

    def walk(n):
        out = ["w0"]
        while len(out) < n:
            out.append(rnd.choice(chain[out[-1]]))
        return out

    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1][:40]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1][:12]
    train, probes = [walk(rnd.randrange(1, 12)) for _ in ids], [walk(rnd.randrange(1, 9)) for _ in held[:-1]] + [["w1", "never"]]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids + held, train + probes)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score(d, sweeps=14, keep=10).collect()}
    want = seated_one_by_one(train, probes)
    assert [got[i] for i in held] == pytest.approx(want, rel=0.03)


def test_pitman_yor_is_the_same_for_any_blocks(docs, monkeypatch):
    out = []
    for n in (1, 4, 32):
        monkeypatch.setattr(blocks, "number", lambda df, n=n: n)
        out.append(sorted((r.doc_id, round(r.score, 6), round(r.base_score, 6), r.n_known) for r in pitman_yor.score(docs, sweeps=3, keep=2).collect()))
    assert out[0] == out[1] == out[2]


def test_pitman_yor_ties_repeats_and_length(spark):
    """Repeated rows and ids count as often as they occur; a null id is learnt from; a very long text is one."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    d = spark.createDataFrame([(3, "a b"), (3, "a b"), (3, "c"), (None, "a b"), (4, long)], "doc_id long, text string")
    got = pitman_yor.score(d).collect()
    assert len(got) == 5 and {r.train_tokens for r in got} == {sum(n for i, n in ((3, 8), (4, 30_001)) if zlib.crc32(str(i).encode()) % 5 != 1) + 3}
    a, b = (r.score for r in got if r.doc_id == 3 and r.n_tokens == 3)
    assert a == b and all(math.isfinite(r.score) for r in got)


def test_pitman_yor_empty(spark):
    d = spark.createDataFrame([(1, None), (None, "x")], "doc_id long, text string")
    assert pitman_yor.score(d).count() == 2
    assert pitman_yor.score(d.where("false")).count() == 0


@pytest.mark.parametrize("dim", [3, 16])
def test_vector_join(spark, dim):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, dim))
    x = np.concatenate([x, x[:20], x[:20] * 3, x[5] + 0.05 * rng.standard_normal((30, dim)), x[6] + 0.2 * rng.standard_normal((20, dim))])
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim + 1)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, v, 0) for i, v in enumerate(bad)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T) >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(x))])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_join.links(d).collect()}
    assert got == {i: (int(near[i].sum()), int(comp[i]), i == comp[i]) for i in range(len(x))} | {1000 + i: (0, 1000 + i, True) for i in range(len(bad))}
    assert vector_join.links(d.where("false")).count() == 0


def test_vector_join_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(vector_join, "PART", 40)
    x = np.concatenate([rng.standard_normal((60, 8)), np.ones((1, 8)) + 0.1 * rng.standard_normal((90, 8))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vector_join.links(d).collect()}
    assert got == {i: int((u[i] @ u.T >= 0.95).sum()) - 1 for i in range(len(x))}


def test_decontamination(spark):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(300)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(20, 60)))) for i in range(20)] + [(90, "two words"), (91, None), (92, "")]
    docs, expected = [], set()
    for i in range(200):
        w = rnd.choices(vocab, k=rnd.randrange(5, 120))
        if i % 5 == 0:
            item, t = items[rnd.randrange(20)]
            part = t.split()
            if i % 10 == 0:
                part[-1] = "changed"
            if i % 15 == 0:
                part = part[: len(part) // 2]
            w[len(w) // 2 : len(w) // 2] = part
            grams = {tuple(part[j : j + 5]) for j in range(len(part) - 4)}
            full = {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
            if i % 15 and len(grams & full) >= 0.9 * len(grams | full):
                expected.add((i, item))
        docs.append((i, " ".join(w).upper() if i % 2 else " ".join(w), 1))
    docs += [(500, None, 1), (501, "", 1), (502, "it has Two  words in", 1), (None, items[0][1], 1), (503, items[3][1], 1), (503, items[3][1], 1)]
    expected |= {(502, 90), (503, 3)}
    d = spark.createDataFrame(docs, "doc_id long, text string, item int")
    got = {(r.doc_id, r.item_id): r for r in decontamination.matches(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert expected <= set(got)
    for (doc, item), r in got.items():
        w = next(t for i, t, _ in docs if i == doc).lower().split()[r.start : r.start + r.n_words]
        t = dict(items)[item].lower().split()
        k = min(5, len(t))
        a, b = (Counter(tuple(z[j : j + k]) for j in range(len(z) - k + 1)) for z in (w, t))
        assert r.similarity == pytest.approx(sum((a & b).values()) / sum((a | b).values()), abs=1e-6) and r.similarity >= 0.8
    assert decontamination.matches(d.where("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.matches(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


def alike(text, item, k=5):
    """Of every window as long as the item (or the whole of a shorter text) the greatest similarity."""
    w, t = text.split(), item.split()
    grams = lambda z: Counter(tuple(z[j : j + k]) for j in range(len(z) - k + 1))
    b, best = grams(t), 0.0
    for s in range(max(1, len(w) - len(t) + 1)):
        a = grams(w[s : s + len(t)])
        best = max(best, (a & b).total() / max(1, (a | b).total()))
    return best


def against_every_start(spark, items, docs):
    sets = [(i, j, x) for i, d in enumerate(docs) for j, t in enumerate(items) if (x := alike(d, t)) >= 0.8]
    got = decontamination.matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in got) == [(i, j, pytest.approx(x, abs=1e-6)) for i, j, x in sorted(sets)]
    assert all(alike(" ".join(docs[r.doc_id].split()[r.start : r.start + r.n_words]), items[r.item_id]) == pytest.approx(r.similarity, abs=1e-6) for r in got)
    return {(i, j) for i, j, _ in sets}


def test_decontamination_slides_over_every_start(spark):
    """Items whose parts stand in another order, inside longer documents, at either end and alone."""
    rnd = random.Random(9)
    word = lambda n: rnd.choices([f"w{i}" for i in range(900)], k=n)
    items, docs = [word(n) for n in (60, 60, 75, 90)], []
    for t in items:
        for cut in (len(t) // 2, len(t) // 3, 7):
            for before, after in ((40, 40), (0, 30), (30, 0), (3, 2)):
                docs.append(word(before) + t[cut:] + t[:cut] + word(after))
        docs += [word(20) + t[:-1] + word(30), word(20) + t[20:40] + t[:20] + t[40:] + word(9), word(20) + t[:30] + word(1) + t[30:] + word(20), word(200)]
    found = against_every_start(spark, [" ".join(t) for t in items], [" ".join(d) for d in docs])
    assert (0, 0) in found and len(found) > 40


def test_decontamination_of_shorter_documents(spark):
    """Documents that are an item without its first or last words, or too little of one."""
    rnd = random.Random(10)
    items = [rnd.choices([f"w{i}" for i in range(900)], k=n) for n in (60, 40)]
    docs = [d for t in items for d in (t[:-1], t[1:], t[2:-1], t[:-4], t[: len(t) // 2], t[:3])]
    found = against_every_start(spark, [" ".join(t) for t in items], [" ".join(d) for d in docs])
    assert found == {(i + 6 * j, j) for j in range(2) for i in range(4)}


def test_decontamination_keeps_the_least_similar(spark):
    """Windows between 0.8 and 0.9: none may be lost to the fingerprints."""
    rnd = random.Random(12)
    items = [rnd.choices([f"w{i}" for i in range(5000)], k=rnd.choice((24, 41, 60, 113))) for _ in range(24)]
    docs, n = [], 0
    for t in items:
        for part in (0.2 / 1.8, 0.12, 0.07):
            r = int((len(t) - 4) * part)
            new = [f"n{rnd.randrange(10**6)}" for _ in range(r)]
            docs += [rnd.choices(t, k=3) + t[: len(t) - r] + new + ["tail"], t[:5] + t[5 + r :] if r else t]
    found = against_every_start(spark, [" ".join(t) for t in items], [" ".join(d) for d in docs])
    assert sum(0.8 <= alike(" ".join(docs[i]), " ".join(items[j])) < 0.9 for i, j in found) > 40


def test_decontamination_joins_long_lists(spark, monkeypatch):
    """The same result where the shingles that a document must hold are joined rather than listed."""
    rnd = random.Random(13)
    word = lambda n: rnd.choices([f"w{i}" for i in range(400)], k=n)
    items = [word(n) for n in (30, 40, 3, 1)]
    docs = spark.createDataFrame([(i, " ".join(word(20) + items[i % 4] + word(9))) for i in range(20)], "doc_id long, text string")
    i = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    run = lambda: sorted(map(repr, decontamination.matches(docs, i).collect()))
    listed = run()
    monkeypatch.setattr(decontamination, "LISTED", 0)
    assert len(listed) >= 20 and run() == listed


def test_decontamination_of_a_very_long_item(spark):
    """An item of more words than a 16-bit counter holds, and repeated rows of it."""
    t = " ".join(f"w{(i * i) % 70_001}" for i in range(70_000))
    got = decontamination.matches(spark.createDataFrame([(1, t), (1, t), (2, "w1 w4 w9")], "doc_id long, text string"), spark.createDataFrame([(5, t)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.n_words, r.hamming, r.similarity) for r in got] == [(1, 5, 0, 70_000, 0, 1.0)]


def test_fingerprint(spark):
    d = spark.createDataFrame([(1, 3), (1, 1), (1, 9), (2, -1)], "k int, h long")
    assert {r.k: r.simhash for r in decontamination.fingerprint(d, ["k"], "h").collect()} == {1: 1, 2: -1}


def test_components_of_chains_and_stars(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(300, 200), (250, 300), (7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 250: 200, 300: 200}


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rnd = random.Random(8)
    vocab = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(500)]
    word = lambda n: " ".join(rnd.choices(vocab, k=n))
    passage, item = word(60), word(30)
    texts = {i: word(80) for i in range(60)}
    texts |= {60: texts[3], 61: texts[3] + " tail", 62: word(20) + " " + passage, 63: word(20) + " " + passage, 64: word(30) + " " + item + " " + word(5), 65: None, 66: ""}
    toxic = range(100, 160)
    texts |= {i: word(40) + " wretched " + word(10) for i in toxic}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(60)) | {62, 63, 65, 66}
    assert got[63].text == " ".join(texts[63].split()[:20]) and got[63].n_chars == len(got[63].text)
    assert all(got[i].text == texts[i] for i in range(60)) and got[62].text == texts[62]
    assert all(r.round_trip for r in got.values() if r.text is not None)


def test_pipeline_with_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, extra columns with clashing names; then tables without rows."""
    rnd = random.Random(21)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    word = lambda n: " ".join(rnd.choices(vocab, k=n))
    a, long = word(60), word(9000)
    rows = [(1, a), (1, a), (2, a), (3, None), (3, None), (4, ""), (5, word(70)), (5, word(70)), (None, a), (None, None), (6, long), (7, " \n "), (8, "one")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, id int, n int, start int"
    docs = spark.createDataFrame([(i, t, None, None, None, "c", 1, 2, None) for i, t in rows], schema)
    labels, items = "doc_id long, quality int, toxic int", "item_id long, text string"

    def run(name, d, l, i):
        for table, df in (("documents", d), ("labels", l), ("benchmark", i)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        return corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()

    got = run("odd", docs, spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 0)], labels), spark.createDataFrame([(None, a), (1, None), (2, "")], items))
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 3, 4, 5, 6, 7, 8]
    by = {r.doc_id: r for r in got}
    assert by[1].text == a and by[5].text == min(t for i, t in rows if i == 5) and by[6].text == long and by[3].text is None and by[4].text == ""
    assert all(r.component_id == "c" and (r.id, r.n, r.start) == (1, 2, None) for r in got)
    empty = run("empty", docs.where("false"), spark.createDataFrame([], labels), spark.createDataFrame([], items))
    assert empty == []


def test_vector_join_over_slabs(spark, monkeypatch):
    """Several slabs and parts of 20,000 vectors, against all products: links, components, repeated and null ids."""
    monkeypatch.setattr(vector_join, "SLAB", 3000)
    monkeypatch.setattr(vector_join, "PART", 2500)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 16)).astype(np.float32)
    x[10_000:12_000] = x[:2000] + 0.12 * rng.standard_normal((2000, 16)).astype(np.float32)
    x[15_000:18_000] = x[7] + 0.08 * rng.standard_normal((3000, 16)).astype(np.float32)
    import pyarrow as pa

    d = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 16).cast(pa.list_(pa.float32()))}))
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    count, root = np.zeros(len(x), int), np.arange(len(x))
    pairs = []
    for i in range(0, len(x), 1000):
        a, b = np.nonzero(u[i : i + 1000] @ u.T >= 0.95)
        count += np.bincount(a + i, minlength=len(x))
        pairs.append(np.stack([a + i, b], 1))
    pairs = np.concatenate(pairs)
    while True:
        low = np.minimum.reduceat(root[pairs[:, 1]], np.searchsorted(pairs[:, 0], np.arange(len(x))))
        if (low == root).all():
            break
        root = low
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.links(d).collect()}
    assert got == {i: (int(count[i]) - 1, int(root[i])) for i in range(len(x))}
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in vector_join.links(odd).collect()) == [(0, 0, None), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
