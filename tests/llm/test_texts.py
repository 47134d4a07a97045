"""Codec, token counts, classifiers: parity, round trips, held-out accuracy and odd rows."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidespan.llm import language_id, quality_gam, sentencepiece_codec as sp, token_counts, toxicity
from tidespan.llm.queries import PATTERN, TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
SF = "/root/testdata/sf0.001"
needs_files = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = [(1, None, None), (2, "", "x"), (3, "   \n", "x"), (4, "word", "x"), (4, "word", "x"), (5, "long " * 20000, "x"), (None, "no id", "x"), (6, "1234 !!", "x")]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def message(*parts):
    out = b""
    for number, kind, value in parts:
        out += bytes([number << 3 | kind])
        if kind == 2:
            n = len(value)
            out += bytes([n & 127 | 128, n >> 7] if n > 127 else [n]) + value
        else:
            out += value if kind == 5 else bytes([value])
    return out


def tiny_unigram():
    """A hand-made unigram model with byte fallback."""
    pieces = [("<unk>", 0, 2), ("▁", -3, 1), ("▁ab", -1, 1), ("a", -4, 1), ("b", -4, 1), ("ab", -2, 1), ("ba", -2.5, 1)] + [(f"<0x{i:02X}>", -9, 6) for i in range(256)]
    body = [(1, 2, message((1, 2, p.encode()), (2, 5, np.float32(s).tobytes()), (3, 0, k))) for p, s, k in pieces]
    trainer = bytes([3 << 3, 1]) + bytes([0x98, 0x02, 1])  # unigram; field 35: byte fallback
    return message(*body, (2, 2, trainer), (3, 2, message((1, 2, b"identity"), (3, 0, 1), (4, 0, 0), (5, 0, 1))))


def test_unigram_parity(tmp_path):
    spm = pytest.importorskip("sentencepiece")
    f = tmp_path / "u.model"
    f.write_bytes(tiny_unigram())
    other = spm.SentencePieceProcessor(model_file=str(f))
    c = sp.Codec(f.read_bytes())
    for t in ("", "ab", "abab ba", "xé ab", "  a  b ", "baab abba"):
        assert c.encode([t])[0] == other.encode(t) == c.encode_arrays([t])[0].tolist()
        assert c.decode(c.encode([t])[0]) == t


@needs_files
@needs_data
def test_model_parity_and_round_trip(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + list(sp.PROBES)
    assert sp.parity(MODEL, texts) == []
    c = sp.codec(MODEL)
    for t, ids in zip(texts, c.encode(texts)):
        assert c.decode(ids) == c.normalise(t)
        assert c.decode(ids) == c.tokenizer.decode(ids, skip_special_tokens=False)


@needs_files
def test_codec_rows(odd):
    out = sp.encode(odd.withColumn("token_ids", F.lit("clash")), MODEL, check="ok")
    got = out.collect()
    assert len(got) == len(ODD) and out.columns == ["doc_id", "text", "score", "token_ids", "ok"]
    assert [(r.token_ids, r.ok) for r in got if r.text is None] == [(None, None)] and all(r.ok for r in got if r.text is not None)
    assert [r.token_ids for r in got if r.text == ""] == [[]]
    back = {(r.doc_id, r.text): r.decoded for r in sp.decode(out, MODEL).collect()}
    assert all(a[1] == b for a, b in back.items())
    assert sp.encode(odd.where("false"), MODEL).count() == 0


@needs_files
def test_token_histogram(spark, odd):
    enc = token_counts.ranks_encoding(RANKS, PATTERN)
    lengths = sorted(len(enc.encode_ordinary(t)) for _, t, _ in ODD if t is not None)
    s = token_counts.totals(token_counts.length_histogram(odd, RANKS, PATTERN)).cache()
    for r in s.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_longer, r.tokens_longer, r.docs_to, r.tokens_to, r.tokens_if_cut) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n), sum(x <= n for x in lengths), sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths))
    for limit in (0, 1, 2, 7, 10**6):
        assert tuple(token_counts.at_limit(s, limit).first()) == (sum(x > limit for x in lengths), sum(x for x in lengths if x > limit), sum(min(x, limit) for x in lengths))
    assert token_counts.quantile(s, 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]
    empty = token_counts.totals(token_counts.length_histogram(odd.where("false"), RANKS, PATTERN))
    assert empty.count() == 0 and tuple(token_counts.at_limit(empty, 5).first()) == (0, 0, 0)


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({f" {toxicity.fold('trash').strip()}": 2.0, f" {toxicity.fold('moron').strip()} ": 1.0})
    assert lex.features("clean words")[0] == 0
    assert lex.features("TRASH")[0] == lex.features("tr4$h")[0] == lex.features("trаsh")[0] == 2.0  # the last with a Cyrillic a
    assert lex.features("what a m0ron!")[0] == 1.0 and lex.features("moronic")[0] == 0
    assert lex.features("put it in the trash can")[0] == 0
    assert lex.features("trash can trash")[0] == 2.0
    assert lex.score("trash " * 3) > lex.score("trash " + "fine " * 300) > lex.score("fine")


def labelled(spark, n=600):
    rnd = random.Random(1)
    good = ["ba", "lo", "mi", "ren", "tas", "vel", "son", "kir"]
    docs, labels = [], []
    for i in range(n):
        toxic, bad = i % 5 == 0, i % 7 == 0
        w = ["".join(rnd.choices(good, k=2)) for _ in range(40)]
        if toxic:
            w[rnd.randrange(40)] = "wretch" + rnd.choice(good)
        docs.append((i, " ".join(["zap"] * 40 if bad and not toxic else w), "x"))
        labels.append((i, int(not (bad and not toxic)), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, odd):
    docs, labels = labelled(spark)
    lexicon = toxicity.fit(docs, labels)
    out = toxicity.score(docs, lexicon).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    assert out and all((r.toxicity >= 0.3) == bool(r.toxic) for r in out)
    got = toxicity.score(odd, lexicon).collect()
    assert len(got) == len(ODD) and all(0 <= r.toxicity < 0.3 for r in got)
    none = toxicity.fit(docs, labels.where("false"))
    assert none.weights == {} and toxicity.score(odd, none).count() == len(ODD)
    assert toxicity.fit(docs, spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).weights == {}


def test_lexicon_whatever_the_partitions(spark):
    """A word of as many clean as toxic documents is not learnt, though each task holds one document of it."""
    learnt = [i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2][:24]
    rows = [(i, ("wretched" if k % 2 else "plain") + (" neutral" if k < 12 else ""), k % 2) for k, i in enumerate(learnt)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = lambda n: spark.createDataFrame(spark.sparkContext.parallelize([r[:2] for r in rows], n), "doc_id long, text string")
    one, many = (toxicity.fit(docs(n), labels, min_docs=6) for n in (1, 24))
    assert one == many and list(one.weights) == [toxicity.fold("wret").rstrip()]


def test_quality_held_out(spark, odd):
    docs, labels = labelled(spark)
    model = quality_gam.fit(docs, labels)
    out = quality_gam.score(docs, model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert out and all((r.quality_score >= 0.3) == bool(r.quality) for r in out)
    assert quality_gam.score(odd, model).count() == len(ODD)
    assert quality_gam.score(odd, quality_gam.fit(docs, labels.where("false"))).count() == len(ODD)


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_gam.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.train(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == (y > 0)).mean() > 0.95


@needs_data
def test_language_held_out(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    out = language_id.predict(docs, model).where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert got[1, None] == got[2, ""] == got[3, "   \n"] == got[6, "1234 !!"] == ("und", 0.0)
    assert got[4, "word"][0] in model.langs and 0 <= got[4, "word"][1] <= 1
    none = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}


def test_kernel_is_the_set_kernel():
    m = language_id.train(["abc abd", "xyz xyw"], ["a", "x"])
    a, b = language_id.presence("abc abd"), language_id.presence("abq")
    expected = (a & b).sum() / (a.sum() * b.sum()) ** 0.5
    assert m.kernel([b])[0, 0] == pytest.approx(expected, rel=1e-5)


def test_features_of_empty_texts():
    assert not quality_gam.features(pa.array(["", None, " \n"])).any()


def test_automaton_against_a_naive_scan():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdei", k=rnd.randrange(3, 9))) for _ in range(60)]
    weights = {toxicity.fold(w) if i % 3 == 0 else f" {toxicity.fold(w).strip()[:4]}": 0.1 + rnd.random() for i, w in enumerate(words[:25])}
    lexicon = toxicity.Lexicon(weights, exceptions=tuple(f"{a} {b}" for a, b in zip(words[:12], words[30:])))
    some = 0
    for _ in range(300):
        text = rnd.choice((" ", ", ", "\n")).join(rnd.choices(words, k=rnd.randrange(0, 40)))
        t = toxicity.fold(text)
        total = 0.0
        spans = [(i, i + len(p)) for e in lexicon.exceptions for p in [toxicity.fold(e)] for i in range(len(t)) if t.startswith(p, i)]
        for i in range(len(t)):
            found = [w for p, w in weights.items() if t.startswith(p, i)]
            if found and not any(a <= i < b - 1 for a, b in spans):
                total += max(found)
        got = lexicon.features(text)
        assert got == (pytest.approx(total), pytest.approx(100 * total / len(t)))
        some += total > 0
    assert some > 100


def test_learnt_exceptions(spark):
    """A word that is toxic but for one phrase: the phrase is learnt as an exception."""
    rnd = random.Random(5)
    plain = [f"plain{i}" for i in range(50)]
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows, labels = [], []
    for n, i in enumerate(ids[:1600]):
        w = rnd.choices(plain, k=20)
        if n % 2:
            w[5:6] = ["wretched", rnd.choice(plain)]
        elif n % 80 == 0:
            w[5:6] = ["wretched", "excess"]
        rows.append((i, " ".join(w)))
        labels.append((i, n % 2))
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), min_docs=8)
    assert lexicon.score("a wretched plain1") > 0.5 > lexicon.score("a wretched excess") and toxicity.fold("wretched excess").strip() in lexicon.exceptions


def test_ridge_is_the_exact_kernel_ridge():
    """With every document a landmark, scores are those of kernel ridge regression with all pairwise kernels of n-gram sets."""
    rnd = random.Random(4)
    alphabets = {"x": "abcde ", "y": "cdefg ", "z": "efghi "}
    texts, langs = zip(*(("".join(rnd.choices(alphabets[k], k=rnd.randrange(20, 60))) + "a", k) for k in list("xyz") * 12))
    model = language_id.train(list(texts), list(langs), landmarks=99, ridge=0.05)
    held = ["".join(rnd.choices(a, k=30)) + "a" for a in alphabets.values()]
    sets = [set(language_id.slots(t).tolist()) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.where(np.array(langs)[:, None] == np.array(model.langs)[None, :], 1.0, -1.0)
    n, w = len(texts), np.full(len(texts), 1.0)
    penalty = 0.05 * n / 3
    one = np.ones((n, 1))
    system = np.block([[k @ (w[:, None] * k) + penalty * k, k @ (w[:, None] * one)], [(w[:, None] * one).T @ k, np.array([[w.sum()]])]])
    solved = np.linalg.lstsq(system, np.vstack([k @ (w[:, None] * y), (w[:, None] * y).sum(0, keepdims=True)]), rcond=None)[0]
    new = np.array([[kernel(set(language_id.slots(t).tolist()), b) for b in sets] for t in held])
    want = new @ solved[:-1] + solved[-1]
    got = model.kernel([language_id.presence(t) for t in held]) @ model.mapping @ model.weights + model.offset
    assert got == pytest.approx(want, abs=5e-3)


def test_more_languages_than_landmarks(spark):
    """Each of 120 languages can be predicted, and more than the stated bound are an error."""
    names = [f"l{i:03d}" for i in range(120)]
    word = lambda i: "".join("abcdefghijk"[int(c)] for c in f"{i * 7919 % 99991:05d}")
    rows = [(j * 1000 + i, f"{word(i)} {word(i + 500)} {word(i)}", n) for i, n in enumerate(names) for j in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d)
    got, _ = model.predict([f"{word(i)} {word(i + 500)}" for i in range(120)])
    assert set(model.langs) == set(names) and sum(a == b for a, b in zip(got, names)) > 110
    with pytest.raises(ValueError):
        language_id.fit(d, max_langs=100)


def test_trees_against_all_cuts():
    rnd = np.random.default_rng(1)
    for _ in range(40):
        g, h = rnd.standard_normal(9), rnd.random(9) + 0.1
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 3.0)
        first = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9))
        more = [(gain(0, k) + gain(k, first) - gain(0, first), k) for k in range(1, first)] + [(gain(first, k) + gain(k, 9) - gain(first, 9), k) for k in range(first + 1, 9)]
        best = max(more)
        cuts = sorted({0, first, 9} | ({best[1]} if best[0] > 1e-9 else set()))
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 3.0)) for a, b in zip(cuts, cuts[1:])])
        assert quality_gam._tree(g, h, 3.0) == pytest.approx(want)
        g2, h2 = rnd.standard_normal((4, 5)), rnd.random((4, 5)) + 0.1
        parts = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
        worth = lambda i, j: sum(g2[s].sum() ** 2 / (h2[s].sum() + 3.0) for s in parts(i, j))
        i, j = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda x: worth(*x))
        value, table = quality_gam._square(g2, h2, 3.0)
        assert value == pytest.approx(worth(i, j) - g2.sum() ** 2 / (h2.sum() + 3.0))
        for s in parts(i, j):
            assert table[s] == pytest.approx(np.full_like(table[s], g2[s].sum() / (h2[s].sum() + 3.0)))


def test_scores_are_sums_of_bins():
    rnd = np.random.default_rng(6)
    x = np.round(rnd.random((500, len(quality_gam.NAMES))), 2)
    m = quality_gam.train(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=8)
    for row, s in zip(x[:60], m.score(x[:60])):
        at = [sum(e <= v for e in edge) for v, edge in zip(row, m.edges)]
        z = m.bias + sum(t[b] for t, b in zip(m.tables, at)) + sum(t[at[f], at[g]] for (f, g), t in zip(m.pairs, m.pair_tables))
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_control_pieces_are_not_read_from_texts(tmp_path):
    spm = pytest.importorskip("sentencepiece")
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("▁", -3, 1), ("<", -5, 1), ("s", -4, 1), (">", -5, 1)]
    body = [(1, 2, message((1, 2, p.encode()), (2, 5, np.float32(s).tobytes()), (3, 0, k))) for p, s, k in pieces]
    raw = message(*body, (2, 2, bytes([3 << 3, 1])), (3, 2, message((1, 2, b"identity"), (3, 0, 1), (4, 0, 0), (5, 0, 1))))
    (tmp_path / "c.model").write_bytes(raw)
    other = spm.SentencePieceProcessor(model_file=str(tmp_path / "c.model"))
    c = sp.Codec(raw)
    for t in ("<s>", "s <s> s", "<<s>>"):
        assert c.encode([t])[0] == other.encode(t)
        assert 1 not in c.encode([t])[0]
    with pytest.raises(ValueError):
        sp.Codec(message((1, 2, message((1, 2, b"<unk>"), (3, 0, 2))), (1, 2, message((1, 2, b"own"), (3, 0, 4))), (2, 2, bytes([3 << 3, 1]))))


def test_an_id_that_is_repeated_weighs_once(spark, monkeypatch):
    """20,000 rows of one id: one of them is learnt from, and no more than the bound reach the driver."""
    import random

    from tidespan.llm import language_id, quality_gam, toxicity

    rnd = random.Random(4)
    plain = [(i, f"{'vile' if i % 4 == 0 else 'mild'} {' '.join(rnd.choices(['one', 'two', 'three', 'four'], k=20))} {i}", "en" if i % 2 else "fr") for i in range(120)]
    base = spark.createDataFrame(plain, "doc_id long, text string, lang string")
    many = base.union(spark.range(20_000).selectExpr("7L as doc_id", "concat('mild other text ', id) as text", "'en' as lang")).repartition(4)
    labels = spark.createDataFrame([(i, i % 3 % 2, int(i % 4 == 0)) for i, *_ in plain], "doc_id long, quality int, toxic int")
    seen = {}
    for module, name in ((quality_gam, "train"), (language_id, "train_slots")):
        real = getattr(module, name)

        def spy(x, y, *rest, real=real, name=name, **more):
            seen[name] = len(y)
            return real(x, y, *rest, **more)

        monkeypatch.setattr(module, name, spy)
    a = [quality_gam.fit(d, labels) and seen["train"] for d in (base, many)]
    b = [language_id.fit(d) and seen["train_slots"] for d in (base, many)]
    assert a[0] == a[1] < 120 and b[0] == b[1] <= 120
    one, other = (toxicity.fit(d, labels, min_docs=3) for d in (base, many))
    assert one.weights.keys() == other.weights.keys() and any("viie" in w for w in one.weights)
    assert one.weights == pytest.approx(other.weights)
