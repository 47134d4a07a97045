"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import discard, materialize, one_of_each, remainder

#: Look-alikes (Cyrillic, Greek) and the Latin letters they stand for.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝмтвнкαεορτυχικνβ", "aeopcyxijshdqwmtbhkaeoptuxiknb", strict=True))
#: Digits and signs put for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i"}
#: Phrases in which a word of a lexicon that is given is harmless; a lexicon that is learnt learns its own.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "idiot proof", "pond scum", "pathetic fallacy", "scum line")
_TABLE = {c: " " for c in range(128) if not chr(c).isalnum()} | {ord(a): b for a, b in SUBSTITUTES.items()} | {ord(a): b for a, b in LOOKALIKES.items()} | {ord("l"): "i"} | {0x200B: None, 0x200C: None, 0x200D: None, 0x00AD: None}
_TABLE |= {0xFF01 + k: _TABLE.get(0x21 + k, chr(0x21 + k)) for k in range(94)}
_GAPS = re.compile(" +")


def fold(text: str | None) -> str:
    """Lower case, look-alikes and digits folded (l and 1 both become i), other ASCII signs to one space; a space at each end."""
    return _GAPS.sub(" ", f" {(text or '').lower().translate(_TABLE)} ")


@dataclass
class Lexicon:
    """Patterns on folded text with their weights, the exception phrases, and the logistic read-out."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-3.0, 2.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"} | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p, w in self.weights.items():
                a.add_word(p, (len(p), w))
            for p in self.exceptions:
                a.add_word(fold(p), (len(fold(p)), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight of all matches outside exception phrases, and that weight per 100 characters.

        Of the patterns that match at one start, the heaviest counts once.
        """
        t, a = fold(text), self.automaton()
        if not len(a):
            return 0.0, 0.0
        best: dict[int, float] = {}
        spared = []
        for end, (n, w) in a.iter(t):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            else:
                best[start] = max(w, best.get(start, 0.0))
        if spared:
            inside = {i for x, y in spared for i in range(x, y)}
            best = {s: w for s, w in best.items() if s not in inside}
        total = sum(best.values())
        return total, 100.0 * total / len(t)

    def neighbours(self, text: str | None) -> set[str]:
        """Pairs of words of which the lexicon matches in one (folded)."""
        words, out = fold(text).split(), set()
        most = max(map(len, self.weights), default=0)
        held = {w: any(f" {w} "[:n] in self.weights for n in range(1, min(most, len(w) + 2) + 1)) for w in set(words)}
        for a, b in zip(words, words[1:]):
            if held[a] or held[b]:
                out.add(f"{a} {b}")
        return out

    def score(self, text: str | None) -> float:
        total, density = self.features(text)
        b0, b1, b2 = self.coefficients
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, b0 + b1 * math.log1p(total) + b2 * math.log1p(density)))))


def _patterns(text: str, shortest: int, longest: int) -> set[str]:
    """Word starts of shortest to longest letters (" stem") and whole words (" word ")."""
    out = set()
    for w in set(text.split()):
        out.update(f" {w[:n]}" for n in range(shortest, min(longest, len(w)) + 1))
        out.add(f" {w} ")
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; x without a column of ones."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, min_docs: int = 12, precision: float = 0.97, shortest: int = 4, longest: int = 9, modulus: int = 4, held_out: int = 2, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn lexicon and weights from labelled documents whose crc32 remainder is not ``held_out``.

    At most ``sample`` documents of each label (the first by a hash of the id) are read for it: that is the documented bound.  A
    pattern is kept if at least ``min_docs`` toxic documents hold it and, after weighing the two samples alike, it is toxic with at least
    ``precision``; a word start makes its longer forms needless.  Its weight is its smoothed log odds.  Pattern counts are
    summed per task before they are shuffled, and only kept ones reach the driver (all of them; the sample bounds their number).  Rows with a null id or label are not used, a document
    with several labels is toxic if one of them says so, of several texts of one id that of least hash is read (ids are read as long); with no toxic label, the lexicon is empty and every score low.

    ``exceptions`` are phrases in which a pattern is harmless; to these come learnt ones: a matched word with the word after or before it, if at least ``min_docs`` clean
    documents hold it and, weighed alike, it is clean with at least ``precision``.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rates = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not rates.get(1) or not rates.get(0):
        return Lexicon({}, coefficients=(-4.0, 2.0, 1.0))
    ids = [r for t in (0, 1) for r in known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    picked = docs.sparkSession.createDataFrame([Row(doc_id=r.doc_id, toxic=int(r.toxic)) for r in ids], "doc_id long, toxic int")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0).join(F.broadcast(picked), "doc_id")
    rows = materialize(one_of_each(some, ["doc_id", "toxic"]).select("text", "toxic"), "labelled")  # read three times below
    n = [sum(r.toxic == t for r in ids) for t in (0, 1)]

    def count(batches):
        seen = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[toxic].update(_patterns(fold(text), shortest, longest))
        # A pattern without toxic documents here still tells against itself elsewhere, be it in one clean document.
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[t][k] for k in names], pa.int64()) for t in (0, 1))], names=["p", "clean", "toxic"])

    ratio = n[1] / n[0]
    counted = rows.mapInArrow(count, "p string, clean long, toxic long").groupBy("p").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    good = counted.where((F.col("toxic") >= min_docs) & (F.col("toxic") >= precision * (F.col("toxic") + ratio * F.col("clean")))).collect()
    chosen: dict[str, float] = {}
    for r in sorted(good, key=lambda r: (len(r.p.strip()), r.p.endswith(" "), r.p)):
        stem = r.p.rstrip()
        if not any(stem[:k] in chosen for k in range(shortest, len(stem) + 1)):
            chosen[r.p] = math.log((r.toxic + 0.5) / (ratio * r.clean + 0.5)) / 4
    lexicon = Lexicon(chosen, tuple(exceptions))

    def phrases(batches):
        seen = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[toxic].update(lexicon.neighbours(text))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[t][k] for k in names], pa.int64()) for t in (0, 1))], names=["p", "clean", "toxic"])

    met = rows.mapInArrow(phrases, "p string, clean long, toxic long").groupBy("p").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    harmless = met.where((F.col("clean") >= min_docs) & (ratio * F.col("clean") >= precision * (F.col("toxic") + ratio * F.col("clean")))).collect()  # bounded by the sample
    lexicon = Lexicon(chosen, (*exceptions, *sorted(r.p for r in harmless)))

    def measure(batches):
        for b in batches:
            f = [lexicon.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column(1)], names=["a", "b", "y"])

    m = np.array([tuple(r) for r in sorted(rows.mapInArrow(measure, "a double, b double, y int").collect())], float).reshape(-1, 3)
    if len(m):
        share = {t: rates[t] / sum(rates.values()) for t in (0, 1)}
        weight = np.where(m[:, 2] == 1, share[1] / max(1, (m[:, 2] == 1).sum()), share[0] / max(1, (m[:, 2] == 0).sum())) * len(m)
        lexicon.coefficients = tuple(map(float, logistic(np.log1p(m[:, :2]), m[:, 2], weight)))
    discard(rows)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out`` double in (0, 1).  A null or empty text scores as one without matches; all columns (but an older ``out``) and rows are kept."""
    kept = [c for c in docs.columns if c != out]
    df = docs.select(*kept)

    def run(batches):
        for b in batches:
            s = [lexicon.score(t) for t in b.column(kept.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, df.select("*", F.lit(0.0).alias(out)).schema)
