"""Language identification with blended-spectrum n-gram presence kernels, Nystroem landmarks and ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_of_each, remainder

#: Hash slots of one n-gram length; byte n-grams of 1 to 4 bytes are hashed apart.
SLOTS = 1 << 15
LENGTHS = (1, 2, 3, 4)
WIDTH = SLOTS * len(LENGTHS)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
_MULTIPLIER = np.uint32(2654435761)


def presence(text: str) -> np.ndarray:
    """The slots of all byte n-grams of the whole text, lower-cased, with signs and digits as spaces."""
    raw = f" {text.lower()} ".encode()
    b = _FOLD[np.frombuffer(raw, np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    seen = np.zeros(WIDTH, bool)
    code = np.zeros(len(b), np.uint32)
    for k, n in enumerate(LENGTHS):
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        seen[k * SLOTS + (((code * _MULTIPLIER) >> np.uint32(17)) & np.uint32(SLOTS - 1))] = True
    return seen


def slots(text: str) -> np.ndarray:
    """The numbers of those slots: a few bytes for each n-gram, and 512 KB at most."""
    return np.flatnonzero(presence(text)).astype(np.uint32)


def _dense(rows: list[np.ndarray]) -> list[np.ndarray]:
    out = np.zeros((len(rows), WIDTH), bool)
    for i, x in enumerate(rows):
        out[i, x] = True
    return list(out)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text[:64])) or text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """Landmarks as columns over the slots that they use, the Nystroem map and one weight column per language."""

    langs: list[str]
    used: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    mapping: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    slope: float = 6.0

    def kernel(self, seen: list[np.ndarray]) -> np.ndarray:
        """Normalised presence kernel with each landmark: shared slots over the geometric mean of both counts."""
        x = np.stack([s[self.used] for s in seen]).astype(np.float32)
        n = np.sqrt(np.array([max(1, np.count_nonzero(s)) for s in seen], np.float32))
        return (x @ self.landmarks) / (n[:, None] * self.norms[None, :])

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], np.ndarray]:
        names, best = ["und"] * len(texts), np.zeros(len(texts))
        ok = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for j in range(0, len(ok), batch):
            at = ok[j : j + batch]
            z = self.kernel([presence(texts[i]) for i in at]) @ self.mapping @ self.weights + self.offset
            e = np.exp(self.slope * (z - z.max(1, keepdims=True)))
            e /= e.sum(1, keepdims=True)
            for i, row in zip(at, e):
                k = int(row.argmax())
                names[i], best[i] = self.langs[k], float(row[k])
        return names, best


def train(texts: list[str], langs: list[str], landmarks: int = 96, ridge: float = 1e-2) -> Model:
    """``train_slots`` on texts."""
    return train_slots([slots(t) for t in texts], langs, landmarks, ridge)


def train_slots(seen: list[np.ndarray], langs: list[str], landmarks: int = 96, ridge: float = 1e-2) -> Model:
    """Landmarks (one of each language at least) are taken in turn from each language; then one-versus-rest kernel ridge regression in the Nystroem space."""
    names = sorted(set(langs))
    if not names:
        z = np.zeros((0, 0), np.float32)
        return Model([], np.zeros(0, int), z, np.zeros(0, np.float32), z, z, np.zeros(0, np.float32))
    order, by = [], {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    for k in range(max(map(len, by.values()))):
        order += [by[n][k] for n in names if k < len(by[n])]
    chosen = order[: max(landmarks, len(names))]
    marks = np.stack(_dense([seen[i] for i in chosen]))
    used = np.flatnonzero(marks.any(0))
    m = Model(names, used, np.ascontiguousarray(marks[:, used].T.astype(np.float32)), np.sqrt(np.maximum(1, marks.sum(1))).astype(np.float32), np.eye(len(chosen), dtype=np.float32), np.zeros((len(chosen), len(names)), np.float32), np.zeros(len(names), np.float32))
    value, vector = np.linalg.eigh(m.kernel(list(marks)).astype(float))
    good = value > 1e-6 * value.max()
    m.mapping = (vector[:, good] / np.sqrt(value[good])).astype(np.float32)
    k = np.concatenate([m.kernel(_dense(seen[i : i + 256])) for i in range(0, len(seen), 256)]).astype(float) @ m.mapping
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    count = np.array([langs.count(x) for x in langs], float)
    w = (len(langs) / len(names) / count)[:, None]
    mean = (w * k).sum(0) / w.sum()
    ymean = (w * y).sum(0) / w.sum()
    kc = k - mean
    m.weights = np.linalg.solve(kc.T @ (w * kc) + ridge * len(langs) / len(names) * np.eye(k.shape[1]), kc.T @ (w * (y - ymean))).astype(np.float32)
    m.offset = (ymean - mean @ m.weights).astype(np.float32)
    return m


def fit(docs: DataFrame, per_lang: int = 250, max_langs: int = 1000, modulus: int = 3, held_out: int = 1, **options) -> Model:
    """Learn from the text and non-null lang of documents whose crc32 remainder is not ``held_out``.

    Bound: ``per_lang`` documents of each language, the first by a hash of the id (of several texts of one id and language the one of least hash); more than ``max_langs`` languages are an error, none is left out.  Documents without a
    letter are not used.  Which documents these are is settled on ids alone, so no language is gathered in one task; n-gram slots of those
    documents reach the driver, not their texts, so a very long one counts for 512 KB at most.  Ids are read as long.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out) & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages: raise max_langs, or clean the labels")
    if not counts:
        return train([], [])
    # Twice the documents wanted of each language by a range of the hash (and some more, so that chance leaves enough); then the first of those.
    spot, space = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), 1 << 40
    bounds = docs.sparkSession.createDataFrame([(r.lang, min(space, space * (2 * per_lang + 100) // r.n)) for r in counts], "lang string, bound long")
    near = rows.join(F.broadcast(bounds), "lang").where(spot < F.col("bound"))  # max_langs rows
    ids = sorted((r.lang, r.spot, r.doc_id) for r in near.select("lang", spot.alias("spot"), F.col("doc_id").cast("long").alias("doc_id")).distinct().collect())
    taken, seen = [], {}
    for lang, _, doc_id in ids:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= per_lang:
            taken.append((lang, doc_id))
    if not taken:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame(sorted(set(taken)), "lang string, doc_id long")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([slots(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["lang", "doc_id", "slots"])

    texts = rows.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), ["lang", "doc_id"])
    texts = one_of_each(texts, ["lang", "doc_id"]).select("lang", "doc_id", "text")
    kept = sorted((r.lang, r.doc_id, bytes(r.slots)) for r in texts.mapInArrow(run, "lang string, doc_id long, slots binary").collect())
    return train_slots([np.frombuffer(x, np.uint32) for _, _, x in kept], [x for x, _, _ in kept], **options)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred (``und`` with score 0 if the text is null or has no letter) and score; all rows and other columns are kept."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    df = docs.select(*kept)

    def run(batches):
        for b in batches:
            names, s = model.predict(b.column(kept.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(s, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, df.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
