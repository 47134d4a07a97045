"""Training of a frame-pooling classifier in epochs of mini-batches whose gradients are summed where the rows are.

A clip is ``frames`` frames of equal length.  The encoder (a layer with a rectifier) sees each frame, its outputs are averaged over the frames, and a linear head gives the scores of the classes.
Rows are dealt to the mini-batches of an epoch once, by a hash of their id, and written by batch, so that a step reads its own rows only and an epoch reads all of them once; the
order of the batches changes from epoch to epoch.  A task gives the gradient of its rows, an aggregation adds them up, and the weights (a few numbers for each input and class)
are moved by decoupled weight decay and bias-corrected moments (AdamW) on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dataset
from ..sources import scratch
from . import models

#: Fixed values of the optimiser.
BETA, EPSILON = (0.9, 0.999), 1e-8


@dataclass
class Model:
    """Weights: encoder (inputs, hidden) and its bias, head (hidden, classes) and its bias."""

    frames: int
    weights: list[np.ndarray]

    @staticmethod
    def fresh(frames: int, inputs: int, hidden: int, classes: int, seed: int) -> Model:
        rnd = np.random.default_rng(seed)
        layer = lambda n, m: (rnd.uniform(-1, 1, (n, m)) / np.sqrt(n), rnd.uniform(-1, 1, m) / np.sqrt(n))
        return Model(frames, [*layer(inputs, hidden), *layer(hidden, classes)])

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        frames = x.reshape(len(x), self.frames, -1)
        pre = frames @ self.weights[0] + self.weights[1]
        return frames, np.maximum(pre, 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1].mean(1) @ self.weights[2] + self.weights[3]

    def losses(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross entropy and predicted class of each row, and the probabilities."""
        s = self.scores(x)
        s = s - s.max(1, keepdims=True)
        total = np.log(np.exp(s).sum(1))
        return total - s[np.arange(len(y)), y], s.argmax(1), np.exp(s - total[:, None])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float, int]:
        """Sums over the rows: of the gradient, the loss, and the rows predicted right."""
        loss, predicted, p = self.losses(x, y)
        frames, up = self.hidden(x)
        p[np.arange(len(y)), y] -= 1
        pooled = up.mean(1)
        back = (p @ self.weights[2].T)[:, None] * (up > 0) / self.frames
        return [np.einsum("nfi,nfh->ih", frames, back), back.sum((0, 1)), pooled.T @ p, p.sum(0)], float(loss.sum()), int((predicted == y).sum())

    def packed(self) -> bytes:
        return b"".join(w.tobytes() for w in self.weights)

    def unpacked(self, raw: bytes) -> Model:
        flat, out, at = np.frombuffer(raw), [], 0
        for w in self.weights:
            out.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        return Model(self.frames, out)


@dataclass
class AdamW:
    rate: float
    decay: float
    step: int = 0
    first: list = field(default_factory=list)
    second: list = field(default_factory=list)

    def move(self, weights: list[np.ndarray], gradient: list[np.ndarray]) -> list[np.ndarray]:
        self.step += 1
        self.first = [BETA[0] * m + (1 - BETA[0]) * g for m, g in zip(self.first or [0.0] * len(weights), gradient)]
        self.second = [BETA[1] * v + (1 - BETA[1]) * g * g for v, g in zip(self.second or [0.0] * len(weights), gradient)]
        a, b = 1 - BETA[0] ** self.step, 1 - BETA[1] ** self.step
        return [w * (1 - self.rate * self.decay) - self.rate * (m / a) / (np.sqrt(v / b) + EPSILON) for w, m, v in zip(weights, self.first, self.second)]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    return np.asarray(batch.column("__x").flatten(), float).reshape(n, -1) if n else np.zeros((0, 0)), batch.column("__y").to_numpy()


def _summed(df: DataFrame, model: Model) -> np.ndarray:
    """Gradient (flat), loss, rows predicted right and rows, over all of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                g, loss, right = model.gradient(*_rows(b))
                one = np.concatenate([*(x.ravel() for x in g), [loss, right, b.num_rows]])
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "x"])

    found = df.select("__x", "__y").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # one row for each weight
    out = np.zeros(sum(w.size for w in model.weights) + 3)
    for r in found:
        out[r.at] = r.x
    return out


def predicted(df: DataFrame, model: Model, vector: str, out: str = "predicted") -> DataFrame:
    """Adds the class that a model predicts; null where the vector is null, of another length or not finite."""
    size = model.frames * model.weights[0].shape[0]
    rest = df.columns
    schema = [f.dataType for f in df.schema]
    from pyspark.sql.types import IntegerType, StructField, StructType

    ok = F.coalesce((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))

    def run(batches):
        for b in batches:
            good = np.array(b.column("__ok").to_pylist(), bool)
            at = np.full(b.num_rows, -1)
            if good.any():
                x = b.column("__v").filter(pa.array(good))
                at[good] = model.scores(np.asarray(x.flatten(), float).reshape(len(x), -1)).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(at, pa.int32(), mask=~good)], names=[*(f"c{i}" for i in range(len(rest))), "p"])

    x = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), ok.alias("__ok"), F.col(vector).cast("array<double>").alias("__v"))
    done = x.mapInArrow(run, StructType([StructField(f"c{i}", t) for i, t in enumerate(schema)] + [StructField("p", IntegerType())]))
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest) if c != out), F.col("p").alias(out))


@dataclass
class Trained:
    best: Model
    last: Model
    history: list[dict]
    test: dict | None


def train(df: DataFrame, vector: str, label: str, key: str, classes: int, frames: int, hidden: int = 16, epochs: int = 5, steps: int = 8, rate: float = 1e-4, decay: float = 1e-2, validation: float = 0.1, test: float = 0.1, seed: int = 42, checkpoints: str | None = None) -> Trained:
    """Train on the rows of ``dataset.split``; after each epoch the validation rows are scored, and the first model with the highest accuracy above 0 is kept (and appended to ``checkpoints``).

    ``vector`` is an array of frames * inputs numbers, ``label`` a class from 0 to ``classes`` - 1.  Rows whose vector is null, of another length than the longest, or not finite, or whose label is none of these, take
    no part.  ``history`` has epoch, loss and accuracy over the training steps, loss and accuracy of validation, best and improved for each epoch; ``test`` the loss and accuracy of the last model.  Without
    training or validation rows there is nothing to learn: ValueError.
    """
    spark = df.sparkSession
    x = df.where(F.col(label).between(0, classes - 1) & F.col(vector).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("long").alias("__y"), F.col(vector).cast("array<double>").alias("__x"))
    x = x.where(~F.exists("__x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    size = x.agg(F.max(F.size("__x"))).first()[0] or 0
    if size < frames or size % frames:
        raise ValueError("no vector of frames of equal length")
    sets = dataset.split(x.where(F.size("__x") == size), "__key", validation, test, seed)
    path = f"{scratch.folder(spark)}/training-{uuid.uuid4().hex}"
    sets.withColumn("__batch", F.pmod(F.xxhash64("__key", F.lit(seed)), F.lit(steps)).cast("int")).repartition("split", "__batch").write.partitionBy("split", "__batch").parquet(path)
    rows = spark.read.parquet(path)
    rows._written = path
    counts = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    if not counts.get("train") or not counts.get("validation"):
        raise ValueError("the split left no rows to train on or to validate with")
    model, optimiser, order = Model.fresh(frames, size // frames, hidden, classes, seed), AdamW(rate, decay), np.random.default_rng(seed)
    shapes = [w.shape for w in model.weights]
    best, history, top = model, [], 0.0
    for epoch in range(1, epochs + 1):
        loss = right = seen = 0.0
        for b in order.permutation(steps).tolist():
            s = _summed(rows.where(f"split = 'train' and __batch = {b}"), model)
            if s[-1]:
                parts = np.split(s[:-3] / s[-1], np.cumsum([np.prod(z) for z in shapes])[:-1])
                model = Model(frames, optimiser.move(model.weights, [p.reshape(z) for p, z in zip(parts, shapes)]))
                loss, right, seen = loss + s[-3], right + s[-2], seen + s[-1]
        held = evaluated(rows.where("split = 'validation'"), model)
        improved = held["accuracy"] > top
        history.append({"epoch": epoch, "train_loss": loss / seen, "train_accuracy": right / seen, **held, "best": max(top, held["accuracy"]), "improved": improved})
        if improved:
            best, top = model, held["accuracy"]
            if checkpoints:
                models.save_checkpoint(spark, checkpoints, epoch, top, model.packed(), [str(c) for c in range(classes)])
    last = evaluated(rows.where("split = 'test'"), model) if counts.get("test") else None
    scratch.discard(rows)
    return Trained(best, model, history, last)


def evaluated(rows: DataFrame, model: Model) -> dict:
    """Loss and accuracy, by ``dataset.metrics``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = _rows(b)
                loss, at, _ = model.losses(x, y)
                yield pa.RecordBatch.from_arrays([b.column("__y"), pa.array(at.astype(np.int64)), pa.array(loss)], names=["y", "p", "loss"])

    scored = rows.select("__x", "__y").mapInArrow(run, "y long, p long, loss double")
    r = dataset.metrics(scored.withColumn("all", F.lit(0)), ["all"], F.col("p"), F.col("y"), F.col("loss"), F.lit(1)).first()
    return {"loss": r.loss, "accuracy": r.accuracy}
