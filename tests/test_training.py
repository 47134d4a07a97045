"""Epochs over Spark against a plain loop over the same batches, and gradients against differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidespan.functions import models, training
from tidespan.operators import dataset
from tidespan.plans.queries import QUERIES


def clips(n=260, seed=1):
    rnd = np.random.default_rng(seed)
    centers = rnd.standard_normal((3, 12))
    return [(i, int(i % 3), (centers[i % 3] + rnd.standard_normal(12) * 0.8).tolist()) for i in range(n)]


SCHEMA = "id long, y int, v array<double>"


def test_gradient_is_that_of_the_loss():
    rnd = np.random.default_rng(0)
    model, x, y = training.Model.fresh(3, 4, 5, 3, 1), rnd.standard_normal((7, 12)), rnd.integers(0, 3, 7)
    got = model.gradient(x, y)[0]
    for k, w in enumerate(model.weights):
        for at in np.ndindex(w.shape):
            losses = []
            for step in (1e-6, -1e-6):
                other = [z.copy() for z in model.weights]
                other[k][at] += step
                losses.append(training.Model(3, other).losses(x, y)[0].sum())
            assert got[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-5)


def test_epochs_equal_a_plain_loop(spark, tmp_path):
    odd = [(900, 1, None), (901, 1, [1.0]), (902, 9, [1.0] * 12), (903, None, [1.0] * 12), (904, 1, [float("nan")] * 12), (905, 0, [None] * 12)]
    d = spark.createDataFrame(clips() + odd, SCHEMA).repartition(5)
    done = training.train(d, "v", "y", "id", classes=3, frames=3, hidden=6, epochs=4, steps=5, rate=0.02, decay=0.05, checkpoints=str(tmp_path / "c"))
    good = d.where("id < 900").withColumnsRenamed({"id": "__key"})
    rows = dataset.split(good, "__key", 0.1, 0.1, 42).withColumn("b", F.pmod(F.xxhash64("__key", F.lit(42)), F.lit(5))).collect()
    pick = lambda split, b=None: [(np.array([r.v for r in rows if r.split == split and b in (None, r.b)]), np.array([r.y for r in rows if r.split == split and b in (None, r.b)]))][0]
    model, order = training.Model.fresh(3, 4, 6, 3, 42), np.random.default_rng(42)
    m, v, t, top, best = [0.0] * 4, [0.0] * 4, 0, 0.0, None
    for epoch in range(4):
        loss = right = n = 0
        for b in order.permutation(5):
            x, y = pick("train", b)
            frames = x.reshape(len(x), 3, 4)
            w1, b1, w2, b2 = model.weights
            up = np.maximum(frames @ w1 + b1, 0)
            s = up.mean(1) @ w2 + b2
            p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
            loss, right, n = loss - np.log(p[np.arange(len(y)), y]).sum(), right + (s.argmax(1) == y).sum(), n + len(y)
            e = (p - np.eye(3)[y]) / len(y)
            back = (e @ w2.T)[:, None, :] * (up > 0) / 3
            g = [sum(frames[i, f][:, None] * back[i, f] for i in range(len(x)) for f in range(3)), back.sum((0, 1)), up.mean(1).T @ e, e.sum(0)]
            t += 1
            m, v = [0.9 * a + 0.1 * z for a, z in zip(m, g)], [0.999 * a + 0.001 * z * z for a, z in zip(v, g)]
            model = training.Model(3, [w - 0.02 * 0.05 * w - 0.02 * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8) for w, a, c in zip(model.weights, m, v)])
        x, y = pick("validation")
        right_now = (model.scores(x).argmax(1) == y).mean()
        h = done.history[epoch]
        assert (h["train_loss"], h["train_accuracy"], h["loss"], h["accuracy"], h["improved"]) == pytest.approx((loss / n, right / n, model.losses(x, y)[0].mean(), right_now, right_now > top))
        if right_now > top:
            top, best = right_now, model
    assert all(np.allclose(a, b) for a, b in zip(done.last.weights, model.weights)) and all(np.allclose(a, b) for a, b in zip(done.best.weights, best.weights))
    x, y = pick("test")
    assert done.test["accuracy"] == pytest.approx((model.scores(x).argmax(1) == y).mean()) and top > 0.7
    kept = models.best_checkpoint(spark, str(tmp_path / "c")).first()
    assert all(np.allclose(a, b) for a, b in zip(done.last.unpacked(kept.weights).weights, best.weights)) and kept.score == top
    out = {r.id: r.predicted for r in training.predicted(d.withColumn("predicted", F.lit("x")), done.best, "v").collect()}
    assert out[900] is out[901] is out[904] is out[905] is None and out[902] is not None and np.mean([out[i] == i % 3 for i in range(260)]) > 0.7


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    for d in (none, spark.createDataFrame(clips(4), SCHEMA)):
        with pytest.raises(ValueError):
            training.train(d, "v", "y", "id", classes=3, frames=3)
    assert training.predicted(none, training.Model.fresh(3, 4, 5, 3, 1), "v").count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, y, v[:8] * 8) for i, y, v in clips(150)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["trained_epochs"](spark, str(tmp_path)).collect()
    assert len(out) == 150 and np.mean([r.label == r.predicted for r in out]) > 0.6
