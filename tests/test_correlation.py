"""The correlation filter against a dense solve of the same regression."""

import numpy as np
import pytest

from tidespan.operators import correlation
from tidespan.plans.queries import QUERIES


def dense(frames, faded, rate=0.075, ridge=1e-2, sigma=0.1):
    """Every cyclic shift is a row; the dual weights come from solving with the matrix of their products."""
    h, w = frames[0].shape
    shifts = lambda x: np.array([np.roll(x, (a, b), (0, 1)).ravel() for a in range(h) for b in range(w)])
    fade = np.outer(np.hanning(h + 2)[1:-1], np.hanning(w + 2)[1:-1]) if faded else 1.0
    y = np.array([np.exp(-((min(a, h - a) / (sigma * h)) ** 2 + (min(b, w - b) / (sigma * w)) ** 2) / 2) for a in range(h) for b in range(w)])
    dy = dx = 0
    template = alpha = None
    out = []

    def patch(f):
        x = np.roll(f, (-dy, -dx), (0, 1))
        x = (x - x.mean()) * fade
        return x / np.linalg.norm(x)

    for f in frames:
        peak = 1.0
        if template is not None:
            z = patch(f)
            kernel = shifts(template) @ z.ravel()  # of z with every shift of the template
            grid = kernel.reshape(h, w)
            seen = np.array([sum(grid[(a - i) % h, (b - j) % w] * alpha[i * w + j] for i in range(h) for j in range(w)) for a in range(h) for b in range(w)])
            best = int(np.round(seen, 9).argmax())
            peak, dy, dx = seen[best], (dy + best // w) % h, (dx + best % w) % w
        x = patch(f)
        s = shifts(x)
        new = np.linalg.solve(s @ s.T + ridge * np.eye(h * w), y)
        template, alpha = (x, new) if template is None else ((1 - rate) * template + rate * x, (1 - rate) * alpha + rate * new)
        out.append((dx, dy, peak))
    return out


@pytest.mark.parametrize("fade", [True, False])
def test_equals_the_dense_solve(spark, fade):
    rnd, rows, videos = np.random.default_rng(3), [], {}
    for v in range(5):
        base = rnd.standard_normal((6, 8))
        videos[v] = [np.roll(base, (t // 2, -t), (0, 1)) + 0.2 * rnd.standard_normal((6, 8)) for t in range(12)]
        rows += [(v, t, f.ravel().tolist()) for t, f in enumerate(videos[v])]
    d = spark.createDataFrame(rows, "video int, frame int, cells array<double>").repartition(4)
    got = {(r.video, r.frame): (r.dx, r.dy, r.peak) for r in correlation.correlate(d, "video", "frame", "cells", 8, fade=fade).collect()}
    for v, frames in videos.items():
        for t, want in enumerate(dense(frames, fade)):
            assert got[v, t] == pytest.approx(want, abs=1e-8), (v, t)
    assert fade or all(got[v, t][:2] == (-t % 8, t // 2 % 6) for v in videos for t in range(12))


def test_odd_frames(spark):
    good = [float(i % 5) for i in range(16)]
    rows = [("a", 0, None), ("a", 1, good), ("a", 2, good[:8]), ("a", 3, [None] * 16), ("a", 4, [float("nan")] * 16), ("a", 5, good), ("a", None, good), (None, 0, good), ("flat", 0, [1.0] * 16), ("flat", 1, [1.0] * 16)]
    d = spark.createDataFrame(rows, "video string, frame int, cells array<double>")
    got = {(r.video, r.frame): (r.dx, r.dy, r.found) for r in correlation.correlate(d, "video", "frame", "cells", 4).collect()}
    assert got == {("a", 0): (0, 0, False), ("a", 1): (0, 0, True), ("a", 2): (0, 0, False), ("a", 3): (0, 0, False), ("a", 4): (0, 0, False), ("a", 5): (0, 0, True), (None, 0): (0, 0, True), ("flat", 0): (0, 0, True), ("flat", 1): (0, 0, False)}
    assert correlation.correlate(d.where("false"), "video", "frame", "cells", 4).count() == 0


def test_query_follows_the_motion(spark, tmp_path):
    rnd = np.random.default_rng(1)
    spark.createDataFrame([(i, (rnd.standard_normal(64) / 8).tolist()) for i in range(160)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["correlated_track"](spark, str(tmp_path)).collect()
    right = np.mean([(r.dx, r.dy) == (r.frame % 8, r.frame // 3 % 8) for r in out])
    assert len(out) == 160 and right > 0.9
