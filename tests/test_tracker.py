"""The multi-object tracker against a plain loop with full matrices and assignments by trying all, and its query."""

import itertools
import os
import random

import numpy as np
import pytest

from tidespan.operators import tracker, tracks
from tidespan.plans.queries import QUERIES


def cheapest(cost):
    """All assignments tried."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in cheapest(cost.T)]
    best = min(itertools.permutations(range(m), n), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))
    return list(enumerate(best))


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / (max(0, a[2] - a[0]) * max(0, a[3] - a[1]) + max(0, b[2] - b[0]) * max(0, b[3] - b[1]) - both)


class Plain:
    """Eight states, 8 x 8 matrices, one track at a time."""

    MOVE = np.eye(8) + np.eye(8, k=4)
    SEE = np.eye(4, 8)

    def __init__(self):
        self.tracks, self.born = [], 0

    @staticmethod
    def diagonal(h, a, b, c, d):
        return np.diag(np.square([a * h, a * h, b, a * h, c * h, c * h, d, c * h]))

    def predict(self):
        for t in self.tracks:
            q = self.diagonal(t["m"][3], 1 / 20, 1e-2, 1 / 160, 1e-5)
            t["m"], t["P"] = self.MOVE @ t["m"], self.MOVE @ t["P"] @ self.MOVE.T + q
            t["age"] += 1

    def seen(self, t):
        r = np.diag(np.square([t["m"][3] / 20, t["m"][3] / 20, 0.1, t["m"][3] / 20]))
        return self.SEE @ t["P"] @ self.SEE.T + r

    def match(self, ts, ds, cost, most):
        if not ts or not ds:
            return []
        c = np.array([[cost(t, d) for d in ds] for t in ts])
        return [(ts[i], ds[j]) for i, j in cheapest(np.where(c > most, most + 1e-5, c)) if c[i, j] <= most]

    @staticmethod
    def corners(m):
        w, h = m[2] * m[3], m[3]
        return [m[0] - w / 2, m[1] - h / 2, m[0] + w / 2, m[1] + h / 2]

    def step(self, boxes, looks):
        self.predict()
        ds = [{"z": np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / (b[3] - b[1]), b[3] - b[1]]), "b": b, "look": look, "t": None} for b, look in zip(boxes, looks)]
        for t in self.tracks:
            t["d"] = None

        def unlike(t, d):
            y = d["z"] - t["m"][:4]
            if y @ np.linalg.inv(self.seen(t)) @ y > 9.4877 or d["look"] is None or not t["looks"]:
                return 9.0
            return min(1 - d["look"] @ x for x in t["looks"])

        def join(pairs):
            for t, d in pairs:
                t["d"], d["t"] = d, t

        for age in range(1, 32):
            join(self.match([t for t in self.tracks if t["sure"] and t["age"] == age], [d for d in ds if d["t"] is None], unlike, 0.3))
        rest = [t for t in self.tracks if t["d"] is None and (not t["sure"] or t["age"] == 1)]
        join(self.match(rest, [d for d in ds if d["t"] is None], lambda t, d: 1 - overlap(self.corners(t["m"]), d["b"]), 0.7))
        for t in list(self.tracks):
            if t["d"] is None:
                if not t["sure"] or t["age"] > 30:
                    self.tracks.remove(t)
                continue
            s = self.seen(t)
            k = t["P"] @ self.SEE.T @ np.linalg.inv(s)
            t["m"], t["P"] = t["m"] + k @ (t["d"]["z"] - t["m"][:4]), t["P"] - k @ s @ k.T
            t["age"], t["hits"] = 0, t["hits"] + 1
            t["sure"] |= t["hits"] >= 3
            t["looks"] = (t["looks"] + ([t["d"]["look"]] if t["d"]["look"] is not None else []))[-100:]
        for d in ds:
            if d["t"] is None:
                self.born += 1
                d["t"] = {"id": self.born, "m": np.append(d["z"], np.zeros(4)), "P": self.diagonal(d["z"][3], 2 / 20, 1e-2, 10 / 160, 1e-5), "age": 0, "hits": 1, "sure": False, "looks": [d["look"]] if d["look"] is not None else [], "d": None}
                self.tracks.append(d["t"])
        return [(d["t"]["id"], d["t"]["sure"], *self.corners(d["t"]["m"])) for d in ds]

    def missed(self):
        self.predict()
        self.tracks = [t for t in self.tracks if t["sure"] and t["age"] <= 30]


def plain(rows, every_frame):
    out, videos = {}, {}
    for v, f, b, *c, look in sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        videos.setdefault(v, {}).setdefault(f, []).append((b, c, look))
    for v, frames in videos.items():
        t, last, spell = Plain(), min(frames), 0
        for f in sorted(frames):
            if every_frame and f - last > 31:
                t, spell = Plain(), spell + 1
            else:
                for _ in range(f - last - 1 if every_frame else 0):
                    t.missed()
            last = f
            looks = [None if not look or not any(look) else np.array(look) / np.linalg.norm(look) for *_, look in frames[f]]
            for (b, *_), got in zip(frames[f], t.step([c for _, c, _ in frames[f]], looks)):
                out[v, spell, f, b] = got
    return out


def scene(seed, videos=6, frames=70):
    """People who walk, cross, vanish for a while and come back, with some boxes that belong to nobody."""
    rnd, rows = random.Random(seed), []
    for v in range(videos):
        people = [([rnd.uniform(0, 400), rnd.uniform(0, 200)], [rnd.uniform(-6, 6), rnd.uniform(-3, 3)], rnd.uniform(50, 120), [rnd.gauss(0, 1) for _ in range(5)]) for _ in range(4)]
        away = {(p, f) for p in range(4) for s in [rnd.randrange(frames)] for f in range(s, s + rnd.choice([1, 2, 5, 40]))}
        for f in range(frames):
            at = f if f < 40 else f + rnd.choice([0]) + (25 if v % 3 == 1 else 45 if v % 3 == 2 else 0)
            n = 0
            for p, (xy, go, h, look) in enumerate(people):
                xy[0], xy[1] = xy[0] + go[0] + rnd.gauss(0, 1), xy[1] + go[1] + rnd.gauss(0, 1)
                if (p, f) in away or rnd.random() < 0.1:
                    continue
                seen = [x + rnd.gauss(0, 0.2) for x in look] if rnd.random() < 0.9 else rnd.choice([None, [0.0] * 5])
                rows.append((v, at, n, xy[0], xy[1], xy[0] + h * 0.4, xy[1] + h, seen))
                n += 1
            if rnd.random() < 0.2:
                x = rnd.uniform(0, 400)
                rows.append((v, at, n, x, 10.0, x + 30, 90.0, [rnd.gauss(0, 1) for _ in range(5)]))
    return rows


SCHEMA = "video long, frame long, box long, x1 double, y1 double, x2 double, y2 double, look array<double>"


@pytest.mark.parametrize("every_frame", [False, True])
def test_tracks_equal_a_plain_loop(spark, every_frame):
    rows = scene(5) + [(0, None, 1, 0.0, 0.0, 1.0, 1.0, None), (0, 3, 9, None, 0.0, 1.0, 1.0, None)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.video, r.spell, r.frame, r.box): (r.track, r.confirmed, r.x1, r.y1, r.x2, r.y2) for r in tracker.multi_object(d, "video", every_frame=every_frame, rows=40).collect()}
    want = plain(rows, every_frame)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:2] == want[k][:2] and got[k][2:] == pytest.approx(want[k][2:], abs=1e-6), k
    assert len({(k[0], k[1], g[0]) for k, g in got.items() if g[1]}) >= 4 * 6
    assert every_frame == any(k[1] for k in got)  # holes of 45 frames split videos into spells only where frames without boxes count


def test_ties_repeated_boxes_and_nothing(spark):
    rows = [("a", f, 0, 0.0, 0.0, 20.0, 40.0, [1.0, 0.0]) for f in range(4) for _ in range(2)] + [(None, 1, 0, 5.0, 5.0, 25.0, 50.0, None)]
    d = spark.createDataFrame(rows, SCHEMA.replace("video long", "video string"))
    got = tracker.multi_object(d, "video").collect()
    assert len(got) == 9 and {r.track for r in got if r.video == "a" and r.frame == 3} == {1, 2}
    assert [(r.track, r.confirmed) for r in got if r.video is None] == [(1, False)]
    assert tracks.fresh(tracker.multi_object(d, "video")).count() == 4
    assert tracker.multi_object(d.where("false"), "video", every_frame=True).count() == 0
    assert tracker.multi_object(d.drop("look"), "video", look=None).count() == 9


def test_least_cost():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        c = rnd.random((rnd.integers(1, 6), rnd.integers(1, 6)))
        c[rnd.random(c.shape) < 0.3] = 0.7
        got = tracker.least_cost(c)
        assert len(got) == min(c.shape) == len({i for i, _ in got}) == len({j for _, j in got})
        assert sum(c[p] for p in got) == pytest.approx(sum(c[p] for p in cheapest(c)))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark):
    from tidespan.plans.tracked import video_boxes

    got = {(r.video, 0, r.frame, r.box): (r.track, r.x1, r.y1, r.x2, r.y2) for r in QUERIES["tracked_boxes"](spark, SF).collect()}
    rows = [tuple(r) for r in video_boxes(spark, SF).select("video", "frame", "box", "x1", "y1", "x2", "y2", "look").collect()]
    want = {k: (x[0], *x[2:]) for k, x in plain(rows, False).items() if x[1]}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_spells_of_one_long_video(spark):
    """Side by side, the spells give what the videos give that they are made of."""
    from tidespan.plans.tracked import FRAME, HOLE, VIDEO

    whole = {(r.video, r.frame, r.box): (r.track, r.x1, r.y1) for r in QUERIES["tracked_boxes"](spark, SF).collect()}
    step, got = VIDEO // FRAME + HOLE + 2, {}
    for r in QUERIES["tracked_spells"](spark, SF).collect():
        got[r.frame // step, r.frame % step, r.box] = (r.track, r.x1, r.y1)
    assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k], abs=2e-6) for k in whole)
