"""Multi-object tracking: boxes of frames in order, joined to tracks by motion and likeness.

A track is a constant-velocity Kalman filter over box center, width by height, and height.  Its noise is the same for each of the four and nothing couples them, so the
filter is four filters of two states with closed forms, and all tracks of a frame move in a few array operations.  Confirmed tracks take detections first, those seen last before others, by likeness
to what they looked like before, within the gate of their motion; what is left is joined by overlap.  Both are least-cost assignments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segmented
from .intervals import _keys

#: Fixed values of the tracker: frames that a confirmed track outlives without a box, boxes in a row that confirm one, the most overlap cost (1 - IoU) and likeness cost (1 - cosine).
MAX_AGE, N_INIT, MOST_OVERLAP_COST, MOST_LIKENESS_COST = 30, 3, 0.7, 0.3
#: Fixed values of the filter: position and velocity noise as shares of a box's height, noise of the ratio (start, process, measurement) and of its velocity (start, process), and the
#: 95 % quantile of chi-square with four degrees of freedom.
POSITION, VELOCITY, RATIO, RATIO_VELOCITY, GATE = 1 / 20, 1 / 160, (1e-2, 1e-2, 1e-1), (1e-5, 1e-5), 9.4877
#: Looks that a track remembers.
GALLERY = 100
OUT = "frame bigint, box bigint, track bigint, confirmed boolean, time_since_update int, x1 double, y1 double, x2 double, y2 double"


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of an assignment of least total cost that uses every row or every column: shortest augmenting paths over reduced costs."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in least_cost(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, via, done = cost[row] - u[row] - v, np.full(m, -1), np.zeros(m, bool)
        while True:
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            step = dist[j] + cost[i] - u[i] - v
            nearer = ~done & (step < dist)
            dist[nearer], via[nearer] = step[nearer], j
        short = dist[j] - dist[done]
        held = np.flatnonzero(done)
        u[row] += dist[j]
        inner = owner[held] >= 0
        u[owner[held][inner]] += short[inner]
        v[held] -= short
        while j >= 0:  # hand columns on along the path
            owner[j] = owner[via[j]] if via[j] >= 0 else row
            j = via[j]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(2)
    area = lambda z: np.clip(z[:, 2:] - z[:, :2], 0, None).prod(1)
    return both / np.maximum(area(a)[:, None] + area(b)[None] - both, 1e-6)


class Tracks:
    """The tracks of one video; row i of every array is one track, in order of birth."""

    def __init__(self, max_age: int = MAX_AGE, n_init: int = N_INIT, overlap: float = MOST_OVERLAP_COST, likeness: float = MOST_LIKENESS_COST, gallery: int = GALLERY):
        self.max_age, self.n_init, self.overlap, self.likeness, self.gallery = max_age, n_init, overlap, likeness, gallery
        self.x, self.speed, self.p, self.c, self.v = (np.zeros((0, 4)) for _ in range(5))  # state, velocity, and their variances and covariance
        self.id, self.age, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.sure, self.looks, self.born = np.zeros(0, bool), [], 0

    def _keep(self, which: np.ndarray) -> None:
        for name in ("x", "speed", "p", "c", "v", "id", "age", "hits", "sure"):
            setattr(self, name, getattr(self, name)[which])
        self.looks = [self.looks[i] for i in np.flatnonzero(which)]

    def predict(self) -> None:
        h = self.x[:, 3:]
        noise, drift = np.repeat((POSITION * h) ** 2, 4, 1), np.repeat((VELOCITY * h) ** 2, 4, 1)
        noise[:, 2], drift[:, 2] = RATIO[1] ** 2, RATIO_VELOCITY[1] ** 2
        self.x = self.x + self.speed
        self.p, self.c, self.v = self.p + 2 * self.c + self.v + noise, self.c + self.v, self.v + drift
        self.age = self.age + 1

    def _spread(self) -> np.ndarray:
        noise = np.repeat((POSITION * self.x[:, 3:]) ** 2, 4, 1)
        noise[:, 2] = RATIO[2] ** 2
        return self.p + noise

    def corners(self) -> np.ndarray:
        size = np.stack([self.x[:, 2] * self.x[:, 3], self.x[:, 3]], 1)
        return np.concatenate([self.x[:, :2] - size / 2, self.x[:, :2] + size / 2], 1)

    def _pairs(self, tracks: np.ndarray, boxes: np.ndarray, cost: np.ndarray, most: float) -> list[tuple[int, int]]:
        """Least-cost pairs at ``most`` or below; any pair above it is as good as none."""
        if not len(tracks) or not len(boxes):
            return []
        price = np.where(cost > most, most + 1e-5, cost)
        return [(int(tracks[i]), int(boxes[j])) for i, j in least_cost(price) if cost[i, j] <= most]

    def _likeness(self, tracks: np.ndarray, boxes: np.ndarray, z: np.ndarray, looks: list) -> np.ndarray:
        cost, spread = np.full((len(tracks), len(boxes)), np.inf), self._spread()
        for a, i in enumerate(tracks):
            near = ((z[boxes] - self.x[i]) ** 2 / spread[i]).sum(1) <= GATE
            for b in np.flatnonzero(near):
                look = looks[boxes[b]]
                if look is not None:
                    cost[a, b] = min((1 - float(look @ old) for old in self.looks[i] if len(old) == len(look)), default=np.inf)
        return cost

    def missed(self) -> None:
        """A frame without boxes."""
        self.predict()
        self._keep(self.sure & (self.age <= self.max_age))

    def update(self, boxes: np.ndarray, looks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One frame: boxes (x1, y1, x2, y2) and unit vectors of how they look (None: unknown).  Gives track, confirmed, age and the filtered box of each."""
        self.predict()
        size = boxes[:, 2:] - boxes[:, :2]
        z = np.concatenate([(boxes[:, :2] + boxes[:, 2:]) / 2, size[:, :1] / np.maximum(size[:, 1:], 1e-6), size[:, 1:]], 1)
        free, mine = np.ones(len(boxes), bool), np.full(len(self.id), -1)
        for age in np.unique(self.age[self.sure]):
            tracks, left = np.flatnonzero(self.sure & (self.age == age)), np.flatnonzero(free)
            for i, j in self._pairs(tracks, left, self._likeness(tracks, left, z, looks), self.likeness):
                mine[i], free[j] = j, False
        tracks, left = np.flatnonzero((mine < 0) & (~self.sure | (self.age == 1))), np.flatnonzero(free)
        for i, j in self._pairs(tracks, left, 1 - _iou(self.corners()[tracks], boxes[left]), self.overlap):
            mine[i], free[j] = j, False
        got = np.flatnonzero(mine >= 0)
        s, gap = self._spread()[got], z[mine[got]] - self.x[got]
        gain, slow = self.p[got] / s, self.c[got] / s
        self.x[got] += gain * gap
        self.speed[got] += slow * gap
        self.v[got] -= slow * self.c[got]
        self.p[got] *= 1 - gain
        self.c[got] *= 1 - gain
        self.age[got] = 0
        self.hits[got] += 1
        for i in got:
            if looks[mine[i]] is not None:
                self.looks[i] = [*self.looks[i], looks[mine[i]]][-self.gallery :]
        self.sure |= self.hits >= self.n_init
        keep = (mine >= 0) | (self.sure & (self.age <= self.max_age))
        self._keep(keep)
        owner = np.full(len(boxes), -1)
        alive = mine[keep]
        owner[alive[alive >= 0]] = np.flatnonzero(alive >= 0)
        new = np.flatnonzero(free)
        owner[new] = len(self.id) + np.arange(len(new))
        h = z[new, 3:]
        p, v = np.repeat((2 * POSITION * h) ** 2, 4, 1), np.repeat((10 * VELOCITY * h) ** 2, 4, 1)
        p[:, 2], v[:, 2] = RATIO[0] ** 2, RATIO_VELOCITY[0] ** 2
        zero = np.zeros_like(p)
        for name, more in (("x", z[new]), ("speed", zero), ("p", p), ("c", zero), ("v", v), ("id", self.born + 1 + np.arange(len(new))), ("age", np.zeros(len(new), np.int64)), ("hits", np.ones(len(new), np.int64)), ("sure", np.full(len(new), self.n_init <= 1))):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.looks += [[] if looks[j] is None else [looks[j]] for j in new]
        self.born += len(new)
        return self.id[owner], self.sure[owner], self.age[owner], self.corners()[owner]


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, list[dict]]]:
    """(video, frame, boxes) from rows that come sorted; a frame may go over a batch's end."""
    held, at = [], None
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["v"], row["frame"])
            if now != at and held:
                yield (*at, held)
                held = []
            at = now
            held.append(row)
    if held:
        yield (*at, held)


def multi_object(boxes: DataFrame, key: str | list[str], frame: str = "frame", box: str = "box", corners: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), look: str | None = "look", every_frame: bool = False, max_age: int = MAX_AGE, n_init: int = N_INIT, overlap: float = MOST_OVERLAP_COST, likeness: float = MOST_LIKENESS_COST, gallery: int = GALLERY, rows: int = segmented.ROWS) -> DataFrame:
    """One row per box: the key, spell, frame, box, its track (from 1 within key and spell), confirmed, time_since_update (0) and the filtered corners.

    ``tracks.fresh`` leaves those of confirmed tracks.  ``look`` is an array of doubles, compared by cosine; null, zero or of another length than before: not alike.  Rows with a null frame or corner are left out;
    boxes of one frame come in order of ``box``, then of their corners, and two with one number are two boxes.  A video without boxes has no rows.

    The filter steps once for each frame that has boxes.  With ``every_frame`` frames without boxes count too: they age all tracks, and more than ``max_age`` of them end every track, so
    what lies between such holes (a *spell*) is tracked on its own, by another task; the spells of a video of more than 2 * ``rows`` boxes are found range by range (``segmented``).  Rows are hashed by video and spell and sorted in their partition, and flow
    through the tracks that are alive; memory doesn't grow with a video's length.
    """
    keys = _keys(key)
    x = boxes.select(*keys, F.col(frame).cast("long").alias("frame"), F.col(box).cast("long").alias("box"), *(F.col(c).cast("double").alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"))), (F.col(look).cast("array<double>") if look else F.lit(None).cast("array<double>")).alias("look"))
    x = x.dropna(subset=["frame", "x1", "y1", "x2", "y2"])
    x = segmented.session_ids(x, keys, "frame", max_age + 1, out="spell", rows=rows) if every_frame else x.withColumn("spell", F.lit(0).cast("long"))
    x = x.select(F.struct(*keys, F.col("spell").cast("long").alias("spell")).alias("v"), "frame", "box", "x1", "y1", "x2", "y2", "look")

    def run(batches):
        video, tracks, last, out = None, None, 0, []
        for v, f, rows in _frames(batches):
            if v != video:
                video, tracks, last = v, Tracks(max_age, n_init, overlap, likeness, gallery), f
            for _ in range(f - last - 1 if every_frame else 0):
                tracks.missed()
            last = f
            looks = []
            for r in rows:
                a = np.array(r["look"] or [], float)
                size = np.sqrt(a @ a)
                looks.append(a / size if size > 0 and np.isfinite(size) else None)
            ids, sure, age, at = tracks.update(np.array([[r[c] for c in ("x1", "y1", "x2", "y2")] for r in rows]), looks)
            out += [{"v": v, "frame": f, "box": r["box"], "track": i, "confirmed": s, "time_since_update": a, **dict(zip(("x1", "y1", "x2", "y2"), z))} for r, i, s, a, z in zip(rows, ids.tolist(), sure.tolist(), age.tolist(), at.tolist())]
            if len(out) >= 5000:
                yield from pa.Table.from_pylist(out, schema).to_batches()
                out = []
        if out:
            yield from pa.Table.from_pylist(out, schema).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    done = StructType([x.schema["v"], *StructType.fromDDL(OUT).fields])
    schema = to_arrow_schema(done)
    moved = x.repartition("v").sortWithinPartitions("v", "frame", "box", "x1", "y1", "x2", "y2").mapInArrow(run, done)
    return moved.select(*(F.col("v")[k].alias(k) for k in [*keys, "spell"]), *(c for c in moved.columns if c != "v"))
