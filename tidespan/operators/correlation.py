"""Following one target by a correlation filter: ridge regression over all shifts of a template, solved in the Fourier domain and updated from frame to frame.

Training on a patch and all of its cyclic shifts, with a Gaussian peak as what they should give, is a linear system whose matrix is circulant; the Fourier transform
makes it diagonal, so a frame costs a few transforms rather than a solve.  Each frame is shifted to where the target was last seen, the filter says how far it has moved, and template and
filter are mixed with those of the frame at its new place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .intervals import _keys

#: Defaults: share of a new frame in the template, ridge, width of the Gaussian as a share of the frame, response below which a target counts as not found.
RATE, RIDGE, SIGMA, LEAST = 0.075, 1e-2, 0.1, 0.25
OUT = "frame bigint, dx int, dy int, peak double, found boolean"


class Filter:
    """The filter of one target in frames of ``height`` by ``width``."""

    def __init__(self, height: int, width: int, rate: float = RATE, ridge: float = RIDGE, sigma: float = SIGMA, fade: bool = True):
        self.shape, self.rate, self.ridge = (height, width), rate, ridge
        far = lambda n: np.minimum(np.arange(n), n - np.arange(n))  # noqa: E731  distance from the middle, which is put at the corner
        gap = (far(height)[:, None] / (sigma * height)) ** 2 + (far(width)[None] / (sigma * width)) ** 2
        self.wanted = np.fft.fft2(np.exp(-gap / 2))
        self.window = np.outer(np.hanning(height + 2)[1:-1], np.hanning(width + 2)[1:-1]) if fade else 1.0
        self.dx = self.dy = 0
        self.template = self.alpha = None

    def _patch(self, frame: np.ndarray) -> np.ndarray:
        """The frame around the target, brought to mean 0 and length 1, its borders faded."""
        x = np.roll(frame, (-self.dy, -self.dx), (0, 1))
        x = (x - x.mean()) * self.window
        size = np.sqrt((x * x).sum())
        return np.fft.fft2(x / size if size > 0 else x)

    def see(self, frame: np.ndarray) -> float:
        """The response at the best place (1.0 for the first frame); moves there and learns from the frame."""
        peak = 1.0
        if self.template is not None:
            seen = np.real(np.fft.ifft2(self._patch(frame) * np.conj(self.template) * self.alpha))
            y, x = np.unravel_index(int(np.round(seen, 12).argmax()), self.shape)
            peak = float(seen[y, x])
            self.dy, self.dx = (self.dy + int(y)) % self.shape[0], (self.dx + int(x)) % self.shape[1]
        x = self._patch(frame)
        alpha = self.wanted / (np.abs(x) ** 2 + self.ridge)
        mix = lambda old, new: new if old is None else (1 - self.rate) * old + self.rate * new
        self.template, self.alpha = mix(self.template, x), mix(self.alpha, alpha)
        return peak


def correlate(frames: DataFrame, key: str | list[str], frame: str, cells: str, width: int, least: float = LEAST, rate: float = RATE, ridge: float = RIDGE, sigma: float = SIGMA, fade: bool = True) -> DataFrame:
    """(key, frame, dx, dy, peak, found): how far the target of each video is shifted from where its first frame has it (cyclic), and the filter's response; ``found`` if that is at least ``least``.  With ``fade`` a frame loses weight towards its borders, as what is beyond them isn't what the other side shows.

    ``cells`` is an array of numbers row by row; frames that are null, hold nulls, or differ in size from the video's first are not found and teach nothing (peak null, the place of the frame before).
    Frames come in order of ``frame``, then of their cells; rows without a frame number are left out.  Videos are hashed to tasks and sorted there, and flow through one filter; what follows from a
    run of frames that aren't found is ``tracks.follow``'s matter.
    """
    keys = _keys(key)
    x = frames.where(F.col(frame).isNotNull()).select(F.struct(*keys).alias("v"), F.col(frame).cast("long").alias("frame"), F.col(cells).cast("array<double>").alias("cells"))
    done = StructType([x.schema["v"], *StructType.fromDDL(OUT).fields])

    def run(batches):
        video, held = None, None
        for b in batches:
            rows = []
            for v, f, c in zip(b.column("v").to_pylist(), b.column("frame").to_pylist(), b.column("cells").to_pylist()):
                if v != video:
                    video, held, size = v, None, None
                good = c and None not in c and len(c) % width == 0 and np.isfinite(c).all() and size in (None, len(c))
                if not good:
                    rows.append((f, held.dx if held else 0, held.dy if held else 0, None, False))
                    continue
                if held is None:
                    held, size = Filter(len(c) // width, width, rate, ridge, sigma, fade), len(c)
                peak = held.see(np.asarray(c).reshape(-1, width))
                rows.append((f, held.dx, held.dy, peak, peak >= least))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column("v"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_())], names=["v", "frame", "dx", "dy", "peak", "found"])

    moved = x.repartition("v").sortWithinPartitions("v", "frame", "cells").mapInArrow(run, done)
    return moved.select(*(F.col("v")[k].alias(k) for k in keys), *(c for c in moved.columns if c != "v"))
