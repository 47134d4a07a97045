"""Pixels and frames: gray, resized and blurred frames, mean colors and two-dimensional color histograms.

A region is an array of pixels (blue, green, red), a gray frame an array of cells row by row, with its width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights of blue, green and red in gray.
GRAY = (0.114, 0.587, 0.299)


def gray(pixels: Column) -> Column:
    """One cell 0 to 255 for each pixel."""
    return F.transform(pixels, lambda p: F.round(p[0] * GRAY[0] + p[1] * GRAY[1] + p[2] * GRAY[2]).cast("int"))


def quarter(cells: Column, width: Column) -> Column:
    """The frame at a quarter of its width and height: each cell is interpolated at the middle of its sixteen, the mean of the inner four."""
    w, h = F.floor(width / 4), F.floor(F.size(cells) / width / 4)

    def cell(i: Column) -> Column:
        at = (F.floor(i / w) * 4 + 1) * width + i % w * 4 + 1
        inner = (F.get(cells, (at + a * width + b).cast("int")) for a in (0, 1) for b in (0, 1))
        return F.round(sum(inner, F.lit(0)) / 4).cast("int")

    return F.when((w > 0) & (h > 0), F.transform(F.sequence(F.lit(0).cast("long"), w * h - 1), cell)).otherwise(F.array().cast("array<int>"))


def blurred(cells: Column, width: Column, size: int = 15) -> Column:
    """A Gaussian blur of ``size`` taps whose deviation follows from the size; borders are mirrored without their edge.

    By batch in NumPy, as every cell takes 30 products.
    """
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    off = np.arange(size) - size // 2
    taps = np.exp(-(off**2) / (2 * sigma**2))
    taps /= taps.sum()

    def along(x: np.ndarray) -> np.ndarray:
        n = x.shape[0]
        at = np.abs(np.arange(n)[:, None] + off) % max(1, 2 * (n - 1))
        return np.tensordot(taps, x[np.minimum(at, max(1, 2 * (n - 1)) - at) if n > 1 else at], ([0], [1]))

    @F.pandas_udf("array<int>")
    def run(frames: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for f, w in zip(frames, widths):
            x = None if f is None else np.asarray(f, float)
            out.append(x if x is None or not len(x) else np.rint(along(along(x.reshape(-1, int(w))).T).T).astype(int).ravel())
        return pd.Series(out)

    return run(cells, width)


def mean_color(pixels: Column) -> Column:
    """Mean (blue, green, red) of a region, fractions cut off; null for one without pixels."""
    channel = lambda c: F.aggregate(pixels, F.lit(0).cast("long"), lambda s, p: s + p[c])
    return F.when(F.size(pixels) > 0, F.array(*(F.floor(channel(c) / F.size(pixels)).cast("int") for c in range(3))))


def hsv8(p: Column) -> tuple[Column, Column]:
    """Hue 0 to 179 and saturation 0 to 255 of a pixel of bytes."""
    b, g, r = (p[i].cast("double") for i in range(3))
    top = F.greatest(b, g, r)
    d = top - F.least(b, g, r)
    hue = F.when(d == 0, 0.0).when(top == r, (g - b) * 30.0 / d).when(top == g, (b - r) * 30.0 / d + 60.0).otherwise((r - g) * 30.0 / d + 120.0)
    return F.pmod(F.round(F.when(hue < 0, hue + 180.0).otherwise(hue)), F.lit(180.0)), F.when(top == 0, 0.0).otherwise(F.round(d * 255.0 / top))


def color_histogram(df: DataFrame, key: list[str], pixels: str, bins: int = 16, out: str = "histogram") -> DataFrame:
    """key and array<double> of bins * bins (hue, then saturation), over its Euclidean norm; zeros for a region without pixels.

    Pixels are counted by (key, bin) before regions are put together, so a region may have any number of rows.
    """
    h, s = hsv8(F.col("p"))
    at = F.floor(h * bins / 180) * bins + F.floor(s * bins / 256)
    counted = df.select(*key, F.explode(pixels).alias("p")).select(*key, at.cast("int").alias("bin")).groupBy(*key, "bin").agg(F.count("*").alias("n"))
    held = counted.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(bins * bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("norm"), F.lit(0.0)))
    return df.select(*key).distinct().join(held, key, "left").select(*key, value.alias(out))
