"""Colors, histograms, boxes and candidate scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named colors as (red, green, blue).
COLORS = {"white": (255, 255, 255), "black": (0, 0, 0), "red": (255, 0, 0), "blue": (0, 0, 255), "green": (0, 255, 0), "yellow": (255, 255, 0), "orange": (255, 165, 0), "pink": (255, 192, 203), "purple": (128, 0, 128), "grey": (128, 128, 128), "gray": (128, 128, 128), "navy": (0, 0, 128), "maroon": (128, 0, 0), "brown": (165, 42, 42)}


def color(text: Column) -> Column:
    """A name, #rgb, #rrggbb or r,g,b as array (blue, green, red); null if it is none of these.  Numbers are not checked for range."""
    t = F.lower(F.trim(text))
    names = F.create_map(*(x for k, v in COLORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    part = lambda a, n, twice: F.conv(F.concat(F.substring(t, a, n), F.substring(t, a, n)) if twice else F.substring(t, a, n), 16, 10).cast("int")
    numbers = F.transform(F.split(t, ","), lambda p: F.trim(p).try_cast("int"))
    rgb = F.coalesce(F.try_element_at(names, t), F.when(t.rlike("^#[0-9a-f]{6}$"), F.array(part(2, 2, False), part(4, 2, False), part(6, 2, False))), F.when(t.rlike("^#[0-9a-f]{3}$"), F.array(part(2, 1, True), part(3, 1, True), part(4, 1, True))), F.when((F.size(numbers) == 3) & ~F.exists(numbers, lambda x: x.isNull()), numbers))
    return F.reverse(rgb)


def hsv(bgr: Column) -> Column:
    """Array (hue, saturation, value), each in [0, 1]."""
    b, g, r = (bgr[i] / 255.0 for i in range(3))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, (g - b) / d).when(top == g, 2.0 + (b - r) / d).otherwise(4.0 + (r - g) / d) / 6.0
    return F.array(h - F.floor(h), F.when(top == 0, 0.0).otherwise(d / top), top)


def color_distance(a: Column, b: Column) -> Column:
    """Distance in hue (around the circle, doubled), saturation and value."""
    x, y = hsv(a), hsv(b)
    h = F.abs(x[0] - y[0])
    return F.sqrt(F.pow(F.least(h, 1 - h) * 2, 2) + F.pow(x[1] - y[1], 2) + F.pow(x[2] - y[2], 2))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def histogram_similarity(a: Column, b: Column) -> Column:
    """1 - Bhattacharyya distance, at least 0; 0 if one is missing, empty or without weight.  Weights must not be negative."""
    shared = total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    norm = F.sqrt(total(a) * total(b))
    return F.coalesce(F.when(norm > 0, F.greatest(F.lit(0.0), 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - shared / norm)))), F.lit(0.0))


def folded_mean(histograms: Column) -> Column:
    """((h1 + h2) / 2 + h3) / 2 ... in the order of the array: later ones weigh more; null for none."""
    return F.when(F.size(histograms) > 0, F.aggregate(F.slice(histograms, 2, F.greatest(F.lit(1), F.size(histograms))), histograms[0], lambda s, h: F.zip_with(s, h, lambda x, y: (x + y) / 2)))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda z: F.greatest(F.lit(0.0), z["x2"] - z["x1"]) * F.greatest(F.lit(0.0), z["y2"] - z["y1"])
    return w * h / (area(a) + area(b) - w * h + 1e-6)


def box_ok(w: Column, h: Column) -> Column:
    return (w >= 20) & (h >= 40)


def rescaled(x: Column, scale: Column | float) -> Column:
    """A coordinate of a resized frame in the original, cut to a whole number."""
    return (x / scale).cast("int")


def player_score(ocr: Column, color_sure: Column, jersey: Column, hist: Column, center: Column, area: Column) -> Column:
    return F.when(ocr, 2.0).otherwise(0.0) + F.when(color_sure, 1.0).otherwise(0.0) + 0.8 * jersey + 0.6 * hist + 0.3 * center + 0.2 * area


def team_score(cx: Column, cy: Column, area: Column) -> Column:
    """Of box centers and area as shares of the frame: near the middle, in the lower part, large."""
    return 0.7 * (1 - F.abs(cx - 0.5)) + 0.6 * F.when(cy >= 0.45, 1.0).otherwise(0.25) + 0.4 * F.least(F.lit(1.0), area * 8)


def center_bias(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    dx, dy = (cx - width / 2) / F.greatest(F.lit(1.0), width), (cy - height / 2) / F.greatest(F.lit(1.0), height)
    return 1 - F.least(F.lit(1.0), F.sqrt(dx * dx + dy * dy))


def accepted(score: Column, team: Column, jersey_color: Column, any_hint: Column) -> Column:
    return team | ~any_hint | (score >= F.when(jersey_color, 0.45).otherwise(0.25))


def regions(x1: Column, y1: Column, x2: Column, y2: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Ordered array of structs (name, x1, y1, x2, y2) of the parts of a person's box, cut to its frame first if that is given."""
    if width is not None:
        x1, y1, x2, y2 = F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1), F.least(x2, width - 1), F.least(y2, height - 1)
    h, w = y2 - y1, x2 - x1
    t, m = F.floor(h * 0.15), F.floor(h * 0.6)
    rows = [("helmet", x1, y1, x2, y1 + F.greatest(F.lit(1), t)), ("torso", x1, y1 + t, x2, y1 + m), ("lower", x1, y1 + m, x2, y2), ("glove_left", x1, y1 + m, x1 + F.greatest(F.lit(1), F.floor(w / 3)), y2), ("glove_right", x1 + F.floor(w * 2 / 3), y1 + m, x2, y2)]
    return F.array(*(F.struct(F.lit(n).alias("name"), *(v.cast("int").alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), r))) for n, *r in rows))


#: Mean and deviation of the color channels of the images that common backbones learnt from.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalised(channels: Column, mean: tuple = MEAN, deviation: tuple = DEVIATION) -> Column:
    """(x / 255 - mean) / deviation of interleaved channel values 0 to 255."""
    n = len(mean)
    m, d = F.array(*map(F.lit, mean)), F.array(*map(F.lit, deviation))
    return F.transform(channels, lambda x, i: (x / 255.0 - F.get(m, i % n)) / F.get(d, i % n))


def has_pixels(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A region, cut to its frame, is not empty."""
    zero = F.lit(0)
    return (F.least(x2, width) > F.greatest(x1, zero)) & (F.least(y2, height) > F.greatest(y1, zero))
