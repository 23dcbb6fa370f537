"""Boxes as column expressions: struct<x,y,w,h:double> in pixels unless said otherwise.

Nulls are guarded wherever greatest and least would skip them; NaN is nulled when
records are read (sources.canonical) and never reaches these expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    """A box of four columns; null if any is."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (x, y, w, h)]
    all_there = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    return F.when(all_there, F.struct(*[p.cast("double").alias(n) for p, n in zip(parts, "xywh", strict=True)]))


def is_valid(b: Column) -> Column:
    """Whether a box is there, finite and not empty."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(finite(b["x"]) & finite(b["y"]) & finite(b["w"]) & finite(b["h"]) & (b["w"] > 0) & (b["h"] > 0), F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; null if either box is."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(a.isNotNull() & b.isNotNull(), F.when(union > 0, w * h / union).otherwise(F.lit(0.0)))


def _apart(a: Column, b: Column, axis: str, size: str) -> Column:
    """Distance of the centres on one axis; a centre lies half of size - 1 from the edge."""
    return (a[axis] + (a[size] - 1.0) / 2.0) - (b[axis] + (b[size] - 1.0) / 2.0)


def center_error(gt: Column, pred: Column) -> Column:
    dx, dy = _apart(gt, pred, "x", "w"), _apart(gt, pred, "y", "h")
    return F.sqrt(dx * dx + dy * dy)


def normalised_center_error(gt: Column, pred: Column) -> Column:
    """The distance of the centres, each axis by the ground truth's size."""
    dx, dy = _apart(gt, pred, "x", "w") / gt["w"], _apart(gt, pred, "y", "h") / gt["h"]
    return F.when((gt["w"] > 0) & (gt["h"] > 0), F.sqrt(dx * dx + dy * dy))


def to_corners(b: Column) -> Column:
    """xywh to struct<x1,y1,x2,y2>."""
    return F.when(b.isNotNull(), F.struct(b["x"].alias("x1"), b["y"].alias("y1"), (b["x"] + b["w"]).alias("x2"), (b["y"] + b["h"]).alias("y2")))


def from_corners(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c["x1"].alias("x"), c["y1"].alias("y"), (c["x2"] - c["x1"]).alias("w"), (c["y2"] - c["y1"]).alias("h")))


def clipped(b: Column, width: Column, height: Column) -> Column:
    """The part of a box inside an image; null if nothing is."""
    x1, y1 = F.least(F.greatest(b["x"], F.lit(0.0)), width), F.least(F.greatest(b["y"], F.lit(0.0)), height)
    x2, y2 = F.least(F.greatest(b["x"] + b["w"], F.lit(0.0)), width), F.least(F.greatest(b["y"] + b["h"], F.lit(0.0)), height)
    return F.when(b.isNotNull() & (x2 > x1) & (y2 > y1), F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")))


def to_norm1000(b: Column, width: Column, height: Column) -> Column:
    """xywh to corners in thousandths of the image, at two decimals, half to even."""
    c = to_corners(b)
    part = lambda v, size: F.bround(v / size * 1000.0, 2)
    made = F.struct(part(c["x1"], width).alias("x1"), part(c["y1"], height).alias("y1"), part(c["x2"], width).alias("x2"), part(c["y2"], height).alias("y2"))
    return F.when(b.isNotNull() & (width > 0) & (height > 0), made)


def from_norm1000(c: Column, width: Column, height: Column) -> Column:
    """Corners in thousandths to xywh in pixels; null without a size or with an empty box."""
    x1, y1, x2, y2 = c["x1"] * width / 1000.0, c["y1"] * height / 1000.0, c["x2"] * width / 1000.0, c["y2"] * height / 1000.0
    made = F.struct(F.bround(x1, 2).alias("x"), F.bround(y1, 2).alias("y"), F.bround(x2 - x1, 2).alias("w"), F.bround(y2 - y1, 2).alias("h"))
    return F.when(c.isNotNull() & (width > 0) & (height > 0) & (x2 > x1) & (y2 > y1), made)


def rescaled(c: Column, from_width: Column, from_height: Column, width: Column, height: Column) -> Column:
    """Corners in one image's pixels to those of a resized one, clipped to it."""
    sx, sy = width / from_width, height / from_height
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    return F.when(
        c.isNotNull(),
        F.struct(inside(c["x1"] * sx, width).alias("x1"), inside(c["y1"] * sy, height).alias("y1"), inside(c["x2"] * sx, width).alias("x2"), inside(c["y2"] * sy, height).alias("y2")),
    )


def long_side_size(width: Column, height: Column, longest: int) -> Column:
    """struct<width,height:int> of an image whose longer side is at most longest."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(1), F.bround(v * scale, 0).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def iou_of(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes (x, y, w, h) in plain Python, for folds; 0 if they don't meet."""
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    whole = a[2] * a[3] + b[2] * b[3] - both
    return both / whole if whole > 0 else 0.0
