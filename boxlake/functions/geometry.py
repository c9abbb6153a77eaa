"""Box geometry as Column expressions. A box is struct<x1,y1,x2,y2: double>; nothing here leaves code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")
#: Pixels by which a manifest box may pass the image's edge.
TOLERANCE = 1e-6
#: The box of an explicit fallback: the middle half of the image, both ways.
CENTER = (0.25, 0.25, 0.75, 0.75)
ACCURATE = 0.5


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), CORNERS, strict=True)))


def from_array(values: Column) -> Column:
    """A box of an array of numbers or numeric strings; null unless it has four, null members where one isn't numeric.

    true and false, as JSON has them, count as 1 and 0.
    """
    number = lambda v: F.coalesce(v.try_cast("double"), F.when(v.cast("string") == "true", 1.0).when(v.cast("string") == "false", 0.0))
    return F.when(F.size(values) == 4, box(*(number(F.get(values, i)) for i in range(4))))


def to_array(b: Column) -> Column:
    return F.array(*(b[c] for c in CORNERS))


def center_box() -> Column:
    return box(*map(F.lit, CENTER))


def finite(*values: Column) -> Column:
    """Whether all are numbers other than NaN and the infinities; never null."""
    one = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))
    return reduce(lambda a, b: a & b, map(one, values))


def all_finite(b: Column) -> Column:
    return finite(*(b[c] for c in CORNERS))


def ordered(b: Column) -> Column:
    return (b["x1"] < b["x2"]) & (b["y1"] < b["y2"])


def normalized_error(b: Column) -> Column:
    """Why a normalised box is refused, null if it is fine: coordinates finite, in [0, 1], and in strict order."""
    inside = reduce(lambda a, c: a & c, [b[c].between(0.0, 1.0) for c in CORNERS])
    return F.when(~all_finite(b), "not_finite").when(~inside, "out_of_range").when(~ordered(b), "no_area")


def scaled(b: Column, width: Column, height: Column) -> Column:
    return box(b["x1"] * width, b["y1"] * height, b["x2"] * width, b["y2"] * height)


def normalized_to_pixel(b: Column, width: Column, height: Column) -> Column:
    """Pixel box, null where the box is refused or the image has no area."""
    w, h = width.cast("double"), height.cast("double")
    return F.when(normalized_error(b).isNull() & (w > 0) & (h > 0), scaled(b, w, h))


def pixel_to_normalized(b: Column, width: Column, height: Column) -> Column:
    """Normalised box, null where the image has no area or the result is refused."""
    w, h = width.cast("double"), height.cast("double")
    out = box(F.try_divide(b["x1"], w), F.try_divide(b["y1"], h), F.try_divide(b["x2"], w), F.try_divide(b["y2"], h))
    return F.when((w > 0) & (h > 0) & normalized_error(out).isNull(), out)


def clamped(b: Column, width: Column, height: Column) -> Column:
    """b cut to the image. NaN and +inf go to the far edge, -inf to 0."""
    w, h, zero = width.cast("double"), height.cast("double"), F.lit(0.0)
    cut = lambda v, most: F.greatest(zero, F.least(most, v))
    return box(cut(b["x1"], w), cut(b["y1"], h), cut(b["x2"], w), cut(b["y2"], h))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; null unless both boxes are finite and have an area."""
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = wide * high
    return F.when(all_finite(a) & all_finite(b) & ordered(a) & ordered(b), F.try_divide(both, area(a) + area(b) - both))


def accurate(predicted: Column, truth: Column) -> Column:
    return iou(predicted, truth) >= F.lit(ACCURATE)


def xywh_valid(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Manifest rule: finite, not left of or above the image, some size, and at most TOLERANCE pixels beyond it."""
    return F.coalesce(finite(x, y, w, h) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width.cast("double") + F.lit(TOLERANCE)) & (y + h <= height.cast("double") + F.lit(TOLERANCE)) & (width > 0) & (height > 0), F.lit(False))


def xywh_normalized(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    wide, high = width.cast("double"), height.cast("double")
    return box(F.try_divide(x, wide), F.try_divide(y, high), F.try_divide(x + w, wide), F.try_divide(y + h, high))


def union_xywh(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Aggregates: x, y, w, h of the least box around all of a group. Even of one box, w goes through x + w."""
    x1, y1 = F.min(x), F.min(y)
    return [x1.alias("x"), y1.alias("y"), (F.max(x + w) - x1).alias("w"), (F.max(y + h) - y1).alias("h")]
