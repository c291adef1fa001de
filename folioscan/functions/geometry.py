"""Boxes (struct<x0,x1,y0,y1>, whole numbers), angles and colours as expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """A box of truncated coordinates, corners put in order."""
    x0, x1, y0, y1 = (c.cast("int") for c in (x0, x1, y0, y1))
    return F.struct(F.least(x0, x1).alias("x0"), F.greatest(x0, x1).alias("x1"), F.least(y0, y1).alias("y0"), F.greatest(y0, y1).alias("y1"))


def box_from_size(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, x + w, y, y + h)


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def intersect(a: Column, b: Column) -> Column:
    """The inclusive intersection; null if there is none."""
    x0, x1, y0, y1 = F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"]), F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])
    return F.when((x0 <= x1) & (y0 <= y1), F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")))


def hull(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def expand(b: Column, dx: float, dy: float) -> Column:
    """Margins added on all sides; an inverted range collapses around its middle."""
    def side(lo: Column, hi: Column, d: float) -> tuple[Column, Column]:
        mid, low, high = (lo + hi) / 2, lo - d, hi + d
        return F.when(low <= high, low).otherwise(mid - 0.5).cast("int"), F.when(low <= high, high).otherwise(mid + 0.5).cast("int")

    (x0, x1), (y0, y1) = side(b["x0"], b["x1"], dx), side(b["y0"], b["y1"], dy)
    return F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


def bounding_box(x: str, y: str) -> Column:
    """The smallest box of all points of a group."""
    return F.struct(F.min(x).cast("int").alias("x0"), F.max(x).cast("int").alias("x1"), F.min(y).cast("int").alias("y0"), F.max(y).cast("int").alias("y1"))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def turn(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The signed angle from p1-p0 to p1-p2, in (-pi, pi]."""
    a = F.atan2(y2 - y1, x2 - x1) - F.atan2(y0 - y1, x0 - x1)
    return F.when(a > F.pi(), a - 2 * F.pi()).when(a <= -F.pi(), a + 2 * F.pi()).otherwise(a)


def angle_between(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    cosine = (x0 * x1 + y0 * y1) / (F.hypot(x0, y0) * F.hypot(x1, y1))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def is_gray(r: Column, g: Column, b: Column, tolerance: int = 20) -> Column:
    return (F.abs(r - g) <= tolerance) & (F.abs(g - b) <= tolerance) & (F.abs(r - b) <= tolerance)


def is_white(r: Column, g: Column, b: Column, tolerance: int = 20) -> Column:
    return (r >= 255 - tolerance) & (g >= 255 - tolerance) & (b >= 255 - tolerance)


def is_black(r: Column, g: Column, b: Column, tolerance: int = 20) -> Column:
    return (r <= tolerance) & (g <= tolerance) & (b <= tolerance)


def hex2(i: Column) -> Column:
    return F.lower(F.lpad(F.hex(i), 2, "0"))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(*[(255 * (1 - F.least(F.lit(1.0), x + k))).cast("int").alias(n) for n, x in (("r", c), ("g", m), ("b", y))])


def floats(s: Column) -> Column:
    return F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("double"))


def is_rotated(matrix: Column) -> Column:
    return F.slice(matrix, 1, 4) != F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1)])


def with_range(b: Column, axis: str, low: Column, high: Column) -> Column:
    """A box with its x or y range set, to whole numbers in order."""
    if axis not in ("x", "y"):
        raise ValueError(f"no axis {axis}")
    low, high = low.cast("int"), high.cast("int")
    return b.withField(f"{axis}0", F.least(low, high)).withField(f"{axis}1", F.greatest(low, high))


def is_ordered(low: Column, high: Column) -> Column:
    """Whether two numbers are there and in order."""
    return F.coalesce(low <= high, F.lit(False))


def has_ranges(b: Column, x0: int, x1: int, y0: int, y1: int) -> Column:
    """Whether a box is there and just that one."""
    return F.coalesce((b["x0"] == x0) & (b["x1"] == x1) & (b["y0"] == y0) & (b["y1"] == y1), F.lit(False))
