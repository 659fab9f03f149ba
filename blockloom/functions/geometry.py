"""Rectangles as Column arithmetic. A rectangle is four columns x0, y0, x1, y1 under a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + n) for n in ("x0", "y0", "x1", "y1"))


def area(r) -> Column:
    return (r[2] - r[0]) * (r[3] - r[1])


def overlap_size(a, b) -> tuple[Column, Column]:
    """Width and height of the shared part, 0 where there is none."""
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])), F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def covered_ratio(rect, cover) -> Column:
    """Share of rect's area under cover (not symmetric)."""
    w, h = overlap_size(rect, cover)
    return w * h / F.greatest(F.lit(1e-6), area(rect))


def overlaps(a, b, least: float = 0.5) -> Column:
    w, h = overlap_size(a, b)
    return (w > least) & (h > least)


def centre(r) -> tuple[Column, Column]:
    return (r[0] + r[2]) / 2, (r[1] + r[3]) / 2


def centre_in(r, cover) -> Column:
    x, y = centre(r)
    return x.between(cover[0], cover[2]) & y.between(cover[1], cover[3])


def gap_distance(r, point_box) -> Column:
    """L1 distance between two rectangles, 0 where they meet."""
    dx = F.greatest(F.lit(0.0), r[0] - point_box[2], point_box[0] - r[2])
    dy = F.greatest(F.lit(0.0), r[1] - point_box[3], point_box[1] - r[3])
    return dx + dy


def band_distance(block, band) -> Column:
    """Vertical gap between a band and a block, 0 where they overlap."""
    return F.greatest(F.lit(0.0), block[1] - band[3], band[1] - block[3])


def rotated(r, rotation: Column, width: Column, height: Column) -> Column:
    """A rectangle in the frame of a page shown rotated by 0, 90, 180 or 270 degrees; width and height
    are those of the page as it is shown."""
    x0, y0, x1, y1 = r
    make = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    return (
        F.when(rotation == 90, make(width - y1, x0, width - y0, x1))
        .when(rotation == 180, make(width - x1, height - y1, width - x0, height - y0))
        .when(rotation == 270, make(y0, height - x1, y1, height - x0))
        .otherwise(make(x0, y0, x1, y1))
    )


def folded_angle(degrees: Column) -> Column:
    """Into [-45, 45): lines wrap at right angles."""
    return F.pmod(degrees + 45.0, F.lit(90.0)) - 45.0


def upper_median(values: Column) -> Column:
    """The element at n/2 of the sorted array: of an even number the upper one of the middle two."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def glyph_band(x0: Column, x1: Column, origin_y: Column, size: Column, ascender: Column, descender: Column) -> Column:
    """What is visible of a span: its origin plus ascender and descender, not the whole line box."""
    up = F.when(F.coalesce(ascender, F.lit(0.0)) == 0, 0.75).otherwise(ascender)
    down = F.when(F.coalesce(descender, F.lit(0.0)) == 0, -0.25).otherwise(descender)
    return F.struct(x0.alias("x0"), (origin_y - size * F.greatest(F.lit(0.0), up)).alias("y0"), x1.alias("x1"), (origin_y - size * F.least(F.lit(0.0), down)).alias("y1"))
