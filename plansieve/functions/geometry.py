"""Boxes, points and lengths as column arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


EDGES = ("x0", "top", "x1", "bottom")


def edges(source: str | None = None) -> tuple[Column, ...]:
    """The four edges of a row, or of a struct or prefix (``"c."``)."""
    return tuple(F.col(f"{source or ''}{e}") for e in EDGES)


def box(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.struct(x0.alias("x0"), top.alias("top"), x1.alias("x1"), bottom.alias("bottom"))


def intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes meet; touching counts, and an unknown edge of ``a`` means no."""
    return F.coalesce((a[2] >= b[0]) & (a[0] <= b[2]) & (a[3] >= b[1]) & (a[1] <= b[3]), F.lit(False))


def same_box(a: tuple[Column, ...], b: tuple[Column, ...], tolerance: float = 1.0) -> Column:
    """Whether all edges agree to less than ``tolerance``."""
    near = [F.abs(x - y) < tolerance for x, y in zip(a, b, strict=True)]
    return near[0] & near[1] & near[2] & near[3]


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(low), F.least(lit(high), v))


def box_of_points(ax: Column, ay: Column, bx: Column, by: Column, width: Column | float, height: Column | float) -> Column:
    """The ordered box of two corners, kept on the page."""
    ax, bx, ay, by = clamp(ax, 0.0, width), clamp(bx, 0.0, width), clamp(ay, 0.0, height), clamp(by, 0.0, height)
    return box(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by))


def shift_box(b: tuple[Column, ...], dx: Column, dy: Column) -> Column:
    return box(b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy)


def shift_points(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def flip_points(points: Column, height: Column) -> Column:
    """From a bottom-left to a top-left origin."""
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), (height - p["y"]).alias("y")))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def sides(kind: Column, b: tuple[Column, ...], corners: Column) -> Column:
    """True side lengths (w, h) of the rectangle family; along the corners of a turned rectangle; null for others."""
    turned = (kind == "rect_curve") & F.coalesce(F.size(corners) == 4, F.lit(False))
    at = lambda i: F.try_element_at(corners, F.lit(i))
    w = F.when(turned, distance(at(1), at(2))).otherwise(b[2] - b[0])
    h = F.when(turned, distance(at(2), at(3))).otherwise(b[3] - b[1])
    return F.when(kind.isin("rect", "rect_curve", "rect_partial", "inferred_rect"), F.struct(w.alias("w"), h.alias("h")))


def aspect(w: Column, h: Column) -> Column:
    """The larger of w/h and h/w; null unless both are positive."""
    return F.when((w > 0) & (h > 0), F.greatest(F.try_divide(w, h), F.try_divide(h, w)))


def wall_pair(b: tuple[Column, ...], drawn: Column) -> Column:
    """The two long edges of a box (top and bottom for a square) and their distance."""
    x0, top, x1, bottom = b
    wide = (x1 - x0) >= (bottom - top)
    first = F.when(wide, box(x0, top, x1, top)).otherwise(box(x0, top, x0, bottom))
    second = F.when(wide, box(x0, bottom, x1, bottom)).otherwise(box(x1, top, x1, bottom))
    return F.struct(first.alias("a"), second.alias("b"), drawn.alias("distance_pts"))


def midpoint(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["top"] + b["bottom"]) / 2).alias("y"))


def inset(b: tuple[Column, ...], by: float) -> tuple[Column, ...]:
    return b[0] + by, b[1] + by, b[2] - by, b[3] - by


def round1(v: Column) -> Column:
    """To one decimal as the exact binary value rounds, ties to even.

    ``v * 10`` is itself rounded, so where it seems to be a tie the rounding error of
    the product (found exactly by splitting v) tells which side the value is on.
    """
    y = v * 10.0
    low = F.floor(y).cast("double")
    big = v * 134217729.0
    high = big - (big - v)
    rest = (high * 10.0 - y) + (v - high) * 10.0
    whole = F.when(y - low != 0.5, F.rint(y)).when(rest > 0, low + 1).when(rest < 0, low).otherwise(F.rint(y))
    return whole / 10.0


def zoom_factor(wheel: Column) -> Column:
    """The factor of a turn of the wheel."""
    return F.exp(-0.0015 * wheel)


def zoomed(view: Column, x: Column, y: Column, factor: Column, low: float = 0.1, high: float = 20.0) -> Column:
    """A view (scale, tx, ty) after a zoom by a factor that keeps the point (x, y) of the screen in place; the scale is kept in range."""
    scale = clamp(view["scale"] * factor, low, high)
    moved = lambda at, t: at - (at - t) * (scale / view["scale"])
    return F.struct(scale.alias("scale"), moved(x, view["tx"]).alias("tx"), moved(y, view["ty"]).alias("ty"))


def focused(b: tuple[Column, ...], css_per_pt: Column, width: Column, height: Column) -> Column:
    """The view (scale, tx, ty) that brings a box to the middle of a screen, two fifths of it at most."""
    x0, top, x1, bottom = (e * css_per_pt for e in b)
    fit = F.least(width * 0.4 / F.greatest(x1 - x0, F.lit(20.0)), height * 0.4 / F.greatest(bottom - top, F.lit(20.0)), F.lit(6.0))
    scale = clamp(fit, 1.5, 12.0)
    return F.struct(scale.alias("scale"), (width / 2 - (x0 + x1) / 2 * scale).alias("tx"), (height / 2 - (top + bottom) / 2 * scale).alias("ty"))
