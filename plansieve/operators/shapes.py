"""Shape classification of paths, as expressions over point arrays.

Everything is a column expression but the convex hull, which has no builtin form and
comes as one Arrow UDF.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import distance, let, round1
from ..schema import POINT


def _xs(p: Column) -> Column:
    return F.transform(p, lambda q: q["x"])


def _ys(p: Column) -> Column:
    return F.transform(p, lambda q: q["y"])


def _at(p: Column, i: int) -> Column:
    return F.try_element_at(p, F.lit(i))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rounded(points: Column) -> Column:
    """Points at one decimal, without those that lack a coordinate."""
    whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.transform(whole, lambda p: _point(round1(p["x"]), round1(p["y"])))


def without_repeats(p: Column) -> Column:
    """Points without those equal to the one before, and without a closing point."""

    def open_end(kept: Column) -> Column:
        n = F.size(kept)
        return F.when((n >= 2) & (_at(kept, 1) == _at(kept, -1)), F.slice(kept, 1, F.greatest(n - 1, F.lit(0)))).otherwise(kept)

    return let(p, lambda q: let(F.filter(q, lambda v, i: (i == 0) | (F.try_element_at(q, i) != v)), open_end))


def extent(p: Column) -> Column:
    """The box (x0, y0, x1, y1) around points."""
    return F.struct(F.array_min(_xs(p)).alias("x0"), F.array_min(_ys(p)).alias("y0"), F.array_max(_xs(p)).alias("x1"), F.array_max(_ys(p)).alias("y1"))


def box_corners(e: Column) -> Column:
    return let(e, lambda b: F.array(_point(b["x0"], b["y0"]), _point(b["x1"], b["y0"]), _point(b["x1"], b["y1"]), _point(b["x0"], b["y1"])))


def visits_corners(p: Column) -> Column:
    """Whether every corner of the extent is a point of the path."""
    return let(p, lambda q: F.size(F.array_except(box_corners(extent(q)), q)) == 0)


def _ring_edges(p: Column) -> Column:
    """The path's undirected edges, with the closing one, as ordered pairs."""
    follow = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    return F.zip_with(p, follow, lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def has_axis_rectangle(p: Column) -> Column:
    """Whether a rounded path draws the four sides of its extent, at least 3 each way."""
    straight = lambda z: (z["a"]["x"] == z["b"]["x"]) | (z["a"]["y"] == z["b"]["y"])

    def test(q: Column, e: Column) -> Column:
        sides = let(box_corners(e), lambda c: F.filter(_ring_edges(q), lambda z: (z["a"] != z["b"]) & straight(z) & F.array_contains(c, z["a"]) & F.array_contains(c, z["b"])))
        large = (e["x1"] - e["x0"] >= 3) & (e["y1"] - e["y0"] >= 3)
        return (F.size(q) >= 4) & large & visits_corners(q) & (F.size(F.array_distinct(sides)) >= 4)

    return F.coalesce(let(p, lambda q: let(extent(q), lambda e: test(q, e))), F.lit(False))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """From each vertex the next is the point that leaves all others on the left; of several in line, the farthest."""
    if len(points) < 3:
        return points
    ring = [points[0]]
    while True:
        ox, oy = ring[-1]
        best = None
        for x, y in points:
            if (x, y) == (ox, oy):
                continue
            if best is None:
                best = (x, y)
                continue
            turn = (best[0] - ox) * (y - oy) - (best[1] - oy) * (x - ox)
            if turn < 0 or turn == 0 and (x - ox) ** 2 + (y - oy) ** 2 > (best[0] - ox) ** 2 + (best[1] - oy) ** 2:
                best = (x, y)
        if best == ring[0] or len(ring) > len(points):
            break
        ring.append(best)
    return ring


@F.arrow_udf(T.ArrayType(POINT))
def convex_hull(paths: pa.Array) -> pa.Array:
    """Hull vertices, counter-clockwise from the lowest left point; points within a side are no vertices. Null stays null."""
    flat = paths.flatten()
    xs, ys = flat.field("x").to_pylist(), flat.field("y").to_pylist()
    rings: list[tuple[float, float]] = []
    ends, at = [0], 0
    for n in pc.fill_null(pc.list_value_length(paths), 0).to_pylist():
        rings += _hull(sorted(set(zip(xs[at : at + n], ys[at : at + n], strict=True))))
        ends.append(len(rings))
        at += n
    points = pa.StructArray.from_arrays([pa.array([r[i] for r in rings], pa.float64()) for i in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points, mask=paths.is_null())


convex_hull = convex_hull.asNondeterministic()  # keeps the optimizer from moving it into higher-order functions, where no UDF can run


def by_angle(p: Column) -> Column:
    """Four vertices in order of their angle about their centre."""
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / 4.0

    def turned(q: Column, c: Column) -> Column:
        return F.array_sort(F.transform(q, lambda v: F.struct(F.atan2(v["y"] - c["y"], v["x"] - c["x"]).alias("angle"), v["x"].alias("x"), v["y"].alias("y"))))

    ordered = let(p, lambda q: let(_point(mean(_xs(q)), mean(_ys(q))), lambda c: turned(q, c)))
    return F.transform(ordered, lambda v: _point(v["x"], v["y"]))


def is_turned_rectangle(p: Column) -> Column:
    """Whether four vertices are a rectangle at any angle: diagonals of about one length with about one middle."""

    def test(o: Column) -> Column:
        a, b, c, d = (_at(o, i) for i in (1, 2, 3, 4))
        cx = (a["x"] + b["x"] + c["x"] + d["x"]) / 4.0
        cy = (a["y"] + b["y"] + c["y"] + d["y"]) / 4.0
        middle = lambda u, v: (F.abs((u["x"] + v["x"]) / 2.0 - cx) <= 1.0) & (F.abs((u["y"] + v["y"]) / 2.0 - cy) <= 1.0)
        one, two = distance(a, c), distance(b, d)
        return (F.size(o) == 4) & middle(a, c) & middle(b, d) & (one >= 3) & (two >= 3) & (F.abs(one - two) <= F.greatest(F.lit(1.0), 0.02 * F.greatest(one, two)))

    return F.coalesce(let(by_angle(p), test), F.lit(False))


def rectangle_corners(p: Column, hull: Column, straight: Column | None = None) -> Column:
    """The four corners of the rectangle that a rounded path is, or null. The hull matters only where the path isn't a ``straight`` rectangle."""
    straight = has_axis_rectangle(p) if straight is None else straight
    return F.when(straight, box_corners(extent(p))).when((F.size(p) >= 4) & (F.size(hull) == 4) & is_turned_rectangle(hull), by_angle(hull))


def partial_box(p: Column) -> Column:
    """The extent of an open path of three straight sides with long, similar arms and a short cap; else null."""
    flat = lambda s: (s["y"] == 0) & (s["x"] != 0)
    upright = lambda s: (s["x"] == 0) & (s["y"] != 0)
    length = lambda s: F.abs(s["x"]) + F.abs(s["y"])

    def test(q: Column, steps: Column, e: Column) -> Column:
        a, b, c = (_at(steps, i) for i in (1, 2, 3))
        lies = flat(a) & flat(c) & upright(b)
        stands = upright(a) & upright(c) & flat(b)
        first, cap, last = length(a), length(b), length(c)
        fits = (F.least(first, last) >= 2 * cap) & (F.abs(first - last) <= 0.3 * F.greatest(first, last)) & (e["x1"] - e["x0"] >= 6) & (e["y1"] - e["y0"] >= 6)
        return F.when((F.size(q) == 4) & (lies | stands) & fits, e)

    def steps_of(q: Column) -> Column:
        rest = F.slice(q, 2, F.greatest(F.size(q) - 1, F.lit(0)))
        return F.zip_with(q, rest, lambda u, v: _point(v["x"] - u["x"], v["y"] - u["y"]))

    return F.when(F.size(p) >= 4, let(without_repeats(p), lambda q: let(steps_of(q), lambda s: let(extent(q), lambda e: test(q, s, e)))))


def facing_box(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    """The box of two partial shapes (x0, y0, x1, y1) that face each other with a gap between, or null."""
    level = (F.abs(a["y0"] - b["y0"]) <= tolerance) & (F.abs(a["y1"] - b["y1"]) <= tolerance)
    plumb = (F.abs(a["x0"] - b["x0"]) <= tolerance) & (F.abs(a["x1"] - b["x1"]) <= tolerance)
    apart_x = F.least(a["x1"], b["x1"]) <= F.greatest(a["x0"], b["x0"])
    apart_y = F.least(a["y1"], b["y1"]) <= F.greatest(a["y0"], b["y0"])
    joint = F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))
    return F.when(F.when(level, apart_x).otherwise(plumb & apart_y), joint)


