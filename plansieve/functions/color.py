"""Colours: component arrays, hex strings, luminance and ink tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_set(a: Column, b: Column) -> Column:
    """``a`` unless it is null or empty, else ``b``."""
    return F.when(F.size(a) > 0, a).otherwise(b)


def hex_color(c: Column) -> Column:
    """#rrggbb of 1, 3 or 4 components in [0, 1]; anything else is null."""
    n = F.size(c)
    usable = F.forall(c, lambda v: v.isNotNull() & (v >= 0) & (v <= 1))
    rgb = F.when(n == 1, F.array(c[0], c[0], c[0])).when(n == 3, c).when(n == 4, F.transform(F.slice(c, 1, 3), lambda v: (1 - v) * (1 - F.try_element_at(c, F.lit(4)))))
    level = F.transform(rgb, lambda v: F.lpad(F.lower(F.hex(F.rint(v * 255).cast("long"))), 2, "0"))
    return F.when(usable & n.isin(1, 3, 4), F.concat(F.lit("#"), F.array_join(level, "")))


def is_black(c: Column, max_luma: float) -> Column:
    """Whether components are black ink; null is the default ink, which is black."""
    n = F.size(c)
    return (
        F.when(c.isNull(), True)
        .when(F.exists(c, lambda v: v.isNull()), False)
        .when(n.isin(1, 3), F.array_max(c) <= max_luma)
        .when(n == 4, (F.try_element_at(c, F.lit(4)) >= 1 - max_luma) & (F.array_max(F.slice(c, 1, 3)) <= max_luma))
        .otherwise(False)
    )


def _channel(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, at, 2), 16, 10).cast("double") / 255


def hex_luma(c: Column) -> Column:
    """The largest channel of #rrggbb in [0, 1]; 1 for anything else, null for null."""
    h = F.regexp_extract(c, "(?i)^#?([0-9a-f]{6})$", 1)
    safe = F.when(h == "", "ffffff").otherwise(h)
    return F.when(c.isNull(), None).otherwise(F.greatest(*[_channel(safe, i) for i in (1, 3, 5)]))


def is_ink(c: Column, max_luma: float) -> Column:
    """The display's test: an unknown colour stays, a known one if it is dark enough.

    Two hex digits are in order as text, so no channel has to be parsed.
    """
    last = max((b for b in range(256) if b / 255 <= max_luma), default=-1)
    h = F.lower(F.ltrim(c, F.lit("#")))
    known = F.regexp_like(c, F.lit("^#?[0-9a-fA-F]{6}$"))
    dark = F.lit(False) if last < 0 else (F.substring(h, 1, 2) <= f"{last:02x}") & (F.substring(h, 3, 2) <= f"{last:02x}") & (F.substring(h, 5, 2) <= f"{last:02x}")
    return c.isNull() | (known & dark) | (~known & F.lit(max_luma >= 1))


def svg_luma(s: Column) -> Column:
    """The largest channel of an SVG colour; null where none is stated or understood."""
    v = F.lower(F.trim(s))
    six = F.when(F.regexp_like(v, F.lit("^#[0-9a-f]{6}$")), F.substring(v, 2, 6)).when(F.regexp_like(v, F.lit("^#[0-9a-f]{3}$")), F.regexp_replace(F.substring(v, 2, 3), "(.)", "$1$1"))
    inside = F.when(v.startswith("rgb(") & v.contains(")"), F.split(F.substring_index(F.substr(v, F.lit(5)), ")", 1), ","))
    parts = F.transform(inside, lambda x: F.trim(x, F.lit(" \t\r\n\f")))
    digits = (F.size(parts) == 3) & F.forall(parts, lambda x: F.length(x).between(1, 18) & (F.translate(x, "0123456789", "") == ""))
    level = F.array_max(F.transform(parts, lambda x: x.try_cast("double"))) / 255
    return F.when(v == "black", 0.0).when(v == "white", 1.0).when(six.isNotNull(), F.greatest(*[_channel(six, i) for i in (1, 3, 5)])).when(digits, level)


def svg_is_black(s: Column, max_luma: float) -> Column:
    """Whether a paint is black; what isn't stated counts as black."""
    return F.coalesce(svg_luma(s) <= max_luma, F.lit(True))


def element_color(kind: Column, stroke: Column, fill: Column) -> Column:
    """The colour that stands for an element of a type."""
    return F.when(kind == "line", stroke).when(kind.isin("rect", "rect_curve", "rect_partial"), F.coalesce(stroke, fill)).when(kind == "char", fill)


def raster_black(level: Column, max_luma: float) -> Column:
    """The raster form of the ink test on a grey level of 0 to 255 (strict, against a rounded limit)."""
    return level < round(max_luma * 255)
