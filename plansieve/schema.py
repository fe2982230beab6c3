"""Relations and thresholds of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "top", "x1", "bottom")])
TOKEN = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("conf", "left", "top", "width", "height")]])

_KEY = [T.StructField("doc", T.StringType()), T.StructField("page", T.LongType())]
_BOX = list(BBOX.fields)

#: What a decoder yields: one row per drawing object of a page.
RAW_OBJECTS = T.StructType(
    [
        *_KEY,
        T.StructField("kind", T.StringType()),
        T.StructField("ord", T.LongType()),
        *_BOX,
        T.StructField("linewidth", T.DoubleType()),
        *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("stroke_color", "stroking_color", "non_stroking_color")],
        T.StructField("filled", T.BooleanType()),
        T.StructField("pts", T.ArrayType(POINT)),
        T.StructField("text", T.StringType()),
        T.StructField("fontname", T.StringType()),
        T.StructField("size", T.DoubleType()),
    ]
)

#: One row per element of a page, whatever its type.
ELEMENTS = T.StructType(
    [
        *_KEY,
        T.StructField("ord", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        *_BOX,
        T.StructField("linewidth", T.DoubleType()),
        T.StructField("stroke", T.StringType()),
        T.StructField("fill", T.StringType()),
        T.StructField("points", T.ArrayType(POINT)),
        T.StructField("corners", T.ArrayType(POINT)),
        T.StructField("text", T.StringType()),
        T.StructField("fontname", T.StringType()),
        T.StructField("size", T.DoubleType()),
    ]
)

PAGES = T.StructType([*_KEY, T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())])
CROPS = T.StructType([*_KEY, *_BOX])
OCR_TOKENS = T.StructType([*_KEY, T.StructField("ord", T.LongType()), T.StructField("tokens", T.ArrayType(TOKEN))])

# Element types in display order, those shown at first, and the rectangle family.
TYPES = ("line", "rect", "curve", "rect_curve", "rect_partial", "inferred_rect", "char", "word")
VISIBLE = ("rect", "rect_curve", "rect_partial")
RECTS = ("rect", "rect_curve", "rect_partial", "inferred_rect")


@dataclass(frozen=True)
class Thresholds:
    """The limits that decide what is a label, a duct or ink, with their usual values."""

    max_upload: int = 25 * 1024 * 1024
    max_luma: float = 0.02
    min_confidence: int = 20
    min_diameter: float = 2.0
    max_diameter: float = 80.0
    label_width: tuple[float, float] = (15.0, 80.0)
    label_height: tuple[float, float] = (8.0, 22.0)
    label_aspect: float = 1.4
    label_inset: float = 1.0
    label_dpi: int = 1200
    dedupe_tolerance: float = 2.0
    scale_band: float = 0.10
    search_radius: float = 120.0
    min_scale: float = 0.3
    max_scale: float = 5.0
    rect_aspect: float = 1.2
    min_side_inches: float = 3.0
    max_area_sq_inches: float = 8000.0


USUAL = Thresholds()
