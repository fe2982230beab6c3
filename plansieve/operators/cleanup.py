"""Which elements are shown, their counts, colours and real sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.color import element_color, is_ink
from ..schema import TYPES, USUAL, VISIBLE, Thresholds


def _sides() -> Column:
    return G.sides(F.col("type"), G.edges(), F.col("corners"))


def passes_ink(max_luma: float = USUAL.max_luma) -> Column:
    return is_ink(element_color(F.col("type"), F.col("stroke"), F.col("fill")), max_luma)


def _rectangles_only(test: Column) -> Column:
    """A test that only whole rectangles have to pass."""
    return ~F.col("type").isin("rect", "rect_curve") | F.coalesce(test, F.lit(False))


def passes_aspect(ratio: float = USUAL.rect_aspect) -> Column:
    s = _sides()
    return _rectangles_only(G.aspect(s["w"], s["h"]) >= ratio)


def passes_min_side(scale: Column, inches: float = USUAL.min_side_inches) -> Column:
    s = _sides()
    return _rectangles_only((s["w"] >= inches * scale) & (s["h"] >= inches * scale))


def passes_max_area(scale: Column, sq_inches: float = USUAL.max_area_sq_inches) -> Column:
    s = _sides()
    return _rectangles_only(F.try_divide(s["w"], scale) * F.try_divide(s["h"], scale) <= sq_inches)


def passes_size(scale: Column, t: Thresholds = USUAL) -> Column:
    """The size tests, where the scale is known."""
    return scale.isNull() | (passes_min_side(scale, t.min_side_inches) & passes_max_area(scale, t.max_area_sq_inches))


def passes_search(query: str) -> Column:
    """Whether the id, or a char's or word's text, holds the query; an empty query is no test."""
    q = query.strip().lower()
    text = F.col("type").isin("char", "word") & F.coalesce(F.lower("text").contains(q), F.lit(False))
    return F.lower("id").contains(q) | text if q else F.lit(True)


def with_scale(elements: DataFrame, scales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elements with their page's scale, null where none was found."""
    return elements.join(scales.select(*keys, "scale"), list(keys), "left")


def visible(elements: DataFrame, types: Sequence[str] = VISIBLE, query: str = "", t: Thresholds = USUAL) -> DataFrame:
    """The display's filter chain over elements with a ``scale`` column."""
    return elements.where(F.col("type").isin(*types) & passes_ink(t.max_luma) & passes_aspect(t.rect_aspect) & passes_size(F.col("scale"), t) & passes_search(query))


def type_counts(elements: DataFrame, t: Thresholds = USUAL) -> DataFrame:
    """Elements of each type after the ink, aspect and size tests, 0 for types without any."""
    kept = elements.where(passes_ink(t.max_luma) & passes_aspect(t.rect_aspect) & passes_size(F.col("scale"), t))
    every = elements.sparkSession.createDataFrame([(x,) for x in TYPES], "type string")
    return every.join(kept.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def color_summary(elements: DataFrame) -> DataFrame:
    """Elements of each colour, in all and by type (a map), most frequent first."""
    color = F.lower(element_color(F.col("type"), F.col("stroke"), F.col("fill")))
    by_type = elements.withColumn("color", color).where("color is not null and color <> ''").groupBy("color", "type").agg(F.count("*").alias("n"))
    return by_type.groupBy("color").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type")).orderBy(F.desc("n"), "color")


def measurable(elements: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shown rectangles whose centre lies on their page."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    family = elements.where(F.col("type").isin("rect", "rect_curve", "rect_partial", "inferred_rect"))
    return family.join(pages.select(*keys, "width", "height"), list(keys)).where(cx.between(0, F.col("width")) & cy.between(0, F.col("height")))


def real_sizes(elements: DataFrame) -> DataFrame:
    """Side lengths in inches, from the page's scale."""
    s = _sides()
    return elements.withColumn("w_in", F.try_divide(s["w"], F.col("scale"))).withColumn("h_in", F.try_divide(s["h"], F.col("scale")))
