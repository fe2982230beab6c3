"""Raw drawing objects to elements, and element-wise projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.color import first_set, hex_color
from . import shapes

EDGES = G.EDGES


def numbered(objects: DataFrame, keys: Sequence[str], kind: str = "type") -> DataFrame:
    """Adds ids: type, # and the place among those of the type on the page, from 1."""
    place = F.row_number().over(Window.partitionBy(*keys, kind).orderBy("ord"))
    return objects.withColumn("id", F.concat(F.col(kind), F.lit("#"), F.when(F.col(kind) == "char", F.format_string("%05d", place)).otherwise(F.format_string("%04d", place))))


def classify_curves(curves: DataFrame, points: str = "pts") -> DataFrame:
    """Adds the type of each path (rect_curve, rect_partial or curve), its corners and its partial box.

    The hull is computed in Arrow batches, and only of paths that fail the straight test.
    Its argument is a column of its own: one with higher-order functions would keep Spark
    from extracting the UDF.
    """
    path = F.coalesce(F.col(points), F.array().cast("array<struct<x:double,y:double>>"))
    tested = curves.withColumn("path", shapes.rounded(path)).withColumn("straight", shapes.has_axis_rectangle(F.col("path")))
    with_hull = tested.withColumn("bent", F.when(~F.col("straight") & (F.size("path") >= 4), F.col("path"))).withColumn("hull", shapes.convex_hull(F.col("bent")))
    typed = with_hull.withColumn("corners", shapes.rectangle_corners(F.col("path"), F.col("hull"), F.col("straight"))).withColumn("part", shapes.partial_box(F.col("path")))
    kind = F.when(F.col("corners").isNotNull(), "rect_curve").when(F.col("part").isNotNull(), "rect_partial").otherwise("curve")
    return typed.withColumn("type", kind).drop("path", "straight", "bent", "hull")


def page_elements(objects: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The elements of all pages, in the order lines, rectangles, curves, chars, words; ids are given before any crop."""
    keys = list(keys)
    curves = classify_curves(objects.where("kind = 'curve'").join(pages.select(*keys, "height"), keys))
    flip = lambda c: G.flip_points(F.col(c), F.col("height"))
    is_part = F.col("type") == "rect_partial"
    part = F.col("part")
    box = {"x0": part["x0"], "top": F.col("height") - part["y1"], "x1": part["x1"], "bottom": F.col("height") - part["y0"]}
    colored = F.col("type") != "curve"
    null = lambda kind: F.lit(None).cast(kind)
    points = "array<struct<x:double,y:double>>"
    curve_rows = curves.select(
        *keys,
        "ord",
        "type",
        *[F.when(is_part, box[e]).otherwise(F.col(e)).alias(e) for e in EDGES],
        null("double").alias("linewidth"),
        F.when(colored, hex_color(first_set(F.col("stroking_color"), F.col("stroke_color")))).alias("stroke"),
        F.when(colored & F.coalesce("filled", F.lit(False)), hex_color(F.col("non_stroking_color"))).alias("fill"),
        flip("pts").alias("points"),
        flip("corners").alias("corners"),
        null("string").alias("text"),
        null("string").alias("fontname"),
        null("double").alias("size"),
    )
    kind = F.col("kind")
    stroke = F.when(kind == "line", hex_color(first_set(F.col("stroke_color"), F.col("non_stroking_color")))).when(kind == "rect", hex_color(F.col("stroke_color")))
    others = objects.where("kind <> 'curve'").select(
        *keys,
        "ord",
        kind.alias("type"),
        *EDGES,
        F.when(kind == "line", F.col("linewidth")).alias("linewidth"),
        stroke.alias("stroke"),
        F.when(kind.isin("rect", "char"), hex_color(F.col("non_stroking_color"))).alias("fill"),
        null(points).alias("points"),
        null(points).alias("corners"),
        F.when(kind.isin("char", "word"), F.coalesce("text", F.lit(""))).alias("text"),
        F.when(kind == "char", F.col("fontname")).alias("fontname"),
        F.when(kind == "char", F.col("size")).alias("size"),
    )
    rank = F.when(F.col("type") == "line", 0).when(F.col("type") == "rect", 1).when(F.col("type") == "char", 3).when(F.col("type") == "word", 4).otherwise(2)
    return numbered(others.unionByName(curve_rows), keys).withColumn("kind_rank", rank)


def crop_elements(elements: DataFrame, crops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The elements of cropped pages that touch their page's crop."""
    c = crops.select(*keys, *[F.col(e).alias(f"c_{e}") for e in EDGES])
    return elements.join(c, list(keys)).where(G.intersects(G.edges(), G.edges("c_"))).drop(*[f"c_{e}" for e in EDGES])


def pages_with_crops(pages: DataFrame, crops: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pages.join(crops, list(keys), "left_semi")


def wall_midpoints(pair: Column) -> Column:
    """The middles of both walls and of the line between them."""
    a, b = G.midpoint(pair["a"]), G.midpoint(pair["b"])
    return F.struct(a.alias("a"), b.alias("b"), F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")).alias("label"))


def nested(elements: DataFrame, pages: DataFrame, keys: Sequence[str] = ("doc", "page")) -> DataFrame:
    """A row per document: its pages in order, each with its elements in order, and the page count."""
    doc, page = keys
    item = F.struct("kind_rank", "ord", "id", "type", *EDGES, "stroke", "fill", "text")
    lists = elements.groupBy(doc, page).agg(F.sort_array(F.collect_list(item)).alias("elements"))
    whole = pages.join(lists, [doc, page], "left").withColumn("elements", F.coalesce("elements", F.array()))
    return whole.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("page_number"), "width", "height", "elements"))).alias("pages"), F.count("*").alias("page_count"))
