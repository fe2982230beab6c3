"""From rectangles and labels to the drawing scale of each page.

A page is the columns ``keys``. ``ord`` is a row's place on its page and breaks ties.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.color import first_set, is_black
from ..schema import USUAL, Thresholds
from .extract import classify_curves

EDGES = G.EDGES


def black_objects(objects: DataFrame, max_luma: float, crop: tuple[Column, ...] | None = None) -> DataFrame:
    """Black lines and rectangles with known edges and (if a crop is given) some part inside it.

    Lines count by their stroke alone; rectangles, and paths that are rectangles, by stroke
    or fill; nothing else counts. Adds ``shape`` (line or rect).
    """
    stroke = is_black(first_set(F.col("stroking_color"), F.col("stroke_color")), max_luma)
    either = stroke | is_black(F.col("non_stroking_color"), max_luma)
    known = F.col("x0").isNotNull() & F.col("top").isNotNull() & F.col("x1").isNotNull() & F.col("bottom").isNotNull()
    inside = known if crop is None else known & G.intersects(G.edges(), crop)
    kind = F.col("kind")
    shape = F.when(kind == "line", "line").otherwise("rect").alias("shape")
    plain = objects.where(inside & F.when(kind == "line", stroke).when(kind == "rect", either)).select("*", shape)
    paths = objects.where(inside & (kind == "curve") & either)
    return plain.unionByName(classify_curves(paths).where("type = 'rect_curve'").select(*objects.columns, shape))


def label_sized(t: Thresholds = USUAL) -> Column:
    """Whether a box has the size and shape of a label."""
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    return w.between(*t.label_width) & h.between(*t.label_height) & (G.aspect(w, h) >= t.label_aspect)


def _centres(cx: Column | None, cy: Column | None) -> tuple[Column, Column]:
    return (F.col("x0") + F.col("x1")) * 0.5 if cx is None else cx, (F.col("top") + F.col("bottom")) * 0.5 if cy is None else cy


def near_boxes(boxes: DataFrame, keys: Sequence[str], tolerance: float = USUAL.dedupe_tolerance, cx: Column | None = None, cy: Column | None = None) -> DataFrame:
    """Pairs of boxes of a page (ord < other) whose centres are near each other, met in the cells of a grid."""
    cx, cy = _centres(cx, cy)
    cell = lambda c: F.floor(F.col(c) / tolerance)
    a = boxes.select(*keys, F.col("ord").cast("long").alias("ord"), cx.alias("ax"), cy.alias("ay")).withColumns({"cell_x": cell("ax"), "cell_y": cell("ay")})
    b = a.toDF(*keys, "other", "bx", "by", "cell_x", "cell_y")
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    b = b.withColumn("cell_x", around("cell_x")).withColumn("cell_y", around("cell_y"))
    near = (F.abs(F.col("ax") - F.col("bx")) < tolerance) & (F.abs(F.col("ay") - F.col("by")) < tolerance)
    return a.join(b, [*keys, "cell_x", "cell_y"]).where((F.col("ord") < F.col("other")) & near).select(*keys, "ord", "other")


def dedupe_boxes(boxes: DataFrame, keys: Sequence[str], tolerance: float = USUAL.dedupe_tolerance, cx: Column | None = None, cy: Column | None = None) -> DataFrame:
    """Keeps, in order of ``ord``, each box whose centre isn't near that of a box already kept on its page.

    The order decides, so a page's boxes are taken one after the other; pages are
    independent, only keys, ordinals and centres are gathered, and the kept ones stand in
    a grid, so a page takes time in proportion to its boxes.
    """
    cx, cy = _centres(cx, cy)
    placed = boxes.select(*keys, F.col("ord").cast("long").alias("ord"), cx.alias("cx"), cy.alias("cy"))
    kinds = dict(placed.dtypes)

    def thin(page: pa.Table) -> pa.Table:
        page = page.sort_by("ord")
        grid: dict[tuple[int, int], list[tuple[float, float]]] = {}
        stays = []
        for x, y in zip(page.column("cx").to_pylist(), page.column("cy").to_pylist(), strict=True):
            if x is None or y is None or not math.isfinite(x) or not math.isfinite(y):
                stays.append(True)  # near nothing
                continue
            i, j = math.floor(x / tolerance), math.floor(y / tolerance)
            taken = any(abs(x - u) < tolerance and abs(y - v) < tolerance for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for u, v in grid.get((a, b), ()))
            stays.append(not taken)
            if not taken:
                grid.setdefault((i, j), []).append((x, y))
        return page.filter(pa.array(stays, pa.bool_())).select([*keys, "ord"])

    kept = placed.groupBy(*keys).applyInArrow(thin, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "ord")))
    return boxes.join(kept, [*keys, "ord"], "left_semi")


def inset_boxes(boxes: DataFrame, by: float = USUAL.label_inset) -> DataFrame:
    """The insides of boxes, for reading them without their border; boxes without an inside go."""
    x0, top, x1, bottom = G.inset(G.edges(), by)
    return boxes.where((x1 > x0) & (bottom > top)).withColumns(dict(zip(EDGES, (x0, top, x1, bottom), strict=True)))


def match_ducts(labels: DataFrame, rects: DataFrame, keys: Sequence[str], t: Thresholds = USUAL, cell: float | None = None) -> DataFrame:
    """Each label (keys, ord, edges, diameter_in) with the duct it describes, or with nulls.

    A rectangle qualifies if its shorter side suits the diameter and it isn't the
    label's own box. Rectangles whose box, grown by the label's longer side, holds the
    label's centre come first, the largest of them; else the nearest within the search
    radius, larger ones and then earlier ones first.

    The join is on the page. With ``cell`` rectangles are entered in all cells of a
    grid that their search range touches, and labels in one, so that pages with very
    many rectangles are split, too.
    """
    a = labels.select(*keys, F.col("ord").alias("l_ord"), "diameter_in", *[F.col(e).alias(f"l_{e}") for e in EDGES])
    b = rects.select(*keys, F.col("ord").alias("r_ord"), *[F.col(e).alias(f"r_{e}") for e in EDGES])
    l_box, r_box = G.edges("l_"), G.edges("r_")
    w, h = r_box[2] - r_box[0], r_box[3] - r_box[1]
    low, high = t.min_scale * F.col("diameter_in"), F.least(F.lit(t.search_radius), t.max_scale * F.col("diameter_in"))
    grown = F.greatest(l_box[2] - l_box[0], l_box[3] - l_box[1])
    cx, cy = (l_box[0] + l_box[2]) * 0.5, (l_box[1] + l_box[3]) * 0.5
    holds = cx.between(r_box[0] - grown, r_box[2] + grown) & cy.between(r_box[1] - grown, r_box[3] + grown)
    away = F.hypot((r_box[0] + r_box[2]) * 0.5 - cx, (r_box[1] + r_box[3]) * 0.5 - cy)
    on = list(keys)
    if cell:
        reach = max(t.search_radius, t.label_width[1], t.label_height[1])
        cells = lambda lo, hi: F.sequence(F.floor((lo - reach) / cell), F.floor((hi + reach) / cell))
        b = b.withColumn("cell_x", F.explode(cells(r_box[0], r_box[2]))).withColumn("cell_y", F.explode(cells(r_box[1], r_box[3])))
        a = a.withColumn("cell_x", F.floor(cx / cell)).withColumn("cell_y", F.floor(cy / cell))
        on += ["cell_x", "cell_y"]
    pairs = (
        a.where(low < high)
        .join(b.where((w > 0) & (h > 0)), on)
        .where(F.least(w, h).between(low, high) & ~G.same_box(r_box, l_box))
        .withColumn("tier", F.when(holds, 0).when(away <= t.search_radius, 1))
        .where("tier is not null")
        .withColumn("far", F.when(F.col("tier") == 1, away).otherwise(0.0))
        .withColumn("area", w * h)
    )
    first = Window.partitionBy(*keys, "l_ord").orderBy("tier", "far", F.desc("area"), "r_ord")
    best = pairs.withColumn("place", F.row_number().over(first)).where("place = 1").select(*keys, F.col("l_ord").alias("ord"), "tier", F.col("r_ord").alias("duct_ord"), *[F.col(f"r_{e}").alias(f"duct_{e}") for e in EDGES])
    drawn = F.least(F.col("duct_x1") - F.col("duct_x0"), F.col("duct_bottom") - F.col("duct_top"))
    return labels.join(best, [*keys, "ord"], "left").withColumn("drawn_pts", drawn).withColumn("pts_per_inch", drawn / F.col("diameter_in"))


def page_scales(callouts: DataFrame, keys: Sequence[str], band: float = USUAL.scale_band, value: str = "pts_per_inch") -> DataFrame:
    """Per page: the mean of the values near the median (the median if none is), callouts and values left out."""
    middle = F.median(value).over(Window.partitionBy(*keys))
    near = F.col(value).between(F.col("middle") * (1 - band), F.col("middle") * (1 + band))
    return (
        callouts.withColumn("middle", middle)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.avg(F.when(near, F.col(value))), F.first("middle")).alias("scale"),
            F.count("*").alias("callout_count"),
            F.count_if(F.col(value).isNotNull() & ~near).alias("rejected"),
        )
    )
