"""Boxes, points and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import extract, scale, shapes
from ..plans import recipe
from ..session import table
from .registry import LABEL, query, rect_cte

W, H = "(8 + 2 * l_quantity)", "(6 + (floor(l_extendedprice)::BIGINT % 97) * 0.5::DOUBLE)"
PX, PY = "((l_partkey * 37 + l_orderkey * 11) % 1224)::DOUBLE", "((l_orderkey * 53 + l_linenumber * 101) % 792)::DOUBLE"
SHAPE = f"{rect_cte()}, s AS (SELECT *, {W} AS w, {H} AS h, {PX} AS px, {PY} AS py, l_linenumber % 4 AS k FROM r)"
#: A U of unequal arms passes for a turned rectangle if it is narrow enough.
NEARLY = "(0.0625::DOUBLE * w <= 1 AND abs(sqrt(w * w + h * h) - sqrt(0.5625::DOUBLE * w * w + h * h)) <= greatest(1::DOUBLE, 0.02::DOUBLE * sqrt(w * w + h * h)))"
PARTIAL = "(least(w, 0.75::DOUBLE * w) >= 2 * h AND 0.25::DOUBLE * w <= 0.3::DOUBLE * w)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.curves(spark, sf_dir).withColumn("path", shapes.rounded(F.col("pts")))


@query(f"WITH {rect_cte()} SELECT sheet, ord FROM r WHERE NOT (x1 < 100 OR x0 > 700 OR bottom < 50 OR top > 400)")
def flt_crop_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = tuple(F.lit(v) for v in (100.0, 50.0, 700.0, 400.0))
    return recipe.rectangles(spark, sf_dir).where(G.intersects(G.edges(), crop)).select("sheet", "ord")


@query(f"WITH {rect_cte()} SELECT sheet, ord FROM r WHERE {LABEL}")
def flt_cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.rectangles(spark, sf_dir).where(scale.label_sized()).select("sheet", "ord")


@query(f"WITH {rect_cte()} SELECT sheet, ord, x0 + 5 AS x0, bottom - 5 AS bottom FROM r WHERE x1 - x0 > 10 AND bottom - top > 10")
def flt_inset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.inset_boxes(recipe.rectangles(spark, sf_dir), 5.0).select("sheet", "ord", "x0", "bottom")


PRICE = "l_extendedprice / 1000"
ROUND1 = """CASE WHEN y - floor(y) <> 0.5 THEN round_even(y, 0) WHEN rest > 0 THEN floor(y) + 1 WHEN rest < 0 THEN floor(y) ELSE round_even(y, 0) END / 10"""


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, {PRICE} AS v FROM lineitem), t AS (SELECT *, v * 10 AS y, v * 134217729 AS big FROM v),
  u AS (SELECT *, big - (big - v) AS high FROM t), z AS (SELECT *, (high * 10 - y) + (v - high) * 10 AS rest FROM u) SELECT l_orderkey, l_linenumber, l_partkey, {ROUND1} AS v FROM z""")
def geo_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.round1(F.col("l_extendedprice") / 1000).alias("v"))


@query(f"WITH {SHAPE} SELECT sheet, ord, k IN (0, 1) AS axis FROM s")
def geo_axisrect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("sheet", "ord", shapes.has_axis_rectangle(F.col("path")).alias("axis"))


@query(f"WITH {SHAPE} SELECT sheet, ord, CASE WHEN k = 3 THEN 3 ELSE 4 END AS n FROM s")
def geo_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("sheet", "ord", F.size(shapes.convex_hull(F.col("path"))).alias("n"))


@query(f"WITH {SHAPE} SELECT sheet, ord, CASE k WHEN 2 THEN {NEARLY} WHEN 3 THEN FALSE ELSE TRUE END AS turned FROM s")
def geo_rotrect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first four distinct vertices are a rectangle at any angle."""
    return _paths(spark, sf_dir).select("sheet", "ord", shapes.is_turned_rectangle(shapes.without_repeats(F.col("path"))).alias("turned"))


@query(f"WITH {SHAPE} SELECT sheet, ord, k IN (0, 1) OR (k = 2 AND {NEARLY}) AS rectlike FROM s")
def geo_rectlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.classify_curves(recipe.curves(spark, sf_dir)).select("sheet", "ord", (F.col("type") == "rect_curve").alias("rectlike"))


@query(f"WITH {SHAPE} SELECT sheet, ord, CASE WHEN k <> 3 THEN px END AS x0, CASE WHEN k <> 3 THEN py END AS y0, CASE k WHEN 2 THEN px + 0.75::DOUBLE * w ELSE px + w END AS x2, py + h AS y2 FROM s WHERE k IN (0, 1) OR (k = 2 AND {NEARLY})")
def geo_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and third corner of straight and of turned rectangles."""
    p = extract.classify_curves(recipe.curves(spark, sf_dir)).where("corners is not null")
    at = lambda i, c: F.col("corners")[i][c]
    return p.select("sheet", "ord", at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(2, "x").alias("x2"), at(2, "y").alias("y2"))


@query(f"WITH {SHAPE} SELECT sheet, ord, px AS x0, px + w AS x1, py + h AS y1 FROM s WHERE (k = 2 AND {PARTIAL}) OR (k IN (0, 1) AND w >= 2 * h)")
def geo_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = shapes.partial_box(F.col("path"))
    return _paths(spark, sf_dir).withColumn("part", part).where("part is not null").select("sheet", "ord", "part.x0", "part.x1", "part.y1")


@query(f"WITH {SHAPE} SELECT sheet, ord, CASE WHEN k IN (0, 1) OR (k = 2 AND {NEARLY}) THEN 'rect_curve' WHEN k = 2 AND {PARTIAL} THEN 'rect_partial' ELSE 'curve' END AS type FROM s")
def prj_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.classify_curves(recipe.curves(spark, sf_dir)).select("sheet", "ord", "type")


@query(f"WITH {SHAPE} SELECT sheet, ord, CASE k WHEN 3 THEN w ELSE w END AS w, h FROM s")
def geo_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side lengths along the corners of each path's extent."""
    corners = shapes.box_corners(shapes.extent(F.col("path")))
    s = G.sides(F.lit("rect_curve"), G.edges(), corners)
    return _paths(spark, sf_dir).select("sheet", "ord", s["w"].alias("w"), s["h"].alias("h"))


@query(f"WITH {SHAPE} SELECT sheet, ord, px AS x0, py AS y0, px + w AS x1, py + h AS y1 FROM s")
def agg_pathbbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shapes.extent(F.col("path"))
    return _paths(spark, sf_dir).select("sheet", "ord", *[e[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"WITH {SHAPE} SELECT sheet, ord, round(px + CASE k WHEN 2 THEN 0.4375::DOUBLE * w WHEN 3 THEN 2 * w / 3 ELSE 0.5::DOUBLE * w END, 6) AS cx FROM s")
def agg_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean x of a path's vertices."""
    mean = G.let(shapes.without_repeats(F.col("path")), lambda p: F.aggregate(F.transform(p, lambda q: q["x"]), F.lit(0.0), lambda a, v: a + v) / F.size(p))
    return _paths(spark, sf_dir).select("sheet", "ord", F.round(mean, 6).alias("cx"))


@query(f"WITH {SHAPE} SELECT sheet, ord, CASE k WHEN 3 THEN 3 ELSE 4 END AS n FROM s")
def agg_dedupecons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points left of paths whose every point is given twice."""
    twice = F.flatten(F.transform("path", lambda p: F.array(p, p)))
    return _paths(spark, sf_dir).select("sheet", "ord", F.size(shapes.without_repeats(twice)).alias("n"))


@query(f"WITH {SHAPE} SELECT sheet, ord, CASE k WHEN 3 THEN 3 ELSE 4 END AS n FROM s")
def agg_distinctpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("sheet", "ord", F.size(F.array_distinct("path")).alias("n"))


@query(f"WITH {SHAPE} SELECT sheet, ord, CASE k WHEN 0 THEN 4 ELSE 3 END AS changes FROM s")
def win_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that differ from the one before."""
    changed = F.filter("path", lambda p, i: (i > 0) & (F.try_element_at("path", F.greatest(i, F.lit(1))) != p))
    return _paths(spark, sf_dir).select("sheet", "ord", F.size(changed).alias("changes"))


@query(f"""WITH {SHAPE} SELECT sheet, ord, round(CASE k WHEN 2 THEN w + h + 0.75::DOUBLE * w + sqrt(0.0625::DOUBLE * w * w + h * h) WHEN 3 THEN w + h + sqrt(w * w + h * h) ELSE 2 * w + 2 * h END, 6) AS ring FROM s""")
def win_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length around paths, with the closing side."""
    p = F.col("path")
    after = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    length = F.aggregate(F.transform(F.arrays_zip(p.alias("a"), after.alias("b")), lambda z: G.distance(z["a"], z["b"])), F.lit(0.0), lambda a, v: a + v)
    return _paths(spark, sf_dir).select("sheet", "ord", F.round(length, 6).alias("ring"))


@query(f"WITH {SHAPE} SELECT sheet, ord, k IN (0, 1) AS inside FROM s")
def set_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the corners of a path's extent are points of it."""
    return _paths(spark, sf_dir).select("sheet", "ord", shapes.visits_corners(F.col("path")).alias("inside"))


@query(f"WITH {SHAPE} SELECT sheet, ord, px AS x, py AS y, k <> 3 AS all_four FROM s")
def srt_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vertex by angle about the centre (of a triangle, with one vertex given twice), and whether four are different."""
    four = G.let(F.array_distinct("path"), lambda q: F.when(F.size(q) == 3, F.concat(q, F.slice(q, 1, 1))).otherwise(q))
    first = G.let(shapes.by_angle(four), lambda q: q[0])
    return _paths(spark, sf_dir).select("sheet", "ord", first["x"].alias("x"), first["y"].alias("y"), (F.size(F.array_distinct("path")) == 4).alias("all_four"))


@query(f"WITH {SHAPE} SELECT sheet, ord, px AS x, py AS y FROM s")
def srt_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first point in order of x, then y."""
    first = F.array_sort(F.array_distinct("path"))[0]
    return _paths(spark, sf_dir).select("sheet", "ord", first["x"].alias("x"), first["y"].alias("y"))


@query(f"WITH {SHAPE} SELECT sheet, ord, 792 - (py + h) AS low, 792 - py AS high FROM s")
def prj_yflip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shapes.extent(G.flip_points(F.col("path"), F.lit(792.0)))
    return _paths(spark, sf_dir).select("sheet", "ord", e["y0"].alias("low"), e["y1"].alias("high"))


@query(f"WITH {SHAPE} SELECT sheet, ord, x0 + 10 AS x0, bottom - 4 AS bottom, px + 10 AS px FROM s")
def prj_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.shift_box(G.edges(), F.lit(10.0), F.lit(-4.0))
    e = shapes.extent(G.shift_points(F.col("path"), F.lit(10.0), F.lit(-4.0)))
    return _paths(spark, sf_dir).select("sheet", "ord", b["x0"].alias("x0"), b["bottom"].alias("bottom"), e["x0"].alias("px"))


@query("SELECT s_suppkey, x0 / 0.8::DOUBLE AS x0, (x0 + 600) / 0.8::DOUBLE AS x1 FROM (SELECT s_suppkey, s_suppkey % 10 * 60::DOUBLE AS x0 FROM supplier)")
def prj_px2pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.intake import crops_from_pixels

    x0 = F.col("s_suppkey") % 10 * 60.0
    px = table(spark, sf_dir, "supplier").select(F.lit("d").alias("doc"), F.col("s_suppkey").alias("page"), x0.alias("x0"), F.lit(0.0).alias("top"), (x0 + 600).alias("x1"), F.lit(9.0).alias("bottom"), F.lit(0.8).alias("px_per_pt"))
    return crops_from_pixels(px).select(F.col("page").alias("s_suppkey"), "x0", "x1")


@query(f"WITH {rect_cte()} SELECT sheet, ord, greatest(0, least(1000, least(x0, 500))) AS x0, least(1000, greatest(x0, 500)) AS x1 FROM r")
def prj_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box_of_points(F.lit(500.0), F.lit(5.0), F.col("x0"), F.col("top"), 1000.0, 700.0)
    return recipe.rectangles(spark, sf_dir).select("sheet", "ord", b["x0"].alias("x0"), b["x1"].alias("x1"))


@query(f"WITH {rect_cte()} SELECT sheet, ord, x1 - x0 >= bottom - top AS wide, least(x1 - x0, bottom - top) AS distance FROM r")
def prj_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls of rectangles: whether they lie, and how far apart they are."""
    x0, top, x1, bottom = G.edges()
    pair = G.wall_pair(G.edges(), F.least(x1 - x0, bottom - top))
    lies = pair["a"]["top"] == pair["a"]["bottom"]
    return recipe.rectangles(spark, sf_dir).select("sheet", "ord", lies.alias("wide"), pair["distance_pts"].alias("distance"))


@query(f"WITH {rect_cte()} SELECT sheet, ord, (x0 + x1) / 2 AS x, (top + bottom) / 2 AS y FROM r")
def prj_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a duct's measure: between the middles of its walls."""
    m = extract.wall_midpoints(G.wall_pair(G.edges(), F.lit(0.0)))["label"]
    return recipe.rectangles(spark, sf_dir).select("sheet", "ord", m["x"].alias("x"), m["y"].alias("y"))


@query("SELECT s_suppkey * 1000 + i AS sheet, 600::DOUBLE AS w, 300::DOUBLE AS h, s_suppkey % 10 * 60::DOUBLE AS x FROM supplier, (SELECT unnest(range(10)) AS i)")
def prj_regionstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.crops(spark, sf_dir).select("sheet", (F.col("x1") - F.col("x0")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"), F.col("x0").alias("x"))


@query(f"""WITH {rect_cte()}, v AS (
    SELECT *, greatest(1.5::DOUBLE, least(12, least(1280 * 0.4::DOUBLE / greatest((x1 - x0) * 0.8::DOUBLE, 20), 720 * 0.4::DOUBLE / greatest((bottom - top) * 0.8::DOUBLE, 20), 6))) AS focus,
           exp(-0.0015::DOUBLE * (l_quantity * 40 - 1000)) AS factor FROM r),
  z AS (SELECT *, 640 - (x0 + x1) * 0.4::DOUBLE * focus AS ftx, 360 - (top + bottom) * 0.4::DOUBLE * focus AS fty, greatest(0.1::DOUBLE, least(20, focus * factor)) AS scale FROM v)
  SELECT sheet, ord, round(focus, 6) AS focus, round(scale, 6) AS scale, round(x0 - (x0 - ftx) * (scale / focus), 4) AS tx, round(top - (top - fty) * (scale / focus), 4) AS ty FROM z""")
def fn_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rectangle brought into focus, then zoomed about a point of the screen by a turn of the wheel."""
    view = G.focused(G.edges(), F.lit(0.8), F.lit(1280.0), F.lit(720.0))
    r = recipe.rectangles(spark, sf_dir).withColumn("view", view)
    z = G.zoomed(F.col("view"), F.col("x0"), F.col("top"), G.zoom_factor(F.col("l_quantity") * 40 - 1000))
    return r.select("sheet", "ord", F.round("view.scale", 6).alias("focus"), F.round(z["scale"], 6).alias("scale"), F.round(z["tx"], 4).alias("tx"), F.round(z["ty"], 4).alias("ty"))
