"""Joins, aggregates, windows and the scale and cleanup pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T
from ..operators import cleanup, extract, scale, shapes
from ..plans import recipe
from ..schema import TYPES, VISIBLE, Thresholds
from ..session import table
from .registry import COLOR, COLORS, INK, black_sql, kinds_cte, label_cte, match_cte, query, rect_cte, scale_cte

KEYS = ["sheet"]
MATCHED = ("sheet", "ord", "tier", "duct_ord")


def _matches(spark: SparkSession, sf_dir: str, dense: bool = False, cell: float | None = None) -> DataFrame:
    return scale.match_ducts(recipe.labels(spark, sf_dir, dense), recipe.rectangles(spark, sf_dir, dense), KEYS, cell=cell)


def _scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.page_scales(_matches(spark, sf_dir), KEYS)


@query(f"WITH {rect_cte()}, {label_cte()}, {match_cte()} SELECT sheet, ord, tier, duct_ord, round(pts_per_inch, 6) AS pts_per_inch FROM m WHERE tier IS NOT NULL")
def jn_geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join with tiers and the first of each label."""
    return _matches(spark, sf_dir).where("tier is not null").select(*MATCHED, F.round("pts_per_inch", 6).alias("pts_per_inch"))


@query(f"WITH {rect_cte(dense=True)}, {label_cte()}, {match_cte()} SELECT sheet, ord, tier, duct_ord FROM m")
def jn_geom_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join on dense pages, split by a grid."""
    return _matches(spark, sf_dir, dense=True, cell=256.0).select(*MATCHED)


@query(f"WITH {rect_cte()}, {label_cte()}, {match_cte()} SELECT sheet, ord, duct_ord, drawn_pts FROM m WHERE tier = 0")
def jn_geom_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).where("tier = 0").select("sheet", "ord", "duct_ord", "drawn_pts")


@query(f"WITH {rect_cte()}, {label_cte()}, {match_cte()} SELECT sheet, ord, duct_ord, drawn_pts FROM m WHERE tier = 1")
def jn_geom_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).where("tier = 1").select("sheet", "ord", "duct_ord", "drawn_pts")


@query(f"""WITH {rect_cte()}, {label_cte()} SELECT a.sheet, a.ord, count(*) AS n FROM lab a JOIN r b ON a.sheet = b.sheet
  WHERE least(b.x1 - b.x0, b.bottom - b.top) BETWEEN 0.3::DOUBLE * a.diameter_in AND least(120::DOUBLE, 5 * a.diameter_in) GROUP BY a.sheet, a.ord""")
def jn_geom_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rectangles of its page suit a label's diameter."""
    a = recipe.labels(spark, sf_dir).select("sheet", "ord", "diameter_in")
    b = recipe.rectangles(spark, sf_dir).select("sheet", F.least(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")).alias("side"))
    suits = F.col("side").between(0.3 * F.col("diameter_in"), F.least(F.lit(120.0), 5 * F.col("diameter_in")))
    return a.join(b, "sheet").where(suits).groupBy("sheet", "ord").agg(F.count("*").alias("n"))


@query(f"""WITH {rect_cte()} SELECT a.sheet, a.ord, b.ord AS other FROM r a JOIN r b ON a.sheet = b.sheet
  WHERE abs(a.x0 - b.x0) < 300 AND abs(a.top - b.top) < 300 AND abs(a.x1 - b.x1) < 300 AND abs(a.bottom - b.bottom) < 300 AND a.ord < b.ord""")
def jn_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rectangles whose edges all agree within a tolerance."""
    r = recipe.rectangles(spark, sf_dir)
    a = r.select("sheet", "ord", *[F.col(e).alias(f"a_{e}") for e in G.EDGES])
    b = r.select("sheet", F.col("ord").alias("other"), *[F.col(e).alias(f"b_{e}") for e in G.EDGES])
    return a.join(b, "sheet").where(G.same_box(G.edges("a_"), G.edges("b_"), 300.0) & (F.col("ord") < F.col("other"))).select("sheet", "ord", "other")


@query(f"WITH {rect_cte()}, {label_cte()}, {match_cte()} SELECT sheet, ord, diameter_in, duct_ord FROM m")
def jn_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label, with nulls where no duct was found."""
    return _matches(spark, sf_dir).select("sheet", "ord", "diameter_in", "duct_ord")


CROPS = "crops AS (SELECT s_suppkey * 1000 + i AS sheet, s_suppkey % 10 * 60::DOUBLE AS c0, s_suppkey % 7 * 40::DOUBLE AS c1 FROM supplier, (SELECT unnest(range(10)) AS i))"


@query(f"WITH {CROPS} SELECT DISTINCT l_suppkey * 1000 + l_orderkey % 40 AS sheet FROM lineitem WHERE l_suppkey * 1000 + l_orderkey % 40 IN (SELECT sheet FROM crops)")
def jn_cropsemi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.pages_with_crops(recipe.sheets(spark, sf_dir), recipe.crops(spark, sf_dir), KEYS).select("sheet")


@query(f"WITH {rect_cte()}, {CROPS} SELECT r.sheet, ord, c0, c1 FROM r JOIN crops ON r.sheet = crops.sheet")
def jn_cropattach(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = recipe.crops(spark, sf_dir).select("sheet", F.col("x0").alias("c0"), F.col("top").alias("c1"))
    return recipe.rectangles(spark, sf_dir).select("sheet", "ord").join(c, "sheet")


@query(f"""WITH {rect_cte()}, {label_cte()}, {match_cte()}, {scale_cte()}
  SELECT s.sheet, round(scale, 6) AS scale FROM (SELECT DISTINCT sheet FROM r) s LEFT JOIN sc ON s.sheet = sc.sheet""")
def jn_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their scale, if one was found."""
    return cleanup.with_scale(recipe.sheets(spark, sf_dir), _scales(spark, sf_dir), KEYS).select("sheet", F.round("scale", 6).alias("scale"))


REGIONS = "reg AS (SELECT l_suppkey AS sheet, l_orderkey AS o, l_linenumber AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem)"


@query(f"WITH {REGIONS} SELECT s_suppkey AS sheet, o, n FROM supplier LEFT JOIN (SELECT * FROM reg WHERE place = 1) ON s_suppkey = sheet")
def jn_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region of each page, if it has any."""
    first = Window.partitionBy("l_suppkey").orderBy(*recipe.ORDER)
    regions = table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(first)).where("place = 1")
    regions = regions.select(F.col("l_suppkey").alias("sheet"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sheet")).join(regions, "sheet", "left")


@query(f"WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, type, x0 FROM e WHERE id IN ('rect#0003', 'word#0007', 'line#0001')")
def jn_byid(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("rect#0003",), ("word#0007",), ("line#0001",)], "id string")
    return recipe.kinds(spark, sf_dir).join(F.broadcast(wanted), "id").select("sheet", "ord", "type", "x0")


@query(f"""WITH {rect_cte()}, p AS (SELECT * FROM r)
  SELECT a.sheet, a.ord, b.ord AS other, least(a.x0, b.x0) AS x0, greatest(a.x1, b.x1) AS x1 FROM p a JOIN p b ON a.sheet = b.sheet AND a.ord < b.ord
  WHERE CASE WHEN abs(a.top - b.top) <= 40 AND abs(a.bottom - b.bottom) <= 40 THEN least(a.x1, b.x1) <= greatest(a.x0, b.x0)
             ELSE abs(a.x0 - b.x0) <= 40 AND abs(a.x1 - b.x1) <= 40 AND least(a.bottom, b.bottom) <= greatest(a.top, b.top) END""")
def jn_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that face each other, at a tolerance that finds some."""
    box = F.struct(F.col("x0"), F.col("top").alias("y0"), F.col("x1"), F.col("bottom").alias("y1"))
    p = recipe.rectangles(spark, sf_dir).select("sheet", "ord", box.alias("a"))
    q = p.select("sheet", F.col("ord").alias("other"), F.col("a").alias("b"))
    joint = shapes.facing_box(F.col("a"), F.col("b"), 40.0)
    return p.join(q, "sheet").where("ord < other").withColumn("joint", joint).where("joint is not null").select("sheet", "ord", "other", "joint.x0", "joint.x1")


DEDUPE = f"""WITH RECURSIVE {rect_cte(dense=True)},
  o AS (SELECT sheet, ord, x0, top FROM r),
  walk AS (
    SELECT sheet, 0::BIGINT AS step, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept FROM (SELECT DISTINCT sheet FROM o)
    UNION ALL
    SELECT w.sheet, w.step + 1, CASE WHEN len(list_filter(w.kept, lambda k: abs(k.x - o.x0) < 8 AND abs(k.y - o.top) < 8)) > 0 THEN w.kept ELSE list_append(w.kept, {{'x': o.x0, 'y': o.top}}) END
    FROM walk w JOIN o ON o.sheet = w.sheet AND o.ord = w.step + 1),
  ends AS (SELECT sheet, max(step) AS step FROM walk GROUP BY sheet)
  SELECT w.sheet, len(w.kept)::BIGINT AS n, round(list_sum(list_transform(w.kept, lambda k: k.x)), 2) AS x FROM walk w JOIN ends e ON w.sheet = e.sheet AND w.step = e.step"""


@query(DEDUPE)
def agg_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered dedupe on dense pages, at a tolerance that bites."""
    kept = scale.dedupe_boxes(recipe.rectangles(spark, sf_dir, dense=True), KEYS, 8.0, F.col("x0"), F.col("top"))
    return kept.groupBy("sheet").agg(F.count("*").alias("n"), F.round(F.sum("x0"), 2).alias("x"))


@query(f"WITH {rect_cte(dense=True)} SELECT a.sheet, a.ord, b.ord AS other FROM r a JOIN r b ON a.sheet = b.sheet AND a.ord < b.ord WHERE abs(a.x0 - b.x0) < 8 AND abs(a.top - b.top) < 8")
def jn_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison that the dedupe makes: pairs of boxes near each other on dense pages."""
    return scale.near_boxes(recipe.rectangles(spark, sf_dir, dense=True), KEYS, 8.0, F.col("x0"), F.col("top"))


@query(f"WITH {rect_cte()}, {label_cte()}, {match_cte()}, {scale_cte()} SELECT sheet, round(scale, 6) AS scale FROM sc WHERE scale IS NOT NULL")
def agg_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scales(spark, sf_dir).where("scale is not null").select("sheet", F.round("scale", 6).alias("scale"))


@query(f"WITH {rect_cte()}, {label_cte()} SELECT sheet, count(*) AS callout_count FROM lab GROUP BY sheet")
def agg_callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scales(spark, sf_dir).select("sheet", "callout_count")


@query(f"WITH {rect_cte()}, {label_cte()}, {match_cte()}, {scale_cte()} SELECT sheet, rejected FROM sc WHERE rejected > 0")
def agg_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scales(spark, sf_dir).where("rejected > 0").select("sheet", "rejected")


@query(f"""WITH {rect_cte()}, {label_cte()}, {match_cte()}, med AS (SELECT *, median(pts_per_inch) OVER (PARTITION BY sheet) AS middle FROM m)
  SELECT sheet, ord, round(pts_per_inch, 6) AS v, round(middle, 6) AS middle FROM med WHERE pts_per_inch BETWEEN middle * 0.9::DOUBLE AND middle * 1.1::DOUBLE""")
def flt_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("pts_per_inch")
    m = _matches(spark, sf_dir).withColumn("middle", F.median(v).over(Window.partitionBy("sheet")))
    return m.where(v.between(F.col("middle") * (1 - 0.1), F.col("middle") * (1 + 0.1))).select("sheet", "ord", F.round(v, 6).alias("v"), F.round("middle", 6).alias("middle"))


@query(f"WITH {rect_cte()}, {label_cte()}, {match_cte()} SELECT sheet, ord, round(median(pts_per_inch) OVER (PARTITION BY sheet), 6) AS middle FROM m")
def win_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("sheet", "ord", F.round(F.median("pts_per_inch").over(Window.partitionBy("sheet")), 6).alias("middle"))


SIZES = "greatest((x1 - x0) / (bottom - top), (bottom - top) / (x1 - x0)) >= 1.2::DOUBLE"
SIDES = "(x1 - x0) >= 3.0::DOUBLE * 1.5 AND (bottom - top) >= 3.0::DOUBLE * 1.5"
AREA = "((x1 - x0) / 1.5::DOUBLE) * ((bottom - top) / 1.5::DOUBLE) <= 1800"
WHOLE = "type NOT IN ('rect', 'rect_curve')"
LIMITS = Thresholds(max_area_sq_inches=1800.0)


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.kinds(spark, sf_dir).withColumn("scale", F.lit(1.5))


COUNTS = f"""WITH {rect_cte()}, {kinds_cte()}, kept AS (SELECT type FROM e WHERE {INK} AND ({WHOLE} OR ({SIZES} AND {SIDES} AND {AREA})))
  SELECT t.type, count(kept.type) AS n FROM (SELECT unnest({list(TYPES)}) AS type) t LEFT JOIN kept ON t.type = kept.type GROUP BY t.type"""


@query(COUNTS)
def agg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.type_counts(_scaled(spark, sf_dir), LIMITS)


@query(f"SELECT sum(n)::BIGINT AS total FROM ({COUNTS}) WHERE type IN ('rect', 'rect_curve', 'rect_partial')")
def agg_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_counts(spark, sf_dir).where(F.col("type").isin(*VISIBLE)).agg(F.sum("n").alias("total"))


@query(f"""WITH {rect_cte()}, {kinds_cte()}, c AS (SELECT lower({COLOR}) AS color, type FROM e WHERE {COLOR} IS NOT NULL)
  SELECT color, count(*) AS n, count(*) FILTER (WHERE type = 'line') AS lines, count(*) FILTER (WHERE type = 'rect') AS rects FROM c GROUP BY color""")
def agg_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t: F.coalesce(F.try_element_at("by_type", F.lit(t)), F.lit(0))
    return cleanup.color_summary(recipe.kinds(spark, sf_dir)).select("color", "n", n("line").alias("lines"), n("rect").alias("rects"))


@query("SELECT p_partkey, list_min(c) AS conf FROM (SELECT p_partkey, [p_partkey * 3 % 100, p_partkey * 7 % 100] AS c FROM part)")
def agg_minconf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.tokens(spark, sf_dir).select("p_partkey", T.min_confidence(F.col("tokens")).cast("long").alias("conf"))


@query("""SELECT p_partkey, (p_partkey % 5)::BIGINT AS left_px, (p_partkey % 9)::BIGINT AS top_px, (p_partkey % 5 + 45)::BIGINT AS right_px, (p_partkey % 9 + 30)::BIGINT AS bottom_px FROM part""")
def agg_textbbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.tokens_bbox(F.col("tokens"), F.lit(0.0), F.lit(0.0), 72)
    return recipe.tokens(spark, sf_dir).select("p_partkey", *[F.round(b[e]).cast("long").alias(n) for e, n in zip(G.EDGES, ("left_px", "top_px", "right_px", "bottom_px"), strict=True)])


@query("SELECT count(*) AS pages FROM (SELECT DISTINCT l_suppkey * 1000 + l_orderkey % 40 FROM lineitem)")
def agg_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.sheets(spark, sf_dir).agg(F.count("*").alias("pages"))


@query(f"WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, type, row_number() OVER (PARTITION BY sheet, type ORDER BY ord) AS place FROM e")
def win_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = extract.numbered(recipe.kinds(spark, sf_dir).drop("id"), KEYS)
    return ids.select("sheet", "ord", "type", F.substring_index("id", "#", -1).cast("long").alias("place"))


@query(f"""WITH {rect_cte(dense=True)}, t AS (SELECT sheet, ord, (x1 - x0) * (bottom - top) AS area, row_number() OVER (PARTITION BY sheet ORDER BY (x1 - x0) * (bottom - top) DESC, ord) AS place FROM r)
  SELECT sheet, ord, area FROM t WHERE place = 1""")
def win_top1_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rectangle of each page, the first of equal ones."""
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    r = recipe.rectangles(spark, sf_dir, dense=True).withColumn("area", area)
    return r.withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy(F.desc("area"), "ord"))).where("place = 1").select("sheet", "ord", "area")


NEAREST = f"""WITH {rect_cte(dense=True)}, d AS (SELECT sheet, ord, abs(x0 - 600) + abs(top - 400) AS d, (x1 - x0) * (bottom - top) AS area FROM r),
  t AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY d, area DESC, ord) AS place FROM d)"""


def _by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recipe.rectangles(spark, sf_dir, dense=True)
    r = r.select("sheet", "ord", (F.abs(F.col("x0") - 600) + F.abs(F.col("top") - 400)).alias("d"), ((F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))).alias("area"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy("d", F.desc("area"), "ord")))


@query(NEAREST + " SELECT sheet, ord, d FROM t WHERE place = 1")
def win_top1_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_distance(spark, sf_dir).where("place = 1").select("sheet", "ord", "d")


@query(NEAREST + " SELECT sheet, ord, place FROM t")
def srt_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order by distance, larger ones first, then earlier ones."""
    return _by_distance(spark, sf_dir).select("sheet", "ord", F.col("place").cast("long").alias("place"))


@query(f"WITH {CROPS}, s AS (SELECT DISTINCT sheet FROM crops) SELECT sheet, row_number() OVER (ORDER BY sheet) AS place FROM s")
def srt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cropped pages in order: ranges first, so that no task sorts all of them."""
    pages = recipe.crops(spark, sf_dir).select("sheet").distinct().withColumn("part", F.floor(F.col("sheet") / 1000))
    sums = pages.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("sheet")) + F.col("before")
    return pages.join(sums, "part").select("sheet", place.alias("place"))


@query(f"WITH {rect_cte()}, {kinds_cte()} SELECT lower({COLOR}) AS color, count(*) AS n FROM e WHERE {COLOR} IS NOT NULL GROUP BY 1 ORDER BY n DESC, color")
def srt_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.color_summary(recipe.kinds(spark, sf_dir)).select("color", "n")


@query(f"WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, id FROM e WHERE sheet = 1000 ORDER BY ord LIMIT 20 OFFSET 5")
def lim_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a list in view: a page of 8 rows with 12 more, from the sixth on."""
    return recipe.kinds(spark, sf_dir).where("sheet = 1000").orderBy("ord").offset(5).limit(20).select("sheet", "ord", "id")


@query("SELECT s_suppkey, least(greatest(s_suppkey - 3, 1), 50) AS page FROM supplier")
def lim_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page number after a step, kept in range."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", G.clamp(F.col("s_suppkey") - 3, 1, 50).alias("page"))


@query(f"""WITH {rect_cte()}, u AS (SELECT sheet, ord, CASE WHEN l_linenumber = 2 THEN 0 ELSE 1 END AS src FROM r WHERE l_linenumber IN (2, 4, 5))
  SELECT sheet, ord, src, row_number() OVER (PARTITION BY sheet ORDER BY src, ord) AS place FROM u""")
def set_union_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native rectangles, then rectangles among paths, in order."""
    raw = recipe.raw_objects(spark, sf_dir)
    native = raw.where("kind = 'rect'").select("sheet", "ord", F.lit(0).alias("src"))
    paths = extract.classify_curves(raw.where("kind = 'curve'")).where("type = 'rect_curve'").select("sheet", "ord", F.lit(1).alias("src"))
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("src", "ord"))
    return native.unionByName(paths).select("sheet", "ord", "src", place.cast("long").alias("place"))


@query(f"WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, type, text FROM e")
def set_union_elems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of all kinds as one relation, with nulls where a kind lacks a column."""
    e = recipe.kinds(spark, sf_dir)
    words, others = e.where("type = 'word'").select("sheet", "ord", "type", "text"), e.where("type <> 'word'").select("sheet", "ord", "type")
    return others.unionByName(words, allowMissingColumns=True)


@query(f"""WITH {rect_cte()}, {kinds_cte()}, {label_cte()}, {match_cte()}, {scale_cte()}
  SELECT e.sheet, e.ord, type, round((x1 - x0) / scale, 4) AS w_in, round((bottom - top) / scale, 4) AS h_in FROM e LEFT JOIN sc ON e.sheet = sc.sheet
  WHERE type IN ('rect', 'rect_curve', 'rect_partial') AND {INK} AND ({WHOLE} OR ({SIZES} AND (scale IS NULL OR ((x1 - x0) >= 3.0::DOUBLE * scale
    AND (bottom - top) >= 3.0::DOUBLE * scale AND ((x1 - x0) / scale) * ((bottom - top) / scale) <= 8000))))""")
def pipe_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown rectangles with their real sizes."""
    shown = cleanup.visible(cleanup.with_scale(recipe.kinds(spark, sf_dir), _scales(spark, sf_dir), KEYS))
    return cleanup.real_sizes(shown).select("sheet", "ord", "type", F.round("w_in", 4).alias("w_in"), F.round("h_in", 4).alias("h_in"))


@query(f"""WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, type FROM e WHERE type IN ('rect', 'rect_curve', 'rect_partial') AND {INK}
  AND ({WHOLE} OR ({SIZES} AND {SIDES} AND {AREA}))""")
def flt_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.visible(_scaled(spark, sf_dir), t=LIMITS).select("sheet", "ord", "type")


def _filtered(condition, *columns: str):
    return lambda spark, sf_dir: _scaled(spark, sf_dir).where(condition()).select(*(columns or ("sheet", "ord", "type")))


def _register(name: str, sql: str, condition) -> None:
    f = _filtered(condition)
    f.__name__ = name
    query(f"WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, type FROM e WHERE {sql}")(f)


_register("flt_aspect", f"{WHOLE} OR {SIZES}", cleanup.passes_aspect)
_register("flt_minside", f"{WHOLE} OR ({SIDES})", lambda: cleanup.passes_min_side(F.lit(1.5)))
_register("flt_maxarea", f"{WHOLE} OR {AREA}", lambda: cleanup.passes_max_area(F.lit(1.5), 1800.0))
_register("flt_ink", INK, cleanup.passes_ink)
_register("flt_search", "contains(lower(id), '#0012') OR (type = 'word' AND contains(lower(text), '#0012'))", lambda: cleanup.passes_search(" #0012 "))
_register("flt_type", "type IN ('rect', 'rect_curve', 'rect_partial')", lambda: F.col("type").isin(*VISIBLE))
_register("flt_label", "least((x1 - x0) * 0.8::DOUBLE, (bottom - top) * 0.8::DOUBLE) > 16", lambda: F.least((F.col("x1") - F.col("x0")) * 0.8, (F.col("bottom") - F.col("top")) * 0.8) > 16)
_register("flt_tiny", "x1 - x0 >= 12 AND bottom - top >= 12", lambda: (F.col("x1") - F.col("x0") >= 12) & (F.col("bottom") - F.col("top") >= 12))


@query(f"""WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, type FROM e WHERE type IN ('rect', 'rect_curve', 'rect_partial')
  AND (x0 + x1) / 2 BETWEEN 0 AND 1224 AND (top + bottom) / 2 BETWEEN 0 AND 792""")
def flt_measurable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.measurable(recipe.kinds(spark, sf_dir), recipe.sheets(spark, sf_dir), KEYS).select("sheet", "ord", "type")


@query(f"WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, round((x1 - x0) / 1.5::DOUBLE, 4) AS w_in, round((bottom - top) / 1.5::DOUBLE, 4) AS h_in FROM e WHERE type LIKE 'rect%'")
def prj_inches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cleanup.real_sizes(_scaled(spark, sf_dir).where(F.col("type").isin(*VISIBLE)))
    return sized.select("sheet", "ord", F.round("w_in", 4).alias("w_in"), F.round("h_in", 4).alias("h_in"))


INKED = f"""{rect_cte()}, {CROPS}, c AS (SELECT r.*, c0, c1, {COLORS} AS ns, CASE WHEN l_orderkey % 5 = 0 THEN {COLORS} END AS s1,
    CASE WHEN l_orderkey % 2 = 0 THEN {COLORS} WHEN l_orderkey % 3 = 0 THEN []::DOUBLE[] END AS s2 FROM r JOIN crops ON r.sheet = crops.sheet),
  d AS (SELECT *, CASE WHEN len(s1) > 0 THEN s1 ELSE s2 END AS st FROM c),
  inked AS (
    SELECT *, CASE WHEN l_linenumber = 1 THEN 'line' ELSE 'rect' END AS shape FROM d
    WHERE l_partkey % 50 <> 0 AND NOT (x1 < c0 OR x0 > c0 + 600 OR bottom < c1 OR top > c1 + 300)
      AND CASE WHEN l_linenumber = 1 THEN {black_sql("st", 0.02)} WHEN l_linenumber IN (2, 4, 5) THEN {black_sql("st", 0.02)} OR {black_sql("ns", 0.02)} ELSE FALSE END)"""


def _inked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = recipe.crops(spark, sf_dir).select("sheet", *[F.col(e).alias(f"c_{e}") for e in G.EDGES])
    return scale.black_objects(recipe.raw_objects(spark, sf_dir).join(c, "sheet"), 0.02, G.edges("c_"))


@query(f"WITH {INKED} SELECT sheet, ord, shape FROM inked")
def src_black(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black lines and rectangles, those among paths included, inside their page's crop."""
    return _inked(spark, sf_dir).select("sheet", "ord", "shape")


@query(f"WITH {INKED} SELECT sheet, ord, x0, top, x1, bottom FROM inked WHERE l_linenumber = 2")
def src_black_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native rectangles by stroke or fill."""
    return _inked(spark, sf_dir).where("kind = 'rect'").select("sheet", "ord", *G.EDGES)
