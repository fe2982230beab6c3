"""Colours, label texts and display strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import geometry as G
from ..functions import text as T
from ..operators import svg
from ..plans import recipe
from ..session import table
from .registry import COLOR, COLORS, black_sql, hex_sql, kinds_cte, query, rect_cte

OBJECT = "l_orderkey, l_linenumber, l_partkey"


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query(f"WITH c AS (SELECT {OBJECT}, {COLORS} AS c FROM lineitem) SELECT {OBJECT}, {hex_sql('c')} AS hex FROM c")
def fn_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).select(*OBJECT.split(", "), C.hex_color(recipe.colors()).alias("hex"))


@query(f"WITH c AS (SELECT {OBJECT}, {COLORS} AS c FROM lineitem) SELECT {OBJECT}, {black_sql('c', 0.05)} AS black FROM c")
def flt_black(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).select(*OBJECT.split(", "), C.is_black(recipe.colors(), 0.05).alias("black"))


HEXES = "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '#12' ELSE '#' || format('{:06x}', p_partkey * 7919 % 16777216) END"
BYTE = "('0x' || substr(h, {}, 2))::INTEGER"


def _hexes() -> "F.Column":
    p = F.col("p_partkey")
    return F.when(p % 4 == 0, None).when(p % 4 == 1, "#12").otherwise(F.concat(F.lit("#"), F.lpad(F.lower(F.hex(p * 7919 % 16777216)), 6, "0")))


@query(f"""WITH c AS (SELECT p_partkey, {HEXES} AS c, p_partkey * 7919 % 16777216 AS v FROM part)
  SELECT p_partkey, CASE WHEN c IS NULL THEN NULL WHEN c = '#12' THEN 1 ELSE greatest(v // 65536, v // 256 % 256, v % 256) / 255 END::DOUBLE AS luma FROM c""")
def fn_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.hex_luma(_hexes()).alias("luma"))


def _svg_colors() -> "F.Column":
    p = F.col("p_partkey")
    options = [F.lit("black"), F.lit(" White "), F.lit("none"), F.lit("#0a0"), F.lit("#0A141E"), F.concat(F.lit("rgb( "), (p % 256).cast("string"), F.lit(" ,2, 3)")), F.lit("#12345"), F.lit("currentColor"), F.lit(None).cast("string")]
    return F.element_at(F.array(*options), (p % len(options) + 1).cast("int"))


SVG_LUMA = "CASE p_partkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 170 / 255 WHEN 4 THEN 30 / 255 WHEN 5 THEN greatest(p_partkey % 256, 3) / 255 END::DOUBLE"


@query(f"SELECT p_partkey, {SVG_LUMA} AS luma FROM part")
def fn_svgluma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.svg_luma(_svg_colors()).alias("luma"))


@query(f"SELECT p_partkey, coalesce({SVG_LUMA} <= 0.2::DOUBLE, TRUE) AS black FROM part")
def fn_svgblack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.svg_is_black(_svg_colors(), 0.2).alias("black"))


@query("""SELECT p_partkey, 'c' || p_size AS fill, CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '1' END AS stroke FROM part""")
def fn_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 2 == 0, "; STROKE :2").otherwise("")
    style = F.concat(F.lit("Fill: c"), F.col("p_size").cast("string"), F.lit(" ; junk; stroke:1"), tail)
    props = T.style_properties(style)
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(props, F.lit("fill")).alias("fill"), F.try_element_at(props, F.lit("stroke")).alias("stroke"))


@query(f"WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, {COLOR} AS color FROM e")
def fn_elcolor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.kinds(spark, sf_dir).select("sheet", "ord", C.element_color(F.col("type"), F.col("stroke"), F.col("fill")).alias("color"))


CALLOUT = "'^\\s*(\\d+(?:\\.\\d+)?)\\s*(?:\"|″)?\\s*([@°ØøOoDd6¢]+)\\s*$'"
RAW = """p_size || CASE WHEN p_partkey % 4 = 0 THEN '.5' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '"' ELSE ' ' END || ['@', 'ø', 'O', '6', '°@', 'x', ''][p_partkey % 7 + 1]"""


def _raw_labels() -> "F.Column":
    p = F.col("p_partkey")
    sign = F.element_at(F.array(*[F.lit(x) for x in ("@", "ø", "O", "6", "°@", "x", "")]), (p % 7 + 1).cast("int"))
    return F.concat(F.col("p_size").cast("string"), F.when(p % 4 == 0, ".5").otherwise(""), F.when(p % 3 == 0, '"').otherwise(" "), sign)


DECODE = f"""raw AS (SELECT p_partkey, {RAW} AS raw FROM part), num AS (SELECT *, nullif(regexp_extract(raw, {CALLOUT}, 1), '') AS n FROM raw),
  dec AS (SELECT *, CASE WHEN n::DOUBLE BETWEEN 2 AND 80 THEN n::DOUBLE END AS d FROM num)"""


@query(f"WITH {DECODE} SELECT p_partkey, d, CASE WHEN d IS NOT NULL THEN CASE WHEN contains(n, '.') THEN n ELSE n::BIGINT::VARCHAR END || '\"ø' END AS label FROM dec")
def fn_callout(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_labels()
    return table(spark, sf_dir, "part").select("p_partkey", T.callout_diameter(raw).alias("d"), T.callout_text(raw).alias("label"))


@query(f"WITH {DECODE} SELECT p_partkey, d FROM dec WHERE d IS NOT NULL")
def flt_diam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.callout_diameter(_raw_labels()).alias("d")).where("d is not null")


TOKENS = f"""tok AS (SELECT p_partkey, p_size || CASE WHEN p_partkey % 4 = 0 THEN '.5' ELSE '' END AS num, ['@', 'ø', 'O', '6', '°@', 'x'][p_partkey % 6 + 1] AS sign FROM part),
  parts AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN ['Ø', num || '"' || sign] ELSE [num, '"' || sign] END AS t FROM tok),
  cand AS (SELECT p_partkey, [t[1] || t[2], t[1], t[2]] AS c FROM parts),
  best AS (SELECT p_partkey, list_filter(c, lambda x: coalesce(try_cast(nullif(regexp_extract(x, {CALLOUT}, 1), '') AS DOUBLE) BETWEEN 2 AND 80, FALSE))[1] AS label FROM cand)"""


@query(f"WITH {TOKENS} SELECT p_partkey, label FROM best")
def fn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.tokens(spark, sf_dir).select("p_partkey", T.decode_tokens(F.col("tokens")).alias("label"))


@query("SELECT p_partkey FROM part WHERE least(p_partkey * 3 % 100, p_partkey * 7 % 100) >= 20")
def flt_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.tokens(spark, sf_dir).where(T.min_confidence(F.col("tokens")) >= 20).select("p_partkey")


@query(f"WITH {TOKENS} SELECT best.p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY best.p_partkey) AS place FROM best JOIN part USING (p_partkey) WHERE label IS NOT NULL")
def prj_calloutid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places among the labels that could be decoded."""
    from pyspark.sql.window import Window

    decoded = recipe.tokens(spark, sf_dir).where(T.decode_tokens(F.col("tokens")).isNotNull()).select("p_partkey")
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return decoded.join(brands, "p_partkey").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long").alias("place"))


@query("SELECT p_partkey, round(p_partkey % 5 * 0.06::DOUBLE + 10, 6) AS x0, round(p_partkey % 9 * 0.06::DOUBLE + 20, 6) AS top, round((p_partkey % 5 + 45) * 0.06::DOUBLE + 10, 6) AS x1 FROM part")
def prj_tokbbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.tokens_bbox(F.col("tokens"), F.lit(10.0), F.lit(20.0), 1200)
    return recipe.tokens(spark, sf_dir).select("p_partkey", *[F.round(b[e], 6).alias(e) for e in ("x0", "top", "x1")])


SNAP = """v AS (SELECT p_partkey, p_retailprice / 500 AS s FROM part),
  o AS (SELECT p_partkey, s, r, abs(ln(72 / s / r)) AS err FROM v, (SELECT unnest([192, 96, 64, 48, 32, 24, 16, 12]) AS r)),
  b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY err, r DESC) AS place FROM o)"""


@query(f"WITH {SNAP} SELECT p_partkey, CASE WHEN err < 0.08::DOUBLE THEN r END AS snapped, round(72 / s, 4) AS ratio FROM b WHERE place = 1")
def fn_scalefmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_retailprice") / 500
    best = T.nearest_scale(s)
    shown = F.regexp_extract(T.scale_ratio(s), "^1:(\\d+)$", 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(best["error"] < 0.08, shown.try_cast("int")).alias("snapped"), F.round(72 / s, 4).alias("ratio"))


@query(f"WITH {SNAP} SELECT p_partkey, r AS nearest FROM b WHERE place = 1")
def top_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.nearest_scale(F.col("p_retailprice") / 500)["ratio"].alias("nearest"))


@query("SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5::DOUBLE) / 10) ELSE printf('%.2f MB', floor(n / 1048576 * 100 + 0.5::DOUBLE) / 100) END AS shown FROM (SELECT p_partkey, p_partkey * p_partkey * 8 AS n FROM part)")
def fn_filesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.file_size(F.col("p_partkey") * F.col("p_partkey") * 8).alias("shown"))


@query("SELECT p_partkey, least(greatest(p_size, 10), 40) AS v FROM part")
def fn_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", G.clamp(F.col("p_size"), 10, 40).alias("v"))


@query("SELECT p_partkey, p_size < 5 AS black FROM part")
def fn_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.raster_black(F.col("p_size"), 0.02).alias("black"))


@query("SELECT p_partkey, round(p_retailprice / p_size, 6) AS scale FROM part")
def fn_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.try_divide("p_retailprice", "p_size"), 6).alias("scale"))


@query("SELECT p_partkey, greatest(x0 - 6, 0) AS left_pt, greatest(1224 - (x0 + 300) - 6, 0) AS right_pt, ceil((300 + 12) * 1200 / 72)::BIGINT AS pixels FROM (SELECT p_partkey, (p_partkey * 37 % 4896) * 0.25::DOUBLE AS x0 FROM part)")
def fn_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of a rendered crop, kept on the page, and its width in pixels."""
    x0 = F.col("p_partkey") * 37 % 4896 * 0.25
    left, right = F.greatest(x0 - 6, F.lit(0.0)), F.greatest(1224 - (x0 + 300) - 6, F.lit(0.0))
    return table(spark, sf_dir, "part").select("p_partkey", left.alias("left_pt"), right.alias("right_pt"), F.ceil(F.lit(312.0) * 1200 / 72).alias("pixels"))


@query(f"WITH {rect_cte()}, {kinds_cte()} SELECT sheet, ord, CASE WHEN type = 'word' THEN text END AS own, type <> 'word' AS boxed FROM e")
def prj_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = recipe.kinds(spark, sf_dir).withColumn("shown", T.element_label(F.col("text"), *G.edges()))
    boxed = F.col("shown").startswith("(") & F.col("shown").contains("→")
    return e.select("sheet", "ord", F.when(~boxed, F.col("shown")).alias("own"), boxed.alias("boxed"))


PAINTS = "[NULL, 'none', 'black', '#808080', 'currentColor']"


@query(f"""WITH p AS (SELECT p_partkey, {PAINTS}[p_partkey % 5 + 1] AS f, {PAINTS}[p_partkey // 5 % 5 + 1] AS s FROM part)
  SELECT p_partkey, CASE WHEN coalesce(f, '') = 'none' AND coalesce(s, '') = 'none' OR (f IS NULL AND s IS NULL) THEN 'keep'
    WHEN coalesce(f, '') <> 'black' AND coalesce(s, '') <> 'black' THEN 'drop' WHEN f <> 'black' THEN 'no fill' WHEN s <> 'black' THEN 'no stroke' ELSE 'keep' END AS action FROM p""")
def flt_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    paints = F.array(*[F.lit(x).cast("string") for x in (None, "none", "black", "#808080", "currentColor")])
    at = lambda k: F.element_at(paints, (k % 5 + 1).cast("int"))
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", svg.paint_action(at(p), at(F.floor(p / 5)), 0.02).alias("action"))


#: A page of a group with definitions, a nested group and four drawn nodes whose paints vary.
SVG_PAINTS = ("black", "#808080", "none", "rgb(1, 2, 3)", "#0f0")


def _svg_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    paints = F.array(*[F.lit(x) for x in SVG_PAINTS])
    at = lambda k: F.element_at(paints, (k % 5 + 1).cast("int"))
    p = F.col("p_partkey")
    page = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" xmlns:a="urn:a" width="90" height="90"><defs><path fill="red"/></defs><g id="g1" fill="'),
        at(p),
        F.lit('"><path id="p1" stroke="'),
        at(F.floor(p / 5)),
        F.lit('"/></g><rect id="r1" style="Fill: '),
        at(F.floor(p / 25)),
        F.lit('; opacity:.5" stroke="black"/><a:text id="t1">A &amp; B</a:text>'),
        F.when(p % 11 == 0, F.lit("<broken>")).otherwise(F.lit("")),
        F.lit("</svg>"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", page.alias("page"))


SVG = f"""WITH q AS (SELECT p_partkey, p_partkey % 11 <> 0 AS good, {list(SVG_PAINTS)} AS c FROM part),
  p AS (SELECT p_partkey, good, c[p_partkey % 5 + 1] AS g, c[p_partkey // 5 % 5 + 1] AS s, c[p_partkey // 25 % 5 + 1] AS f FROM q),
  k AS (SELECT *, g IN ('black', 'rgb(1, 2, 3)') AS g_kept, s IN ('black', 'rgb(1, 2, 3)') AS s_black, f IN ('black', 'rgb(1, 2, 3)') AS f_black FROM p)"""


def _filtered(spark: SparkSession, sf_dir: str, crop=None) -> DataFrame:
    return svg.filter_pages(_svg_pages(spark, sf_dir), "page", 0.02, crop)


@query(f"""{SVG} SELECT p_partkey, good, CASE WHEN good THEN 3 + g_kept::INT + (g_kept AND s_black)::INT END::BIGINT AS nodes,
  CASE WHEN good THEN g_kept END AS g1, CASE WHEN good THEN g_kept AND s_black END AS p1 FROM k""")
def geo_svgwalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes left of pages: definitions, the group and the path in it, the rectangle and the text; malformed pages have none."""
    out = F.col("filtered")
    nodes = F.regexp_count(out, F.lit(r"<(defs|g|rect|a:text)\b")) + F.regexp_count(out, F.lit('id="p1"'))
    return _filtered(spark, sf_dir).select("p_partkey", F.col("error").isNull().alias("good"), nodes.cast("long").alias("nodes"), out.contains('id="g1"').alias("g1"), out.contains('id="p1"').alias("p1"))


@query(f"""{SVG} SELECT p_partkey, CASE WHEN good THEN CASE WHEN f_black THEN f ELSE 'none' END END AS fill, CASE WHEN good THEN '.5' END AS opacity, CASE WHEN good THEN 'black' END AS stroke,
  CASE WHEN good THEN 'A & B' END AS text, CASE WHEN good THEN 'http://www.w3.org/2000/svg' END AS namespace FROM k""")
def snk_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered pages: the rectangle's paints, the text, and the namespace of the root."""
    out = F.col("filtered")
    part = lambda r: F.regexp_extract(out, r, 1)
    text = F.regexp_replace(part("<a:text[^>]*>([^<]*)</a:text>"), "&amp;", "&")
    return _filtered(spark, sf_dir).select(
        "p_partkey", part(r'<rect[^>]*style="[Ff]ill: ([^";]*)').alias("fill"), part('<rect[^>]*opacity: ?([^";]*)').alias("opacity"), part('<rect[^>]* stroke="([^"]*)"').alias("stroke"), text.alias("text"), part('<svg[^>]* xmlns="([^"]*)"').alias("namespace")
    )


@query(f"""{SVG} SELECT p_partkey, CASE WHEN good THEN 1234567.25::DOUBLE END AS view_x, CASE WHEN good THEN p_partkey / 8 END AS view_y, CASE WHEN good THEN 10.5::DOUBLE END AS view_w,
  CASE WHEN good THEN 20::DOUBLE END AS view_h, CASE WHEN good THEN 'xMinYMin meet' END AS ratio, CASE WHEN good THEN FALSE END AS sized FROM k""")
def geo_svgbuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut to a crop: the view box in full, how it is fitted, and no size of its own."""
    y = F.col("p_partkey") / 8
    built = _filtered(spark, sf_dir, (F.lit(1234567.25), y, F.lit(1234577.75), y + 20))
    root = F.regexp_extract("filtered", "<svg[^>]*>", 0)
    view = F.split(F.regexp_extract(root, 'viewBox="([^"]*)"', 1), " ")
    numbers = [F.try_element_at(view, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("view_x", "view_y", "view_w", "view_h"), 1)]
    return built.select("p_partkey", *numbers, F.regexp_extract(root, 'preserveAspectRatio="([^"]*)"', 1).alias("ratio"), F.regexp_like(root, F.lit(" (width|height)=")).alias("sized"))
