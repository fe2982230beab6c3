"""Extraction: projections of raw objects, ids and crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from ..plans import recipe
from ..sources import sinks
from ..session import table
from .geometry import NEARLY, PARTIAL, SHAPE
from .registry import COLORS, hex_sql, query
from .relations import CROPS

KEYS = ["sheet"]
PAINT = f"""{SHAPE}, c AS (SELECT *, {COLORS} AS ns, CASE WHEN l_orderkey % 5 = 0 THEN {COLORS} END AS s1,
    CASE WHEN l_orderkey % 2 = 0 THEN {COLORS} WHEN l_orderkey % 3 = 0 THEN []::DOUBLE[] END AS s2, CASE WHEN l_partkey % 50 <> 0 THEN x1 END AS right_edge FROM s),
  d AS (SELECT *, CASE WHEN len(s2) > 0 THEN s2 ELSE ns END AS line_color, CASE WHEN len(s1) > 0 THEN s1 ELSE s2 END AS curve_color FROM c)"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_elements(recipe.raw_objects(spark, sf_dir), recipe.sheets(spark, sf_dir), KEYS)


def _of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _elements(spark, sf_dir).where(F.col("type") == kind)


@query(f"WITH {PAINT} SELECT sheet, ord, x0, right_edge AS x1, l_tax * 10 AS linewidth, {hex_sql('line_color')} AS stroke FROM d WHERE l_linenumber = 1")
def prj_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "line").select("sheet", "ord", "x0", "x1", "linewidth", "stroke")


@query(f"WITH {PAINT} SELECT sheet, ord, top, bottom, {hex_sql('ns')} AS fill, {hex_sql('s2')} AS stroke FROM d WHERE l_linenumber = 2")
def prj_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "rect").select("sheet", "ord", "top", "bottom", "fill", "stroke")


@query(f"WITH {PAINT} SELECT sheet, ord, 'T' || l_partkey AS text, 'Sans' AS fontname, l_quantity / 4 AS size, {hex_sql('ns')} AS fill FROM d WHERE l_linenumber = 6")
def prj_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "char").select("sheet", "ord", "text", "fontname", "size", "fill")


@query(f"WITH {PAINT} SELECT sheet, ord, 'T' || l_partkey AS text, x0 FROM d WHERE l_linenumber = 7")
def prj_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "word").select("sheet", "ord", "text", "x0")


TYPED = f"""{PAINT}, t AS (SELECT *, CASE WHEN l_linenumber = 1 THEN 'line' WHEN l_linenumber = 2 THEN 'rect' WHEN l_linenumber = 6 THEN 'char' WHEN l_linenumber = 7 THEN 'word'
  WHEN k IN (0, 1) OR (k = 2 AND {NEARLY}) THEN 'rect_curve' WHEN k = 2 AND {PARTIAL} THEN 'rect_partial' ELSE 'curve' END AS type FROM d),
  n AS (SELECT *, row_number() OVER (PARTITION BY sheet, type ORDER BY ord) AS place FROM t),
  i AS (SELECT *, type || '#' || CASE WHEN type = 'char' THEN format('{{:05d}}', place) ELSE format('{{:04d}}', place) END AS id FROM n)"""


@query(f"WITH {TYPED} SELECT sheet, ord, id FROM i")
def prj_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select("sheet", "ord", "id")


@query(f"""WITH {TYPED} SELECT sheet, ord, id, CASE WHEN type = 'line' THEN {hex_sql('line_color')} WHEN type = 'rect' THEN {hex_sql('s2')} WHEN type IN ('rect_curve', 'rect_partial') THEN {hex_sql('curve_color')} END AS stroke,
  CASE WHEN type IN ('rect', 'char') THEN {hex_sql('ns')} WHEN type IN ('rect_curve', 'rect_partial') AND l_returnflag = 'A' THEN {hex_sql('ns')} END AS fill FROM i""")
def src_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of all pages with their colours."""
    return _elements(spark, sf_dir).select("sheet", "ord", "id", "stroke", "fill")


CROPPED = f"""WITH {TYPED}, {CROPS}, b AS (SELECT i.*, CASE WHEN type = 'rect_partial' THEN px ELSE x0 END AS e0, CASE WHEN type = 'rect_partial' THEN px + w ELSE right_edge END AS e2,
  CASE WHEN type = 'rect_partial' THEN 792 - (py + h) ELSE top END AS e1, CASE WHEN type = 'rect_partial' THEN 792 - py ELSE bottom END AS e3 FROM i)
  SELECT b.sheet, ord, id FROM b JOIN crops c ON b.sheet = c.sheet WHERE NOT (e2 < c0 OR e0 > c0 + 600 OR e3 < c1 OR e1 > c1 + 300)"""


@query(CROPPED)
def flt_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements inside their page's crop; an unknown edge drops one, ids stay as they were. Pages without a crop are left out before anything is classified."""
    crops = recipe.crops(spark, sf_dir)
    wanted = recipe.raw_objects(spark, sf_dir).join(crops.select("sheet"), "sheet", "left_semi")
    elements = extract.page_elements(wanted, extract.pages_with_crops(recipe.sheets(spark, sf_dir), crops, KEYS), KEYS)
    return extract.crop_elements(elements, crops, KEYS).select("sheet", "ord", "id")


@query(f"SELECT sheet, count(*) AS n, min(id) AS first_id FROM ({CROPPED}) GROUP BY sheet")
def pipe_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction with crops, counted per page."""
    return flt_crop(spark, sf_dir).groupBy("sheet").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {TYPED} SELECT sheet // 1000 AS doc, count(DISTINCT sheet) AS page_count, count(*) AS n FROM i GROUP BY sheet // 1000")
def snk_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested JSON, read back for their counts."""
    doc = F.floor(F.col("sheet") / 1000)
    keyed = lambda df: df.withColumn("doc", doc).withColumn("page", F.col("sheet"))
    nested = extract.nested(keyed(_elements(spark, sf_dir)), keyed(recipe.sheets(spark, sf_dir)))
    back = F.from_json("json", "struct<page_count:bigint,pages:array<struct<elements:array<struct<id:string>>>>>")
    read = sinks.documents_json(nested).select("doc", back.alias("j"))
    return read.select("doc", "j.page_count", F.aggregate("j.pages", F.lit(0).cast("long"), lambda a, p: a + F.size(p["elements"])).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS v FROM lineitem")
def prj_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number from text, null where it is none."""
    text = F.when(F.col("l_returnflag") == "N", "n/a").otherwise(F.col("l_quantity").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.try_cast("double").alias("v"))
