"""Whole services over the recipe's objects and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import recipe, services
from .elements import CROPPED, flt_crop
from .registry import LABEL, match_cte, query, scale_cte
from .relations import INKED, KEYS

SCANNED = f"""WITH RECURSIVE {INKED}, bk AS (
    SELECT sheet, CASE WHEN l_linenumber = 2 THEN 0 ELSE 1099511627776 END + ord AS ord, x0, top, x1, bottom, l_partkey FROM inked WHERE shape = 'rect'),
  cand AS (SELECT *, (x0 + x1) * 0.5::DOUBLE AS cx, (top + bottom) * 0.5::DOUBLE AS cy, row_number() OVER (PARTITION BY sheet ORDER BY ord) AS step FROM bk WHERE {LABEL}),
  walk AS (
    SELECT sheet, 0::BIGINT AS step, []::STRUCT(x DOUBLE, y DOUBLE, o BIGINT)[] AS kept FROM (SELECT DISTINCT sheet FROM cand)
    UNION ALL
    SELECT w.sheet, w.step + 1, CASE WHEN len(list_filter(w.kept, lambda k: abs(k.x - c.cx) < 2 AND abs(k.y - c.cy) < 2)) > 0 THEN w.kept ELSE list_append(w.kept, {{'x': c.cx, 'y': c.cy, 'o': c.ord}}) END
    FROM walk w JOIN cand c ON c.sheet = w.sheet AND c.step = w.step + 1),
  ends AS (SELECT sheet, max(step) AS step FROM walk GROUP BY sheet),
  kept AS (SELECT w.sheet, unnest(w.kept).o AS ord FROM walk w JOIN ends e ON w.sheet = e.sheet AND w.step = e.step),
  lab AS (SELECT c.sheet, c.ord, x0, top, x1, bottom, p_size::DOUBLE AS diameter_in FROM cand c JOIN kept k ON c.sheet = k.sheet AND c.ord = k.ord JOIN part ON l_partkey = p_partkey
    WHERE p_size BETWEEN 2 AND 80 AND least(p_partkey * 3 % 100, p_partkey * 7 % 100) >= 20),
  {match_cte(rects="bk")}, {scale_cte()},
  regions AS (SELECT crops.sheet, scale, coalesce(callout_count, 0) AS callout_count, coalesce(rejected, 0) AS rejected FROM crops LEFT JOIN sc ON crops.sheet = sc.sheet)"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.scale_objects(recipe.raw_objects(spark, sf_dir), recipe.crops(spark, sf_dir), lambda boxes: recipe.label_tokens(spark, sf_dir, boxes), KEYS)[1]


@query(f"{SCANNED} SELECT sheet, round(scale, 6) AS scale, callout_count, rejected FROM regions")
def pipe_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of every region: ink, labels, dedupe, reading, join, tiers, aggregate."""
    return _regions(spark, sf_dir).select("sheet", F.round("scale", 6).alias("scale"), "callout_count", "rejected")


@query(f"""{SCANNED}, found AS (SELECT sheet // 1000 AS doc, count(*) AS elements FROM ({CROPPED}) GROUP BY 1)
  SELECT g.doc, regions, coalesce(elements, 0) AS elements, failed FROM (SELECT sheet // 1000 AS doc, count(*) AS regions, min(CASE WHEN scale IS NULL THEN sheet END) AS failed FROM regions GROUP BY 1) g
  LEFT JOIN found ON g.doc = found.doc""")
def pipe_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full runs: the cropped pages' elements, the scales of all regions, and the first region that fails a document."""
    doc = F.floor(F.col("sheet") / 1000)
    return services.run_all(flt_crop(spark, sf_dir).withColumn("doc", doc), _regions(spark, sf_dir).withColumn("doc", doc), ["doc", "sheet"])
