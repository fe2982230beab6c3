"""Nested results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents_json(nested: DataFrame, doc: str = "doc") -> DataFrame:
    """A JSON text per document: filename, page_count and pages."""
    return nested.select(doc, F.to_json(F.struct(F.col(doc).alias("filename"), "page_count", "pages")).alias("json"))


def scales_json(callouts: DataFrame, scales: DataFrame, keys: list[str], dpi: int) -> DataFrame:
    """A JSON text per page: callouts in order, the scale and their number."""
    item = F.struct("ord", "text", "diameter_in", "drawn_pts", "pts_per_inch")
    lists = callouts.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("callouts"))
    body = F.struct(F.lit(dpi).alias("dpi"), F.col("scale").alias("drawing_scale_pts_per_inch"), "callout_count", "callouts")
    return scales.join(lists, keys, "left").select(*keys, F.to_json(body).alias("json"))


def write_json(texts: DataFrame, path: str) -> None:
    """Writes JSON texts, one a line."""
    texts.select(F.col("json").alias("value")).write.text(path)
