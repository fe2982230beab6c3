"""Files and crop requests: reading, checking and rejecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import EDGES
from ..schema import USUAL

CROP_JSON = "array<struct<page:double,bbox:struct<x0:double,top:double,x1:double,bottom:double>>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents as path, modification time, length and content."""
    return spark.read.format("binaryFile").load(path)


def upload_error(length: Column, content: Column, most: int = USUAL.max_upload) -> Column:
    """Why a document isn't taken, or null."""
    return F.when(length > most, "too large").when(F.coalesce(F.substring(content, 1, 4) != F.lit(b"%PDF"), F.lit(True)), "not a PDF")


def split_uploads(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted documents, and the others with their ``error``."""
    checked = documents.withColumn("error", upload_error(F.col("length"), F.col("content")))
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def box_error(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    """Why a crop box isn't usable, or null."""
    known = x0.isNotNull() & top.isNotNull() & x1.isNotNull() & bottom.isNotNull()
    return F.when(~known, "missing coordinate").when((x1 <= x0) | (bottom <= top), "empty box")


def parse_crops(requests: DataFrame, strict: bool = True) -> DataFrame:
    """Crop boxes (doc, page, edges, error) of JSON arrays in ``raw``.

    A later box for a page replaces an earlier one; null, empty text and an empty
    array are no crop. With ``strict`` an unusable request raises, else its ``error``
    says why.
    """
    wanted = requests.where(F.trim("raw") != "")
    parsed = wanted.withColumn("items", F.from_json("raw", CROP_JSON, {"mode": "PERMISSIVE"}))
    bad = F.col("items").isNull()
    listed = parsed.select("doc", bad.alias("bad"), F.posexplode_outer("items").alias("pos", "item")).where("bad or pos is not null")
    b = [F.col(f"item.bbox.{e}") for e in EDGES]
    error = F.when(F.col("bad"), "not a list").when(F.col("item.page").isNull(), "missing page").otherwise(box_error(*b))
    rows = listed.select("doc", F.col("item.page").cast("long").alias("page"), "pos", *[c.alias(e) for c, e in zip(b, EDGES, strict=True)], error.alias("error"))
    if strict:
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("crop: "), F.col("error")))))
    last = Window.partitionBy("doc", "page").orderBy(F.desc("pos"))
    return rows.withColumn("place", F.row_number().over(last)).where(F.col("error").isNotNull() | (F.col("place") == 1)).drop("place", "pos")


def parse_box(raw: Column) -> Column:
    """One JSON box as a struct."""
    return F.from_json(raw, "struct<x0:double,top:double,x1:double,bottom:double>")


def crops_from_pixels(crops: DataFrame) -> DataFrame:
    """Crops drawn in pixels, brought to points by each page's ``px_per_pt``, in page order."""
    return crops.select("doc", "page", *[(F.col(e) / F.col("px_per_pt")).alias(e) for e in EDGES]).orderBy("doc", "page")


def pages_in_range(requested: DataFrame, page_counts: DataFrame, strict: bool = False) -> DataFrame:
    """Requested pages (doc, page) that exist; the others are dropped, or raise with ``strict``."""
    known = requested.join(page_counts, "doc")
    inside = F.col("page").between(1, F.col("page_count"))
    if strict:
        return known.where(inside | F.raise_error(F.lit("page out of range")).cast("boolean"))
    return known.where(inside)
