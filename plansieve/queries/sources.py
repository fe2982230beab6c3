"""Intake, crop requests, page ranges and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_pdf_name
from ..operators import scale
from ..plans import recipe
from ..sources import decoders, intake, sinks
from ..session import table
from .registry import label_cte, match_cte, query, rect_cte, scale_cte


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop requests: two boxes for page 1, one for page 2; some documents ask for nothing."""
    k = F.col("s_suppkey")
    box = lambda x: F.concat(F.lit('{"x0":'), x.cast("string"), F.lit(',"top":1,"x1":900,"bottom":700.5}'))
    item = lambda page, x: F.concat(F.lit(f'{{"page":{page},"bbox":'), box(x), F.lit("}"))
    full = F.concat(F.lit("["), item(1, k % 7), F.lit(","), item(2, k % 5), F.lit(","), item(1, k % 11 + 100), F.lit("]"))
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("doc"), F.when(k % 4 == 0, "[]").when(k % 4 == 1, "").otherwise(full).alias("raw"))


LAST = """SELECT s_suppkey::VARCHAR AS doc, 1::BIGINT AS page, (s_suppkey % 11 + 100)::DOUBLE AS x0, 700.5::DOUBLE AS bottom FROM supplier WHERE s_suppkey % 4 > 1
  UNION ALL SELECT s_suppkey::VARCHAR, 2, (s_suppkey % 5)::DOUBLE, 700.5::DOUBLE FROM supplier WHERE s_suppkey % 4 > 1"""


@query(LAST)
def src_cropjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.parse_crops(_requests(spark, sf_dir)).select("doc", "page", "x0", "bottom")


@query(f"SELECT doc, count(*) AS n, max(x0) AS x0 FROM ({LAST}) GROUP BY doc")
def win_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box a page: the last one asked for."""
    return intake.parse_crops(_requests(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("n"), F.max("x0").alias("x0"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'missing coordinate' WHEN 1 THEN 'empty box' END AS error FROM supplier")
def src_crop1(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, '{"x0":1,"top":2,"x1":3}').when(k == 1, '{"x0":5,"top":2,"x1":5,"bottom":9}').otherwise('{"x0":1,"top":2,"x1":3,"bottom":4}')
    b = intake.parse_box(raw)
    return table(spark, sf_dir, "supplier").select("s_suppkey", intake.box_error(b["x0"], b["top"], b["x1"], b["bottom"]).alias("error"))


@query("SELECT p_partkey, CASE WHEN n > 26214400 THEN 'too large' WHEN p_partkey % 3 = 0 THEN 'not a PDF' END AS error FROM (SELECT p_partkey, p_partkey * 20000 AS n FROM part)")
def src_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("p_partkey") % 3 == 0, F.lit(b"GIF89a")).otherwise(F.lit(b"%PDF-1.7"))
    return table(spark, sf_dir, "part").select("p_partkey", intake.upload_error(F.col("p_partkey") * 20000, content).alias("error"))


@query("SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS taken FROM part")
def src_clientpdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("plan"), F.when(F.col("p_partkey") % 3 == 0, ".PdF").otherwise(".dwg"))
    mime = F.when(F.col("p_partkey") % 5 == 0, "application/pdf")
    return table(spark, sf_dir, "part").select("p_partkey", is_pdf_name(name, mime).alias("taken"))


@query("SELECT s_suppkey AS page FROM supplier WHERE s_suppkey BETWEEN 1 AND 60")
def flt_pagerange(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = table(spark, sf_dir, "supplier").select(F.lit("d").alias("doc"), F.col("s_suppkey").alias("page"))
    return intake.pages_in_range(requested, spark.createDataFrame([("d", 60)], "doc string, page_count int")).select("page")


class RecipeDecoder:
    """Stands in for a PDF library: a document's bytes are the number of its rectangles."""

    def decode(self, content: bytes, pages: list[int] | None):
        for page in (1, 2, 3):
            if pages is None or page in pages:
                for i in range(int(content)):
                    yield {"page": page, "kind": "rect", "ord": i, "x0": 1.0 * i, "top": 0.0, "x1": i + 20.0, "bottom": 9.0}


@query("SELECT s_suppkey::VARCHAR AS doc, page, s_suppkey % 5 + 1 AS n FROM supplier, (SELECT unnest([1::BIGINT, 2]) AS page) WHERE s_suppkey % 4 > 1")
def src_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding through the decoder interface, of cropped pages only."""
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), (F.col("s_suppkey") % 5 + 1).cast("string").cast("binary").alias("content"))
    objects = decoders.decode_documents(docs, RecipeDecoder(), intake.parse_crops(_requests(spark, sf_dir)))
    return objects.groupBy("doc", "page").agg(F.count("*").alias("n"))


class RecipeReader:
    """Stands in for a label reader: reads a box's width as its diameter."""

    def read(self, content: bytes, page: int, box: tuple[float, float, float, float], dpi: int) -> list[dict]:
        width = round(box[2] - box[0])
        return [{"text": f'{width}"@', "conf": 60, "left": 0, "top": 0, "width": 10, "height": 10}]


@query("SELECT s_suppkey::VARCHAR AS doc, (s_suppkey % 90 + 1)::DOUBLE AS d FROM supplier WHERE s_suppkey % 90 + 1 BETWEEN 2 AND 80")
def fn_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels through the reader interface, decoded and gated."""
    from ..functions import text as T

    k = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier")
    docs = supplier.select(k.cast("string").alias("path"), F.lit(b"%PDF").alias("content"))
    boxes = supplier.select(k.cast("string").alias("doc"), F.lit(1).cast("long").alias("page"), k.alias("ord"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), (k % 90 + 1).cast("double").alias("x1"), F.lit(9.0).alias("bottom"))
    tokens = decoders.read_labels(boxes, docs, RecipeReader())
    raw = T.decode_tokens(F.col("tokens"))
    return tokens.where(T.min_confidence(F.col("tokens")) >= 20).select("doc", T.callout_diameter(raw).alias("d")).where("d is not null")


@query(f"WITH {rect_cte()}, {label_cte()}, {match_cte()}, {scale_cte()} SELECT sheet, callout_count, round(scale, 4) AS scale FROM sc")
def snk_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON, read back."""
    matches = scale.match_ducts(recipe.labels(spark, sf_dir), recipe.rectangles(spark, sf_dir), ["sheet"])
    labelled = matches.withColumn("text", F.concat(F.col("diameter_in").cast("long").cast("string"), F.lit('"ø')))
    texts = sinks.scales_json(labelled, scale.page_scales(matches, ["sheet"]), ["sheet"], 1200)
    back = F.from_json("json", "struct<drawing_scale_pts_per_inch:double,callout_count:bigint>")
    return texts.select("sheet", back.alias("j")).select("sheet", "j.callout_count", F.round("j.drawing_scale_pts_per_inch", 4).alias("scale"))
