"""The registered queries of the corpus operators, a thin layer over them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, huffman, licenses, media, mixing, ngram_join, packing, quality, quotes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = toxicity.remainder("doc_id", 5)
    scored = quality.score_quality(docs, labels.where(held != 0).select("doc_id", "quality"))
    return scored.select("doc_id", (held == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return huffman.read_blocks(spark, path)


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link_quotations(_table(spark, sf_dir, "conversations"))
    return linked.withColumnRenamed("clean", "text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = toxicity.remainder("doc_id", 3)
    model = toxicity.train(docs, labels.where(held != 1).select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (held == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_sentences", "offending")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(_table(spark, sf_dir, "documents"), width=3, threshold=(90, 100))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_licenses": op2_licenses,
    "op3_huffman": op3_huffman,
    "op4_quotes": op4_quotes,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_media": op7_media,
    "op8_ann": op8_ann,
    "op9_mixing": op9_mixing,
    "op10_jaccard": op10_jaccard,
}

ORACLES: dict[str, str] = {
    "op9_mixing": r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42|' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents
), s1 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), s2 AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight,
         source_size::DOUBLE * 3 AS cap, (sum(source_size) OVER ())::DOUBLE AS budget
  FROM s1
), s3 AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s2
), s4 AS (
  SELECT source, source_size, budget, least(cap, max(share) OVER () * weight) AS target FROM s3
), c1 AS (
  SELECT b.*, s.source_size, s.budget, s.target, sum(size) OVER (PARTITION BY b.source ORDER BY key)::DOUBLE AS within
  FROM base b JOIN s4 s ON b.source IS NOT DISTINCT FROM s.source
), c2 AS (
  SELECT c1.*, e.epoch, (e.epoch * source_size + within) / target AS finish
  FROM c1, (SELECT unnest([0, 1, 2]) AS epoch) e
  WHERE size > 0 AND e.epoch * source_size + within - size < target
), c3 AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, epoch, key) AS running FROM c2
), cuts AS (
  SELECT source, max((epoch, key)) AS last FROM c3 WHERE running <= budget GROUP BY source
)
SELECT c1.doc_id, c1.size, c1.source_size, c1.target,
       (c1.size * CASE WHEN c1.size = 0 OR cuts.last IS NULL THEN 0
                       ELSE cuts.last[1] + CASE WHEN c1.key <= cuts.last[2] THEN 1 ELSE 0 END END)::BIGINT AS taken
FROM c1 LEFT JOIN cuts ON c1.source IS NOT DISTINCT FROM cuts.source
""",
}
