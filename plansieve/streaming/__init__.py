"""Streaming intake of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.intake import upload_error

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_documents(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """New files of a folder as they come, with the ``error`` that keeps one out, if any. Stateless."""
    from pyspark.sql import functions as F

    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).load(path)
    return files.withColumn("error", upload_error(F.col("length"), F.col("content")))
