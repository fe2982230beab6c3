"""Helpers shared by the corpus operators: shared storage, Arrow access, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may lack the setting; a temporary folder serves there.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="plansieve-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with an eager, reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _on(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Has a folder go when the JVM ends."""
    where, system = _on(spark, path)
    system.deleteOnExit(where)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    where, system = _on(spark, path)
    system.delete(where, True)


def store(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and returns it as read back.

    The folder goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    delete_on_exit(spark, path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_path = path
    return stored


def discard(stored: DataFrame) -> None:
    """Deletes a table of ``store`` that nothing reads any more."""
    delete(stored.sparkSession, stored.stored_path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value of a string column, without decoding; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """The values of a string column; null is empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Spark send at most ``rows`` rows to Python at a time from now on, as a row may be a long text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that Python objects of few rows live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x
