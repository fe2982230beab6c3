"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

All stages but the last return the columns they were given, extra ones included; names
that the operators use themselves may clash. Defined cases: an empty table stays empty at every stage.
Null and empty texts: not toxic, scored for quality by their statistics like any text, near
copies of nothing, taken 0 times by the mix and so gone after it. Null ids: never used in
training, otherwise documents like others. Repeated rows: toxicity and quality treat them
alike, one stays as a near copy of the others, unless they are without words. Null
sources are a source of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plansieve.llm import mixing, ngram_join, packing, quality, toxicity
from plansieve.llm.common import delete, delete_on_exit, shared_dir
from plansieve.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (6): documents that the model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels.where(toxicity.remainder("doc_id", 3) != 1).select("doc_id", "toxic")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (1): documents that it rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.drop_poor(docs, labels.where(toxicity.remainder("doc_id", 5) != 0).select("doc_id", "quality"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (10): one document of each component of near copies (five words, 0.8) stays."""
    return ngram_join.one_of_each(docs, width=5, threshold=(80, 100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (9): each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (5): pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models, hashing and tokenizers have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet to the shared folder and read again.

    A stage's table goes once the next is written, the last when the JVM ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    written = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written:
            delete(spark, written)
        written = path
    return docs
