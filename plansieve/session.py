"""Session helpers shared by the relational part of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "plansieve", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
