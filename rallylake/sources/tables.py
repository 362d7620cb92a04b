"""Table access: every query reads its Parquet tables through here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory; filters and column lists reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views of the same names."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
