"""Where the queries find their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardloom.session import guard


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return guard(spark).read.parquet(f"{sf_dir}/{name}.parquet")
