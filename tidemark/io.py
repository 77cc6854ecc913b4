"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a timestamp that watermarks accept."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a date."""
    return table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
