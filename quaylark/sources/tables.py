"""The test tables, and losses made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def losses(spark: SparkSession, sf_dir: str, iterations: int = 100) -> DataFrame:
    """(iteration, day, seq, id, amount) from orders; seq is unique and breaks ties of a day."""
    o = load(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % iterations + 1).cast("int").alias("iteration"), F.dayofyear("o_orderdate").alias("day"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
