"""Seeded random columns, vectors and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(low: float, high: float, seed: int) -> Column:
    return F.lit(low) + F.rand(seed) * (high - low)


def gaussian(mean: float, deviation: float, seed: int) -> Column:
    return F.lit(mean) + F.randn(seed) * deviation


def random_matrix(spark: SparkSession, rows: int, columns: int, value: Column) -> DataFrame:
    """Rows ``i``, ``j``, ``v``."""
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).cast("int").alias("j"), value.alias("v"))
