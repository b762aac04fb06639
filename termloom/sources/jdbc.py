"""Tables of a database, read in parallel; filters and column choice go to the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, name: str, split_by: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """``split_by`` with its range parts the scan; the driver of the database must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if split_by:
        reader = reader.option("partitionColumn", split_by).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()
