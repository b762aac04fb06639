"""Global order without a single task: ranks and running sums in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import cut


def global_rank(df: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """``name``: 1, 2, ... over all rows in the order given, which should have no ties.

    Rows are range-partitioned by the order and written once, so that a part keeps its rows; each part ranks its own and
    adds the number of rows of the parts before it. The driver plans over as many counts as there are parts.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per part
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + own).drop("__part", "__start")


def prior_totals(df: DataFrame, key: str, order: str, totals: dict[str, Column], block: int = 65_536) -> DataFrame:
    """``totals`` summed over the rows of the same key with a smaller ``order`` (a bigint, once per key).

    A key's rows are cut into blocks of ``order``: sums run within a block, and over a key's blocks, so a key with a
    third of all rows spreads over as many tasks as it has blocks.
    """
    rows = df.withColumn("__block", F.floor(F.col(order) / block))
    blocks = rows.groupBy(key, "__block").agg(*[F.sum(c).alias(f"__{n}") for n, c in totals.items()])
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(key).alias("__key"), F.col("__block").alias("__at"), *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in totals])
    inside = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in totals.items()])
    out = rows.join(blocks, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__at")))
    return out.select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in totals])
