"""Salted grouping: a key that holds a third of all rows is split by a second key and joined back by parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a key. A key of a third of all rows gives parts of a fiftieth of them.
SALTS = 16


def salt_of(column: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(salts)).cast("int")


def with_key_totals(rows: DataFrame, key: str, by: str, totals: dict[str, Column], salts: int = SALTS) -> DataFrame:
    """``rows`` with the sums ``totals`` over each ``key`` as further columns; no task gets more than a part of a key.

    A row counts for the part that ``by`` gives. Each part is summed where it lies, the sums of a key's parts (``salts``
    at most) are added in a window over those few rows, and join the part's rows by key and part.
    """
    parts = rows.withColumn("__salt", salt_of(by, salts))
    small = parts.groupBy(key, "__salt").agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    whole = Window.partitionBy(key)
    small = small.select(F.col(key).alias("__key"), F.col("__salt").alias("__part"), *[F.sum(n).over(whole).alias(n) for n in totals])
    joined = parts.join(small, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__part")))
    return joined.drop("__salt", "__key", "__part")


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count: str, share: int = 16_384) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once, with the number of its rows of ``left`` in the
    column ``count``.

    Keys of over 1/``share`` of all rows, ``share`` keys at most, go to the rows of ``left`` by broadcast; the others
    are joined by a shuffle, in which none of them is too many for a task. Both sides are read twice.
    """
    total = right.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = F.broadcast(right.where(F.col(count) > total / share).limit(share))
    rest = left.join(hot.select(*on), on, "left_anti").join(right.where(F.col(count) <= total / share), on)
    return left.join(hot, on).unionByName(rest)
