"""Frequency of every distinct term over the collection, and in how many records, by last-seen counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_DOCS = 4
MAX_SHARE = 0.7
#: Ids of a block of records. A task gets a term's postings of one block at a time.
BLOCK = 65_536


def first_seen(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per term and record (``term``, ``doc_id``, ``freq``, ``block``), with the largest frequency listed.

    Postings are hash-partitioned by term and block of records, and ordered by record; a posting counts if its record
    isn't the last one seen. So a term needs its counters and one record id, never a set of records; and a term on a third
    of all records has as many parts as they have blocks.
    """
    seen = Window.partitionBy("term", "block").orderBy("doc_id", F.desc("freq"))
    rows = postings.where(F.col("term").isNotNull()).select("term", "doc_id", "freq", F.floor(F.col("doc_id") / block).alias("block"))
    rows = rows.withColumn("last_seen", F.lag("doc_id").over(seen))
    return rows.where(F.col("last_seen").isNull() | (F.col("last_seen") != F.col("doc_id"))).drop("last_seen")


def term_counters(postings: DataFrame, terms: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``term``, ``occurrences``, ``records`` of every term.

    ``postings`` has term, doc_id, freq; rows of the same term and document count once, with the largest frequency. Null
    terms are no terms. Terms of ``terms`` (column ``term``) without postings come out with zeros.
    """
    parts = first_seen(postings, block).groupBy("term", "block").agg(F.sum("freq").alias("occurrences"), F.count("*").alias("records")).drop("block")
    if terms is not None:
        none = terms.where(F.col("term").isNotNull()).select("term", F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("records"))
        parts = parts.unionByName(none)
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def usefulness(records: Column, collection: Column, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> Column:
    """'rare', 'common', or null for a useful term; an empty collection makes no term common."""
    return F.when(records < min_docs, "rare").when(records > max_share * F.nullif(collection, F.lit(0)), "common")
