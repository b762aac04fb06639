"""The whole index from documents in one job: what the engine serves from, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import cluster, index, similarity

TABLES = ("postings", "term_stats", "docs", "assign", "centroids")


def build_index(docs: DataFrame, folder: str, stopwords: list[str] | None = None, compat: bool = False, k: int = 32, rounds: int | None = None) -> None:
    """Writes postings (with weights, vocabulary only), term_stats, docs (magnitudes over all terms), assign (clusters)
    and centroids under ``folder``. Each table is written once and read by the next step, so nothing is computed twice."""
    spark = docs.sparkSession
    toks = index.tokens(docs)
    if stopwords:
        toks = index.without_stopwords(toks, stopwords)
    index.term_frequencies(toks).write.mode("overwrite").parquet(f"{folder}/tf")
    tf = spark.read.parquet(f"{folder}/tf")
    index.doc_magnitudes(tf).write.mode("overwrite").parquet(f"{folder}/docs")
    n = spark.read.parquet(f"{folder}/docs").count()
    index.term_stats(tf).where(index.in_vocabulary(F.col("df"), F.lit(n), compat)).write.mode("overwrite").parquet(f"{folder}/term_stats")
    stats = spark.read.parquet(f"{folder}/term_stats")
    index.weights(tf, stats).write.mode("overwrite").parquet(f"{folder}/postings")
    rows = spark.read.parquet(f"{folder}/postings").select("doc_id", "term", F.col("weight").alias("w"))
    cluster.k_means(rows, similarity.true_norms(rows), k, rounds=rounds).write.mode("overwrite").parquet(f"{folder}/assign")
    members = spark.read.parquet(f"{folder}/assign").select("cluster_id", "doc_id")
    cluster.centroid_stats(members, rows).drop("shift").write.mode("overwrite").parquet(f"{folder}/centroids")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
