"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import clusters, distinct, leakage, markup, mojibake, similar, termfreq, tokenids
from termloom.operators.packed import unpack_postings
from termloom.sources.tables import table


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return unpack_postings(table(spark, d, "term_freq_rep"), "full_rep", ["term"]).drop("pos")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_vector").agg(F.countDistinct("doc_id").alias("n"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.most_similar(table(spark, d, "document_vector"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_elements(table(spark, d, "yomu"), "node_id", "data", "tag")


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_column(table(spark, d, "yomu"), "node_id", "data", "tag").select("node_id", "text")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    counted = termfreq.term_counters(_postings(spark, d), table(spark, d, "term_freq_rep").select("term"))
    return counted.withColumn("mark", termfreq.usefulness(F.col("records"), _pages(spark, d).scalar()))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("mark is not null").select("term", "mark")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    terms = distinct.record_terms(table(spark, d, "document_vector"))
    return distinct.score_terms(terms, _postings(spark, d), _pages(spark, d).scalar())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The ranking asked for is the family's degenerate member, the weight."""
    return distinct.most_distinctive(_scores(spark, d), 3, "weight").select("doc_id", "term")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).drop("weight")


def p5_centroids(spark: SparkSession, d: str) -> DataFrame:
    counted = termfreq.term_counters(_postings(spark, d))
    return distinct.score_centroids(table(spark, d, "hashmap_data"), counted, _pages(spark, d).scalar())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(table(spark, d, "document_vector"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each group."""
    vectors = table(spark, d, "document_vector")
    return clusters.describe(vectors, clusters.clusters(vectors))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenids.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), "doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many texts."""
    leaks = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), "doc_id", "item_id")
    return leaks.groupBy("item_id").agg(F.count("*").alias("texts"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_text(spark, d).where("garbled").select("doc_id")


def p9_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text, restored where it was garbled."""
    return mojibake.repair(table(spark, d, "documents"), "doc_id", "text", "lang")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_text, p3_found, p3_terms, p5_found, p5_scores, p5_centroids, p6_found, p6_clusters, p7_ids, p8_found, p8_items, p9_found, p9_text)}
