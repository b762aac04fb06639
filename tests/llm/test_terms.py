"""Term counters and distinctiveness."""

import math

import pytest
from pyspark.sql import functions as F

from termloom.llm import distinct, termfreq

ROWS = [("a", 1, 2), ("a", 1, 3), ("a", 1, 2), ("a", 2, 1), ("b", 1, 4), (None, 1, 9), ("b", 1, 4)]


def test_counters(spark, same):
    post = spark.createDataFrame(ROWS, "term string, doc_id long, freq long").withColumn("salt", F.lit("x")).withColumn("last_seen", F.lit(0))
    terms = spark.createDataFrame([("a",), ("c",), (None,), ("c",)], "term string")
    same(termfreq.term_counters(post, terms), [("a", 4, 2), ("b", 4, 1), ("c", 0, 0)])
    assert termfreq.term_counters(post.limit(0)).count() == 0


def test_hot_term(spark, same):
    post = spark.createDataFrame([("hot", i % 500, 1) for i in range(1000)] + [("rare", 1, 1)], "term string, doc_id long, freq long")
    same(termfreq.term_counters(post, block=16), [("hot", 500, 500), ("rare", 1, 1)])
    same(termfreq.term_counters(post), [("hot", 500, 500), ("rare", 1, 1)])


def test_marks(spark):
    mark = lambda df, n: spark.range(1).select(termfreq.usefulness(F.lit(df), F.lit(n)).alias("m")).first()["m"]
    assert [mark(3, 10), mark(4, 10), mark(7, 10), mark(8, 10), mark(9, 0)] == ["rare", None, None, "common", None]


@pytest.fixture(scope="module")
def tables(spark):
    maps = [(1, {"a": 0.1, "b": 0.2}), (1, {"a": 0.1, "b": 0.2}), (2, {"a": 0.1}), (3, {}), (4, None), (None, {"a": 1.0}), (5, {"gone": 1.0})]
    return spark.createDataFrame(maps, "doc_id long, map map<string,double>"), spark.createDataFrame(ROWS, "term string, doc_id long, freq long")


def test_scores(tables, same):
    vectors, post = tables
    terms = distinct.record_terms(vectors.selectExpr("*", "1 AS term", "2 AS freq"))
    got = distinct.score_terms(terms, post, F.lit(5))
    same(got.select("doc_id", "term", "freq", "df", "weight"), [(1, "a", 3, 2, round(3 * math.log(2.5), 9)), (1, "b", 4, 1, round(4 * math.log(5), 9)), (2, "a", 1, 2, round(math.log(2.5), 9))])
    rate = 4 / 5
    tf = 3 * math.log2(1 + 4 / 7)  # record 1 has 7 of 8 occurrences
    want = (math.log2(1 + rate) + tf * math.log2((1 + rate) / rate)) / (tf + 1)
    scores = {(r["doc_id"], r["term"]): r["score"] for r in got.collect()}
    assert scores[(1, "a")] == pytest.approx(want)
    assert distinct.score_terms(terms.limit(0), post, F.lit(5)).count() == 0
    assert distinct.score_terms(terms, post.limit(0), F.lit(5)).count() == 0
    assert [(r["score"], r["weight"]) for r in distinct.score_terms(terms, post, F.lit(0)).collect()] == [(None, None)] * 3


def test_only_the_weight_reads_no_lengths(tables):
    vectors, post = tables
    scores = distinct.score_terms(distinct.record_terms(vectors), post, F.lit(5))
    plan = distinct.most_distinctive(scores, 3, "weight").select("doc_id", "term")._jdf.queryExecution().optimizedPlan().toString()
    assert "length" not in plan


def test_ties_go_to_the_first_term(spark, same):
    scores = spark.createDataFrame([(1, t, 1.0) for t in ("é", "z", "a", "Z")], "doc_id long, term string, score double")
    same(distinct.most_distinctive(scores).select("term"), [("Z",), ("a",), ("z",)])


def test_centroid_scores(spark):
    counters = spark.createDataFrame([("a", 40, 10), ("b", 4, 1), ("z", 0, 0)], "term string, occurrences long, records long")
    rows = [(1, "a", 0.2), (1, "a", 0.2), (1, "b", 2.0), (2, "a", None), (None, "a", 0.1), (2, "z", 1.0), (2, "gone", 1.0)]
    entries = spark.createDataFrame(rows, "cluster_id long, term string, tf_idf double").selectExpr("*", "1 AS records", "2 AS length")
    got = {(r["cluster_id"], r["term"]): r["score"] for r in distinct.score_centroids(entries, counters, F.lit(20)).collect()}
    assert set(got) == {(1, "a"), (1, "b")} and got[(1, "b")] > got[(1, "a")]
    assert distinct.score_centroids(entries.limit(0), counters, F.lit(20)).count() == 0
