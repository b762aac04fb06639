"""Queries over words of documents: tokens, statistics, vocabulary, inverted index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import index as ix
from termloom.session import checkpoint_dir
from termloom.sources import formats
from termloom.sources.tables import table
from termloom.streaming import incremental

#: The stopwords of the queries.
STOPWORDS = "a about after all also an and are as at be because been but by can could did do does for from had has have he her him his how i if in into is it its may more no not of on one only or other our out she so some such than that the their them then there these they this to under up was we were what when where which who will with would you your".split()

TOKENS_SQL = """tok AS (SELECT doc_id, t AS term FROM (SELECT doc_id, unnest(string_split(translate(regexp_replace(text, '[^A-Za-z ]', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ')) AS t FROM documents) WHERE t <> '')"""
_TF = TOKENS_SQL + ", tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2)"
_ST = _TF + ", st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tfs, CAST(sum(tf * tf) AS BIGINT) AS tfs_sq FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM tok)"
_STOP = "(VALUES " + ", ".join(f"('{w}')" for w in STOPWORDS) + ") AS s(w)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return ix.tokens(table(spark, d, "documents"))


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return ix.term_frequencies(_tokens(spark, d))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _tf(spark, d)


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return ix.term_stats(_tf(spark, d))


def document_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    return ix.doc_magnitudes(_tf(spark, d))


def _vocabulary(spark: SparkSession, d: str, compat: bool) -> DataFrame:
    tf = _tf(spark, d)
    n = tf.agg(F.countDistinct("doc_id").alias("n")).scalar()
    return ix.term_stats(tf).where(ix.in_vocabulary(F.col("df"), n, compat)).select("term", "df")


def vocabulary_compat(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d, True)


def vocabulary_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d, False)


def term_weights(spark: SparkSession, d: str) -> DataFrame:
    tf = _tf(spark, d)
    out = ix.weights(tf, ix.term_stats(tf).where("df >= 4"))
    return out.withColumn("weight", F.round("weight", 9))


def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return ix.posting_lists(_tf(spark, d))


def stopwords_exact(spark: SparkSession, d: str) -> DataFrame:
    return ix.term_frequencies(ix.without_stopwords(_tokens(spark, d), STOPWORDS))


def stopwords_prefix(spark: SparkSession, d: str) -> DataFrame:
    return ix.term_frequencies(ix.without_stopwords(_tokens(spark, d), STOPWORDS, prefixes=True))


def stems(spark: SparkSession, d: str) -> DataFrame:
    return ix.stemmed(ix.term_frequencies(ix.without_stopwords(_tokens(spark, d), STOPWORDS)))


def prior_term_sums(spark: SparkSession, d: str) -> DataFrame:
    return ix.prior_sums(_tf(spark, d))


def distinct_terms(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("term").distinct()


def split_dimensions(spark: SparkSession, d: str) -> DataFrame:
    tf = _tf(spark, d)
    return ix.dimensions(ix.term_stats(tf), tf.select("doc_id").distinct().count())


def title_lines(spark: SparkSession, d: str) -> DataFrame:
    """The title file's lines, written and read back in one plan."""
    v = table(spark, d, "document_vector").where("doc_id is not null and mag is not null").groupBy("doc_id").agg(F.max("title").alias("title"), F.max("mag").alias("mag"))
    return formats.parse_titles(v.select(formats.title_line(F.col("doc_id"), F.col("title"), F.col("mag")).alias("value")))


def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index as text lines on disk, read back with weights."""
    tf = _tf(spark, d)
    stats = ix.term_stats(tf).where("df >= 4")
    lines = ix.posting_lists(tf).join(stats.select("term", "df"), "term").select(formats.index_line(F.col("term"), F.col("df"), F.col("full_rep")).alias("line"))
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    formats.write_lines(lines, "line", path)
    out = formats.read_index(spark, path)
    return out.select("term", "df", F.col("doc_id").cast("long").alias("doc_id"), "tf", F.round("weight", 9).alias("weight"))


def cluster_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "doc_cluster").where("doc_pos is not null").select("cluster_id", F.coalesce("sqrt_mag", F.lit(0.0)).alias("s"), F.filter("doc_pos", lambda x: x.isNotNull()).alias("ids"))
    lines = c.select(formats.cluster_line(F.col("s"), F.col("ids")).alias("value"))
    return formats.parse_clusters(lines).select(F.round("sqrt_mag", 6).alias("sqrt_mag"), "n", F.array_join("ids", ",").alias("ids"))


def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as a stream into the incremental index; statistics over all batches."""
    docs = table(spark, d, "documents")
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a stream reads folders; a table that is one file is found by its name
    source = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 2)
    inputs = docs.inputFiles()
    folder_in = f"{d}/documents.parquet" if len(inputs) > 1 or "/documents.parquet/" in inputs[0] else d
    stream = (source if folder_in != d else source.option("pathGlobFilter", "documents.parquet")).parquet(folder_in)
    incremental.start_index(stream, folder).awaitTermination()
    return incremental.index_stats(spark, folder)


QUERIES = {f.__name__: f for f in (token_counts, term_frequency, term_statistics, document_magnitudes, vocabulary_compat, vocabulary_ratio, term_weights, posting_lists, stopwords_exact, stopwords_prefix, stems, prior_term_sums, distinct_terms, split_dimensions, title_lines, index_round_trip, cluster_lines, stream_index)}

ORACLES = {
    "token_counts": f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY 1",
    "term_frequency": f"WITH {_TF} SELECT * FROM tf",
    "term_statistics": f"WITH {_ST} SELECT *, round(sqrt(tfs_sq), 6) AS std FROM st",
    "document_magnitudes": f"WITH {_TF} SELECT doc_id, CAST(sum(tf * tf) AS BIGINT) AS mag, round(sqrt(CAST(sum(tf * tf) AS BIGINT)), 6) AS sqrt_mag FROM tf GROUP BY 1",
    "vocabulary_compat": f"WITH {_ST} SELECT term, df FROM st, n WHERE df >= 4 AND df < n",
    "vocabulary_ratio": f"WITH {_ST} SELECT term, df FROM st, n WHERE df >= 4 AND df / n <= 0.7",
    "term_weights": f"WITH {_ST} SELECT doc_id, term, tf, round(tf / df, 9) AS weight FROM tf JOIN st USING (term) WHERE df >= 4",
    "posting_lists": f"WITH {_TF} SELECT term, string_agg(doc_id || ',' || tf || '|', '' ORDER BY doc_id) AS full_rep FROM tf GROUP BY 1",
    "stopwords_exact": f"WITH {_TF} SELECT * FROM tf WHERE term NOT IN (SELECT w FROM {_STOP})",
    "stopwords_prefix": f"WITH {_TF} SELECT * FROM tf WHERE NOT EXISTS (SELECT 1 FROM {_STOP} WHERE starts_with(w, tf.term))",
    "prior_term_sums": f"WITH {_TF} SELECT doc_id, term, tf, CAST(coalesce(sum(tf) OVER w, 0) AS BIGINT) AS prior_tfs, count(*) OVER w AS prior_df FROM tf WINDOW w AS (PARTITION BY term ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "distinct_terms": f"WITH {TOKENS_SQL} SELECT DISTINCT term FROM tok",
    "split_dimensions": f"""WITH {_ST}, s AS (SELECT term, round(0.6 * round(sqrt(tfs_sq), 6) + df, 6) AS score, n FROM st, n WHERE df < ln(n) + 1),
 r AS (SELECT term, score, row_number() OVER (ORDER BY score DESC, term) AS rank, n FROM s)
SELECT term, score, CAST(rank AS INTEGER) AS rank, coalesce(lead(term) OVER (ORDER BY rank), first_value(term) OVER (ORDER BY rank)) AS next_term FROM r WHERE rank <= ceil(ln(n) + 1)""",
    "title_lines": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, array_to_string(list_filter(string_split(coalesce(max(title), ''), ' '), lambda x: x <> ''), ' ') AS title, floor(max(mag)) AS mag FROM document_vector WHERE doc_id IS NOT NULL AND mag IS NOT NULL GROUP BY document_vector.doc_id",
    "index_round_trip": f"WITH {_ST} SELECT term, df, doc_id, tf, round(tf / df, 9) AS weight FROM tf JOIN st USING (term) WHERE df >= 4",
    "cluster_lines": "SELECT round(coalesce(sqrt_mag, 0), 6) AS sqrt_mag, CAST(len(ids) AS INTEGER) AS n, array_to_string(ids, ',') AS ids FROM (SELECT sqrt_mag, list_filter(doc_pos, lambda x: x IS NOT NULL) AS ids FROM doc_cluster WHERE doc_pos IS NOT NULL)",
    "stream_index": f"WITH {_ST} SELECT * FROM st",
}
