"""Bag of words, term statistics and the inverted index."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.stem import stem_column
from termloom.functions.text import tokenize
from termloom.operators.order import prior_totals

MIN_DF = 4
MAX_DF_SHARE = 0.7
SMALL_LIST = 100_000


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``term``: a row per token."""
    return docs.select(F.col(key).alias("doc_id"), F.explode(tokenize(F.col(text))).alias("term"))


def term_frequencies(toks: DataFrame) -> DataFrame:
    """``doc_id``, ``term``, ``tf``."""
    return toks.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def english_stopwords(df: DataFrame) -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def without_stopwords(toks: DataFrame, words: list[str] | DataFrame, prefixes: bool = False) -> DataFrame:
    """Tokens that are no stopword, or with ``prefixes`` no non-empty prefix of one. ``words`` is a list, or a table with a
    column ``term`` such as read_stopwords gives. Up to SMALL_LIST words are sent to all executors, more are joined by a
    shuffle."""
    table = words if isinstance(words, DataFrame) else toks.sparkSession.createDataFrame([(w,) for w in words], "term string")
    if prefixes:
        table = table.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.substring("term", F.lit(1), k))).alias("term"))
    table = table.select("term").distinct()
    return toks.join(F.broadcast(table) if table.limit(SMALL_LIST + 1).count() <= SMALL_LIST else table, "term", "left_anti")


def stemmed(tf: DataFrame) -> DataFrame:
    """Frequencies by stem; only distinct terms pass through Python."""
    stems = tf.select("term").distinct().withColumn("stem", stem_column(F.col("term")))
    return tf.join(stems, "term").groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def term_stats(tf: DataFrame) -> DataFrame:
    """``term``, ``df``, ``tfs``, ``tfs_sq``, ``std`` (the root of the sum of squares, uncentred)."""
    agg = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tfs"), F.sum(F.col("tf") * F.col("tf")).alias("tfs_sq"))
    return agg.withColumn("std", F.round(F.sqrt("tfs_sq"), 6))


def doc_magnitudes(tf: DataFrame) -> DataFrame:
    return tf.groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("tf")).alias("mag")).withColumn("sqrt_mag", F.round(F.sqrt("mag"), 6))


def in_vocabulary(df: Column, n: Column, compat: bool = True, least: int = MIN_DF, share: float = MAX_DF_SHARE) -> Column:
    """``compat``: the upper bound by integer division, which only drops terms of every document."""
    return (df >= least) & ((df < n) if compat else (df / n <= share))


def weights(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """``doc_id``, ``term``, ``tf``, ``weight`` = tf / df."""
    return tf.join(stats.select("term", "df"), "term").select("doc_id", "term", "tf", (F.col("tf") / F.col("df")).alias("weight"))


def posting_lists(tf: DataFrame) -> DataFrame:
    """``term``, ``full_rep``: "id,tf|" per document by id. A list holds all documents of its term, as the format has it."""
    entry = F.concat(F.col("doc_id").cast("string"), F.lit(","), F.col("tf").cast("string"), F.lit("|"))
    lists = tf.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("es"))
    return lists.select("term", F.array_join(F.transform("es", lambda e: e["e"]), "").alias("full_rep"))


def prior_sums(tf: DataFrame) -> DataFrame:
    """Sums of each term over the documents before each one."""
    return prior_totals(tf, "term", "doc_id", {"prior_tfs": F.col("tf"), "prior_df": F.lit(1)})


def dimensions(stats: DataFrame, n: int) -> DataFrame:
    """The first ceil(ln n + 1) terms under ln n + 1 documents by 0.6 std + df, each with the next, the last with the
    first. ``stats`` has term, df, std; ties go to the term first in order."""
    import math

    bound = math.log(n) + 1 if n else 0
    score = F.round(0.6 * F.col("std") + F.col("df"), 6)
    top = stats.where(F.col("df") < bound).select("term", score.alias("score")).orderBy(F.desc("score"), "term").limit(math.ceil(bound))
    order = Window.orderBy(F.desc("score"), "term")  # over the limited rows only
    return top.select("term", "score", F.row_number().over(order).cast("int").alias("rank"), F.coalesce(F.lead("term").over(order), F.first("term").over(order)).alias("next_term"))
