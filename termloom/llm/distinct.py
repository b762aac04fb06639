"""How distinctive a term is for a record: divergence from randomness.

A score is (information content of the frequency under a model of the collection) times (gain of the after-effect), on
a frequency that may be normalised by the record's length. Each of the three can be chosen; the defaults are the
geometric model, Laplace's after-effect and normalisation 2. ``information="idf"`` without after-effect and
normalisation is the degenerate member of the family: freq x ln(N / df).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.skew import join_hot
from termloom.session import cut


def dfr_score(freq: Column, df: Column, occurrences: Column, n: Column, length: Column | None = None, mean_length: Column | None = None,
              information: str = "geometric", after_effect: str = "laplace", c: float = 1.0) -> Column:
    """The score of one term in one record, null where the collection or the term is empty."""
    tf = freq.cast("double")
    if length is not None:
        tf = tf * F.log2(F.lit(1.0) + c * F.try_divide(mean_length, length))
    if information == "geometric":
        rate = F.try_divide(occurrences.cast("double"), n.cast("double"))
        content = F.log2(1 + rate) + tf * F.log2(F.try_divide(1 + rate, rate))
    elif information == "idf":
        content = tf * F.ln(F.try_divide(n.cast("double"), df.cast("double")))
    else:
        raise ValueError(information)
    if after_effect == "laplace":
        return content / (tf + 1)
    if after_effect == "none":
        return content
    raise ValueError(after_effect)


def record_terms(vectors: DataFrame, record: str = "doc_id", column: str = "map") -> DataFrame:
    """``doc_id``, ``term`` of each record's map; null and empty maps have none. Repeated rows come as often as they are
    written."""
    return vectors.where(F.col(record).isNotNull()).select(F.col(record).alias("doc_id"), F.explode(F.map_keys(F.col(column))).alias("term"))


def score_terms(terms: DataFrame, postings: DataFrame, n: Column) -> DataFrame:
    """``doc_id``, ``term``, ``freq``, ``df``, ``score`` and ``weight`` of the record terms that the postings list.

    ``terms`` has doc_id and term, ``postings`` term, doc_id and freq; what is repeated on either side counts once, with
    the largest frequency. ``score`` is the geometric model's with Laplace's after-effect and length normalisation,
    ``weight`` the family's degenerate member freq x ln(N / df), both rounded to 9 decimals.

    Postings and terms are brought together by term and record in one shuffle, where no key is hot, and written; term
    totals and lengths are sums over that table, and the totals of frequent terms are joined by broadcast.
    """
    listed = postings.where(F.col("term").isNotNull()).select("term", F.col("doc_id").cast("long").alias("doc_id"), F.col("freq").cast("long").alias("freq"), F.lit(False).alias("asked"))
    asked = terms.select("term", F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("freq"), F.lit(True).alias("asked"))
    cells = listed.unionByName(asked).groupBy("term", "doc_id").agg(F.max("freq").alias("freq"), F.max("asked").alias("asked"))
    cells = cut(cells.where("freq is not null"))
    totals = cut(cells.groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("occurrences")))
    lengths = cells.groupBy("doc_id").agg(F.sum("freq").cast("double").alias("length"))
    mean = lengths.agg(F.avg("length")).scalar()
    # a left join, as every record of a cell has a length: it goes where only the weight is read
    rows = join_hot(cells.where("asked").select("term", "doc_id", "freq"), totals, ["term"], "df").join(lengths, "doc_id", "left")
    score = dfr_score(F.col("freq"), F.col("df"), F.col("occurrences"), n, F.col("length"), mean)
    weight = dfr_score(F.col("freq"), F.col("df"), F.col("occurrences"), n, information="idf", after_effect="none")
    return rows.select("doc_id", "term", "freq", "df", F.round(score, 9).alias("score"), F.round(weight, 9).alias("weight"))


def score_centroids(entries: DataFrame, counters: DataFrame, n: Column, c: float = 1.0) -> DataFrame:
    """``cluster_id``, ``term``, ``score`` of centroid entries (cluster_id, term, tf_idf) under the geometric model.

    An entry's frequency is its mean weight times the term's document frequency, which is the mean frequency of the
    cluster's members. ``counters`` has term, occurrences, records. Entries that are null or of unknown terms have no
    score; repeated entries count once.
    """
    rows = entries.select("cluster_id", "term", "tf_idf").where("cluster_id is not null and tf_idf is not null").distinct()
    rows = join_hot(rows, cut(counters.where("records > 0")), ["term"], "records").withColumn("freq", F.col("tf_idf") * F.col("records"))
    lengths = rows.groupBy("cluster_id").agg(F.sum("freq").alias("length"))
    score = dfr_score(F.col("freq"), F.col("records"), F.col("occurrences"), n, F.col("length"), lengths.agg(F.avg("length")).scalar(), c=c)
    return rows.join(lengths, "cluster_id").select("cluster_id", "term", F.round(score, 7).alias("score"))


def most_distinctive(scores: DataFrame, k: int = 3, by: str = "score") -> DataFrame:
    """The k terms of each record with the highest score (or weight), ties to the term first in code point order."""
    ranked = Window.partitionBy("doc_id").orderBy(F.desc(by), "term")
    return scores.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
