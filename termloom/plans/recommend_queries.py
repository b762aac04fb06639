"""Queries over votes: profiles, words, candidates, fits and cards. Searches take the users whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import dom
from termloom.operators import recommend as rc
from termloom.operators import similarity as sm
from termloom.sources.tables import table


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return rc.latest_votes(table(spark, d, "view_vote"))


def _asked(votes: DataFrame) -> DataFrame:
    return votes.where(F.col("user_id").try_cast("bigint") % 20 == 0)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return sm.vector_rows(table(spark, d, "document_vector"))


def _stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def vote_targets(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d).withColumn("y", rc.vote_target(F.col("vote")))


def preferences(spark: SparkSession, d: str) -> DataFrame:
    """Preference per vote row, and scaled to [-1, 1] within user and sign. A one-row-per-user table joins each vote."""
    users = table(spark, d, "app_user").where("id is not null").groupBy(F.col("id").alias("user_id")).agg(F.max("avvt").alias("avvt"), F.max("avft").alias("avft"))
    votes = table(spark, d, "view_vote").where("user_id is not null and vote between 0 and 5").select("user_id", "page_id", "vote", "page_vote_time", "focus_time", "voted_at").distinct()
    p = rc.preference(F.col("vote"), F.col("page_vote_time"), F.col("focus_time"), F.col("avvt"), F.col("avft"))
    rows = votes.join(users, "user_id").select("user_id", "page_id", "vote", "voted_at", p.alias("p"))
    return rows.withColumn("scaled", F.round(rc.scaled("p"), 6)).withColumn("p", F.round("p", 4))


def user_profiles(spark: SparkSession, d: str) -> DataFrame:
    return rc.profiles(_votes(spark, d), _rows(spark, d)).withColumn("w", F.round("w", 8))


def user_words(spark: SparkSession, d: str) -> DataFrame:
    return rc.best_words(_votes(spark, d), _rows(spark, d)).withColumn("score", F.round("score", 7))


def recommended(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return rc.candidates(_asked(_votes(spark, d)), rows, sm.true_norms(rows)).withColumn("sim", F.round("sim", 7))


def term_cells(spark: SparkSession, d: str) -> DataFrame:
    """The regressors of each user: documents voted on by the user's best words."""
    rows, votes = _rows(spark, d), _votes(spark, d)
    return rc.term_cells(votes, rc.best_words(votes, rows), rows, _stats(rows)).withColumn("x", F.round("x", 4))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    rows, votes = _rows(spark, d), _asked(_votes(spark, d))
    words = rc.best_words(votes, rows)
    beta = rc.fit_words(rc.term_cells(votes, words, rows, _stats(rows)), votes)
    return rc.rerank(rc.candidates(votes, rows, sm.true_norms(rows)), beta, rows)


def recommendation_cards(spark: SparkSession, d: str) -> DataFrame:
    """The five picks of each asked user as one JSON array of cards."""
    picks = reranked(spark, d)
    titles = table(spark, d, "page").select(F.col("id").try_cast("bigint").alias("doc_id"), "page_name").where("doc_id is not null").groupBy("doc_id").agg(F.max("page_name").alias("page_name"))
    shown = dom.cards(table(spark, d, "yomu")).select(F.col("page_id").try_cast("bigint").alias("doc_id"), "image", "intro")
    rows = picks.join(titles, "doc_id", "left").join(shown, "doc_id", "left")
    rows = rows.select("user_id", "place", F.replace(F.coalesce("page_name", F.lit("")), F.lit("&amp;"), F.lit("&")).alias("title"), F.coalesce("image", F.lit("")).alias("image"), F.coalesce("intro", F.lit("No description found.")).alias("descript"))
    return rc.cards_json(rows)


QUERIES = {f.__name__: f for f in (vote_targets, preferences, user_profiles, user_words, recommended, term_cells, reranked, recommendation_cards)}

_V = """v AS (SELECT user_id, doc_id, arg_max(vote, (voted_at, vote)) AS vote FROM (SELECT user_id, TRY_CAST(page_id AS BIGINT) AS doc_id, vote, voted_at FROM view_vote
  WHERE user_id IS NOT NULL AND vote BETWEEN 0 AND 5) WHERE doc_id IS NOT NULL GROUP BY 1, 2),
rows_ AS (SELECT DISTINCT doc_id, e.key AS term, e.value AS w FROM (SELECT doc_id, unnest(map_entries(map)) AS e FROM document_vector WHERE doc_id IS NOT NULL) WHERE e.value IS NOT NULL),
q AS (SELECT * FROM v WHERE TRY_CAST(user_id AS BIGINT) % 20 = 0)"""


def _profile(votes: str) -> str:
    return f"prof AS (SELECT user_id, term, sum(w) / max(n) AS w FROM (SELECT user_id, doc_id, count(*) OVER (PARTITION BY user_id) AS n FROM {votes} WHERE doc_id IN (SELECT doc_id FROM rows_)) k JOIN rows_ USING (doc_id) GROUP BY 1, 2)"


def _words(votes: str) -> str:
    return f"words AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, term) AS INTEGER) AS rank FROM (SELECT user_id, term, round(1 + sum(w), 9) AS score FROM {votes} JOIN rows_ USING (doc_id) GROUP BY 1, 2)) WHERE rank <= 50)"


_SOME = "CASE WHEN coalesce({0}, 0) = 0 THEN 0.1 ELSE {0} END"

ORACLES = {
    "vote_targets": f"WITH {_V} SELECT *, CAST(CASE vote WHEN 0 THEN 1 WHEN 2 THEN -0.1 ELSE vote - 2 END AS DOUBLE) AS y FROM v",
    "preferences": f"""WITH u AS (SELECT id AS user_id, max(avvt) AS avvt, max(avft) AS avft FROM app_user WHERE id IS NOT NULL GROUP BY 1),
r AS (SELECT user_id, page_id, vote, voted_at, CAST((CASE WHEN vote = 3 THEN 3.1::DOUBLE ELSE vote::DOUBLE END - 3) * (({_SOME.format('page_vote_time')}) / ({_SOME.format('avvt')})) * (({_SOME.format('focus_time')}) / ({_SOME.format('avft')})) AS DOUBLE) AS p
  FROM (SELECT DISTINCT user_id, page_id, vote, page_vote_time, focus_time, voted_at FROM view_vote WHERE user_id IS NOT NULL AND vote BETWEEN 0 AND 5) JOIN u USING (user_id))
SELECT user_id, page_id, vote, voted_at, round(p, 4) AS p, round(CASE WHEN m <> 0 THEN p / m END, 6) AS scaled FROM (SELECT *, max(abs(p)) OVER (PARTITION BY user_id, sign(p)) AS m FROM r)""",
    "user_profiles": f"WITH {_V}, {_profile('v')} SELECT user_id, term, round(w, 8) AS w FROM prof",
    "user_words": f"WITH {_V}, {_words('v')} SELECT user_id, term, round(score, 7) AS score, rank FROM words",
    "recommended": f"""WITH {_V}, {_profile('q')}, dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM rows_ GROUP BY 1), un AS (SELECT user_id, sqrt(sum(w * w)) AS n FROM prof GROUP BY 1),
s AS (SELECT user_id, doc_id, round(sum(p.w * r.w) / (max(un.n) * max(dn.n)), 9) AS sim FROM prof p JOIN rows_ r USING (term) JOIN dn USING (doc_id) JOIN un USING (user_id) GROUP BY 1, 2)
SELECT user_id, doc_id, round(sim, 7) AS sim, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, doc_id) AS INTEGER) AS rank FROM s WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.user_id = s.user_id AND q.doc_id = s.doc_id)) WHERE rank <= 5""",
    "term_cells": f"""WITH {_V}, {_words('v')}, df AS (SELECT term, count(*) AS df FROM rows_ GROUP BY 1)
SELECT v.user_id, v.doc_id, words.term, round(CASE WHEN r.w IS NULL THEN 0 WHEN r.w = 0 THEN 0.1 * df ELSE round(r.w * df, 6) END, 4) AS x
FROM v JOIN words USING (user_id) LEFT JOIN rows_ r ON r.doc_id = v.doc_id AND r.term = words.term LEFT JOIN df ON df.term = words.term""",
}
