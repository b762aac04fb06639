"""User profiles and recommendations for all asked users in one plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.similarity import as_vectors, best_unseen
from termloom.operators.skew import SALTS, salt_of


def vote_target(vote: Column) -> Column:
    return F.when(vote == 0, 1.0).when(vote == 2, -0.1).otherwise(vote - 2.0)


def preference(vote: Column, vote_time: Column, focus: Column, avvt: Column, avft: Column) -> Column:
    """Signed strength of a vote; zero and missing times count 0.1."""
    some = lambda c: F.when(c == 0, 0.1).otherwise(F.coalesce(c, F.lit(0.1)))
    v = F.when(vote == 3, 3.1).otherwise(vote.cast("double")) - 3
    return v * (some(vote_time) / some(avvt)) * (some(focus) / some(avft))


def scaled(value: str, user: str = "user_id") -> Column:
    """To [-1, 1] within each user and sign."""
    sign = F.signum(F.col(value))
    return F.try_divide(F.col(value), F.max(F.abs(F.col(value))).over(Window.partitionBy(user, sign)))


def latest_votes(votes: DataFrame) -> DataFrame:
    """``user_id``, ``doc_id``, ``vote``: the last vote in range of each user and page."""
    ok = votes.where("user_id is not null and vote between 0 and 5").select("user_id", F.col("page_id").try_cast("bigint").alias("doc_id"), "vote", "voted_at").where("doc_id is not null")
    last = ok.groupBy("user_id", "doc_id").agg(F.max(F.struct("voted_at", "vote")).alias("m"))
    return last.select("user_id", "doc_id", F.col("m.vote").alias("vote"))


def profiles(votes: DataFrame, rows: DataFrame) -> DataFrame:
    """``user_id``, ``term``, ``w``: the mean vector of the documents a user voted on."""
    known = votes.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    n = known.groupBy("user_id").agg(F.count("*").alias("n"))
    total = known.join(rows, "doc_id").groupBy("user_id", "term").agg(F.sum("w").alias("total"))
    return total.join(n, "user_id").select("user_id", "term", (F.col("total") / F.col("n")).alias("w"))


def best_words(votes: DataFrame, rows: DataFrame, k: int = 50) -> DataFrame:
    """The k terms of each user with the highest 1 + sum of weights."""
    score = votes.join(rows, "doc_id").groupBy("user_id", "term").agg(F.round(1 + F.sum("w"), 9).alias("score"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "term")
    return score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidates(votes: DataFrame, rows: DataFrame, norms: DataFrame, k: int = 5) -> DataFrame:
    """``user_id``, ``doc_id``, ``sim``, ``rank``: the k documents most similar to a user's profile, voted ones excluded."""
    profile = profiles(votes, rows)
    lengths = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asks, docs = as_vectors(profile, lengths, "user_id"), as_vectors(rows, norms)
    voted = votes.select(F.col("user_id").alias("a"), F.col("doc_id").alias("b"))
    found = best_unseen(asks, docs, k, lambda pairs: voted.join(pairs, ["a", "b"], "left_semi"), ask="user_id")
    return found.select(F.col("a").alias("user_id"), F.col("b").alias("doc_id"), "sim", "rank")


def term_cells(votes: DataFrame, words: DataFrame, rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``user_id``, ``doc_id``, ``term``, ``x``: weight x df of each voted document and word of the user, 0 if absent."""
    grid = votes.select("user_id", "doc_id").join(words.select("user_id", "term"), "user_id")
    cells = grid.join(rows, ["doc_id", "term"], "left").join(stats.select("term", "df"), "term", "left")
    x = F.when(F.col("w").isNull(), 0.0).when(F.col("w") == 0, 0.1 * F.col("df")).otherwise(F.round(F.col("w") * F.col("df"), 6))
    return cells.select("user_id", "doc_id", "term", x.alias("x"))


def fit_words(cells: DataFrame, votes: DataFrame, parts: int = SALTS) -> DataFrame:
    """``user_id``, ``term``, ``beta`` by least squares without intercept; none where a user's votes don't determine the
    words' coefficients.

    A user's votes are reduced in ``parts`` to the 50 x 50 products of their word columns, which are added and solved: a
    user with any share of the votes costs no task more than a part of them.
    """

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="doc_id", columns="term", values="x", aggfunc="first").fillna(0.0).sort_index(axis=1)
        y = pdf.groupby("doc_id")["y"].first().loc[x.index].to_numpy()
        m = x.to_numpy()
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "terms": [list(x.columns)], "xx": [(m.T @ m).ravel()], "xy": [m.T @ y]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        terms = pdf["terms"].iloc[0]  # every part has every word of the user
        xx = np.sum(np.stack(pdf["xx"].to_numpy()), axis=0).reshape(len(terms), len(terms))
        size = np.linalg.eigvalsh(xx)
        if size[0] <= 1e-10 * max(size[-1], 1e-300):
            return pd.DataFrame({"user_id": pd.Series(dtype=str), "term": pd.Series(dtype=str), "beta": pd.Series(dtype=float)})
        beta = np.linalg.solve(xx, np.sum(np.stack(pdf["xy"].to_numpy()), axis=0))
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "term": list(terms), "beta": beta})

    target = votes.select("user_id", "doc_id", vote_target(F.col("vote")).alias("y"))
    rows = cells.join(target, ["user_id", "doc_id"]).withColumn("part", salt_of("doc_id", parts))
    some = rows.groupBy("user_id", "part").applyInPandas(products, "user_id string, terms array<string>, xx array<double>, xy array<double>")
    return some.groupBy("user_id").applyInPandas(solve, "user_id string, term string, beta double")


def rerank(found: DataFrame, beta: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates by their score under the user's fit; users without one keep the order by similarity."""
    score = found.join(beta, "user_id").join(rows, ["doc_id", "term"], "left").groupBy("user_id", "doc_id").agg(F.sum(F.col("beta") * F.coalesce("w", F.lit(0.0))).alias("score"))
    out = found.join(score, ["user_id", "doc_id"], "left")
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("score"), "rank")
    return out.withColumn("place", F.row_number().over(order)).select("user_id", "doc_id", "sim", "score", "place")


def cards_json(cards: DataFrame) -> DataFrame:
    """``user_id``, ``cards``: a JSON array of title, image, descript in order of place."""
    one = F.struct("place", F.struct(F.col("title"), F.col("image"), F.col("descript")).alias("card"))
    lists = cards.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("es"))
    return lists.select("user_id", F.to_json(F.transform("es", lambda e: e["card"])).alias("cards"))
