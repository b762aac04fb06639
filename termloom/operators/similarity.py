"""Sparse similarity, nearest neighbours and ranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.order import global_rank
from termloom.session import cut

#: Documents and queries that meet in a task.
CHUNK, BLOCK = 4096, 512


def vector_rows(vectors: DataFrame, key: str = "doc_id", column: str = "map") -> DataFrame:
    """``doc_id``, ``term``, ``w`` of a table of maps, repeated rows once."""
    return vectors.select(F.col(key).alias("doc_id"), F.explode(column).alias("term", "w")).where("doc_id is not null and w is not null").dropDuplicates(["doc_id", "term"])


def stored_norms(vectors: DataFrame) -> DataFrame:
    """``doc_id``, ``norm`` = root of the stored magnitude; null where it is missing or zero."""
    return vectors.where("doc_id is not null").groupBy("doc_id").agg(F.sqrt(F.nullif(F.max("mag"), F.lit(0.0))).alias("norm"))


def true_norms(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cosines(left: DataFrame, right: DataFrame, left_norms: DataFrame, right_norms: DataFrame) -> DataFrame:
    """``a``, ``b``, ``sim`` of all pairs with a common term; each side has doc_id, term, w. An absent term counts 0, so
    the join is inner; a pair without a norm has no similarity and is left out. For sides of few rows: a term costs the
    product of its rows on both; ``best_matches`` doesn't."""
    a = left.select(F.col("doc_id").alias("a"), "term", F.col("w").alias("wa"))
    b = right.select(F.col("doc_id").alias("b"), "term", F.col("w").alias("wb"))
    dots = a.join(b, "term").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    dots = dots.join(left_norms.select(F.col("doc_id").alias("a"), F.col("norm").alias("na")), "a")
    dots = dots.join(right_norms.select(F.col("doc_id").alias("b"), F.col("norm").alias("nb")), "b")
    return dots.select("a", "b", F.round(F.try_divide("dot", F.col("na") * F.col("nb")), 9).alias("sim")).where("sim is not null")


def top_k(sims: DataFrame, k: int, by: str = "a", other: str = "b") -> DataFrame:
    """The k most similar of each, ties to the smaller id; ``rank`` from 1."""
    order = Window.partitionBy(by).orderBy(F.desc("sim"), other)
    return sims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_vectors(rows: DataFrame, norms: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``norm``, ``ts`` (hashes of terms), ``ws``: one row per vector with a norm, as a written table. A vector has
    at most as many entries as there are terms."""
    some = rows.join(norms.where("norm is not null and norm != 0"), key).select(key, F.xxhash64("term").alias("t"), "w", "norm")
    return cut(some.groupBy(key).agg(F.first("norm").alias("norm"), F.collect_list("t").alias("ts"), F.collect_list("w").alias("ws")))


def best_matches(asks: DataFrame, docs: DataFrame, k: int, ask: str = "doc_id", doc: str = "doc_id", zeros: bool = False, others: bool = False) -> DataFrame:
    """The k most similar of ``docs`` for each of ``asks``, both as as_vectors gives them: ``a``, ``b``, ``sim``, ``rank``,
    ties to the smaller ``b``. With ``zeros`` those without a common term count too, with ``others`` none is its own.

    Blocks of asking vectors meet chunks of documents, and only k rows a vector leave each meeting: a term on most
    documents costs arithmetic, never a row per pair.
    """
    chunks, blocks = -(-docs.count() // CHUNK) or 1, -(-asks.count() // BLOCK) or 1
    spot = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    left = docs.select(F.col(doc).alias("key"), "norm", "ts", "ws", spot(doc, chunks, 1).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asks.select(F.col(ask).alias("key"), "norm", "ts", "ws", spot(ask, blocks, 2).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    right = right.toDF(*right.columns)  # columns of its own: both sides may come from one table
    return top_k(meet(left, right, ["chunk", "block"], k, zeros, others), k)


def meet(left: DataFrame, right: DataFrame, on: list[str], k: int, zeros: bool = False, others: bool = False) -> DataFrame:
    """Of each group of ``on`` the k best vectors of ``left`` for each of ``right``: ``a``, ``b``, ``sim``. Both have key,
    norm, ts, ws; a group of either side must fit a task."""
    kinds = f"a {right.schema['key'].dataType.simpleString()}, b {left.schema['key'].dataType.simpleString()}, sim double"

    def best(docs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(asks):
            return pd.DataFrame({"a": asks["key"][:0], "b": docs["key"][:0], "sim": np.zeros(0)})
        docs, asks = docs.sort_values("key"), asks.sort_values("key")
        dots = np.zeros((len(asks), len(docs)))
        mine, theirs = by_term(asks), by_term(docs)
        for t in mine.keys() & theirs.keys():
            (i, x), (j, y) = mine[t], theirs[t]
            dots[i[:, None], j[None]] += x[:, None] * y[None]
        sims = np.round(dots / (asks["norm"].to_numpy()[:, None] * docs["norm"].to_numpy()[None]), 9)
        a, b = asks["key"].to_numpy(), docs["key"].to_numpy()
        if not zeros:
            sims[dots == 0] = -np.inf
        if others:
            sims[a[:, None] == b[None]] = -np.inf
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(sims, top, 1)
        i, j = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"a": a[i], "b": b[top[i, j]], "sim": best[i, j]})

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(best, kinds)


def best_in_groups(asks: DataFrame, members: DataFrame, vectors: DataFrame, group: str, k: int) -> DataFrame:
    """``a``, ``b``, ``sim``, ``rank``: the k most similar documents of each asking document's groups, itself excluded.
    ``asks`` and ``members`` have doc_id and ``group``, ``vectors`` is as as_vectors gives it.

    A group over CHUNK members is cut into parts, and those that ask in it into blocks: no task gets more than one of each.
    """
    count = lambda side, size, name: side.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = count(members, CHUNK, "parts").join(count(asks, BLOCK, "blocks"), group)
    spot = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda side: side.join(vectors, "doc_id").withColumnRenamed("doc_id", "key").select(group, "part", "block", "key", "norm", "ts", "ws")
    left = some(members.join(sizes, group).withColumn("part", spot("parts", 1)).withColumn("block", each("blocks")))
    right = some(asks.join(sizes, group).withColumn("block", spot("blocks", 2)).withColumn("part", each("parts")))
    right = right.toDF(*right.columns)
    return top_k(meet(left, right, [group, "part", "block"], k, others=True), k)


def best_unseen(asks: DataFrame, docs: DataFrame, k: int, seen_of: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """As best_matches, without the pairs (a, b) that ``seen_of`` gives of those it is asked about.

    More than k are sought, and those seen left out; vectors that too few remain of are asked again for more, until they
    have k or nothing is left: what is seen is looked up for the pairs found, never listed for all.
    """
    key = how.get("ask", "doc_id")
    more, out = 4 * k, None
    while True:
        found = cut(best_matches(asks, docs, more, **how))
        kept = found.join(seen_of(found.select("a", "b")), ["a", "b"], "left_anti")
        state = found.groupBy("a").agg(F.count("*").alias("n")).join(kept.groupBy("a").agg(F.count("*").alias("kept")), "a", "left")
        short = cut(state.where((F.col("n") == more) & (F.coalesce("kept", F.lit(0)) < k)).select("a"))
        done = top_k(kept.join(short, "a", "left_anti").select("a", "b", "sim"), k)
        out = done if out is None else out.union(done)
        if not short.limit(1).count():
            return out
        asks, more = asks.join(short.withColumnRenamed("a", key), key, "left_semi"), 8 * more


def nearest(rows: DataFrame, norms: DataFrame, queries: DataFrame, k: int, seen_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k nearest documents of each query document, itself and the pairs that ``seen_of`` gives excluded; ``a``, ``b``,
    ``sim``, ``rank``."""
    docs = as_vectors(rows, norms)
    asks = docs.join(queries, "doc_id", "left_semi")
    return best_unseen(asks, docs, k, seen_of, others=True) if seen_of else best_matches(asks, docs, k, others=True)


def by_term(vectors: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and weights of each term."""
    count = vectors["ts"].map(len).to_numpy()
    row, term, w = np.repeat(np.arange(len(vectors)), count), np.concatenate(vectors["ts"].to_numpy()), np.concatenate(vectors["ws"].to_numpy())
    order = np.argsort(term, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(term[order]) != 0, True])
    return {int(term[order[s]]): (row[order[s:e]], w[order[s:e]]) for s, e in zip(edges[:-1], edges[1:])}


def by_dimension(rows: DataFrame, docs: DataFrame, term: str) -> DataFrame:
    """Documents by their weight of one term, ascending, those without it last."""
    found = docs.join(rows.where(F.col("term") == term), "doc_id", "left").select("doc_id", "w")
    return global_rank(found, [F.asc_nulls_last("w"), F.asc("doc_id")])
