"""A k-d tree over sparse vectors, as tables: where the splits are, and which leaf each document falls in.

Each level splits by one dimension, the given terms in turn and from the first again, at the median of its node. A node is
the number whose bits after the first are the way down to it, 1 for right. Searches are approximate: they compare a vector
with the documents of the leaves it is nearest to. Documents are added to and taken from the table of points.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.similarity import CHUNK, best_in_groups
from termloom.session import cut

#: Levels at most: the driver and the tasks hold two doubles for each of 65,536 splits.
MOST_LEVELS = 16


@dataclass(frozen=True)
class Tree:
    """``cuts[node]`` is where a node splits (right is what is greater); ``points`` has doc_id and leaf."""

    dims: list[str]
    depth: int
    cuts: np.ndarray
    points: DataFrame


def coordinates(rows: DataFrame, dims: list[str]) -> DataFrame:
    """``doc_id``, ``xs``: the weights of the dimensions, 0 where a document lacks one. ``rows`` has doc_id, term, w."""
    mine = F.when(F.col("term").isin(dims), F.struct("term", "w"))
    found = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(mine)).alias("m"))
    return found.select("doc_id", F.array(*[F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0.0)) for t in dims]).alias("xs"))


def _nodes(xs: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    node = np.ones(len(xs), np.int64)
    for level in range(depth):
        node = 2 * node + (xs[:, level % xs.shape[1]] > cuts[node])
    return node


def _placed(points: DataFrame, cuts: np.ndarray, depth: int) -> DataFrame:
    """``doc_id``, ``leaf``, ``x`` (the coordinate of the next level)."""
    held = points.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                xs = np.stack(pdf["xs"].to_numpy())
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "leaf": _nodes(xs, held.value, depth), "x": xs[:, depth % xs.shape[1]]})

    return points.mapInPandas(run, f"doc_id {points.schema['doc_id'].dataType.simpleString()}, leaf long, x double")


def build(rows: DataFrame, dims: list[str], leaf: int = CHUNK) -> Tree:
    """The tree of the documents of ``rows`` with about ``leaf`` of them in a leaf. Documents that are equal in a dimension
    stay together, so a leaf of documents without any of the dimensions may be fuller: searches cut it into parts."""
    if not dims:
        raise ValueError("a tree needs dimensions")
    points = cut(coordinates(rows, dims))
    n = points.count()
    depth = min(MOST_LEVELS, max(0, math.ceil(math.log2(max(1, n / leaf)))))
    cuts = np.zeros(2 << depth)
    for level in range(depth):
        at = _placed(points, cuts, level)
        for r in at.groupBy("leaf").agg(F.percentile_approx("x", 0.5, 10_000).alias("cut")).collect():  # a row per node
            cuts[r["leaf"]] = r["cut"]
    return Tree(dims, depth, cuts, cut(_placed(points, cuts, depth).drop("x")))


def insert(tree: Tree, rows: DataFrame) -> Tree:
    """With the documents of ``rows``, which must be new; the splits stay."""
    return replace(tree, points=tree.points.union(_placed(coordinates(rows, tree.dims), tree.cuts, tree.depth).drop("x")))


def delete(tree: Tree, docs: DataFrame) -> Tree:
    """Without the documents of ``docs`` (doc_id)."""
    return replace(tree, points=tree.points.join(docs.select("doc_id"), "doc_id", "left_anti"))


def leaves_near(x: np.ndarray, cuts: np.ndarray, depth: int, probes: int) -> list[int]:
    """The ``probes`` leaves nearest to a point, by the distances to the planes crossed on the way, its own first."""
    out: list[int] = []
    heap = [(0.0, 1)]
    while heap and len(out) < probes:
        far, node = heapq.heappop(heap)
        level = node.bit_length() - 1
        while level < depth:
            off = float(x[level % len(x)] - cuts[node])
            heapq.heappush(heap, (math.hypot(far, off), 2 * node + (off <= 0)))
            node, level = 2 * node + (off > 0), level + 1
        out.append(node)
    return out


def search(tree: Tree, vectors: DataFrame, queries: DataFrame, rows: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """``a``, ``b``, ``sim``, ``rank``: the k documents most similar to each of ``queries`` (doc_id), themselves excluded,
    among those of the ``probes`` leaves nearest to it. ``vectors`` is as as_vectors gives it, ``rows`` has their terms;
    queries needn't be in the tree.
    """
    held = vectors.sparkSession.sparkContext.broadcast(tree.cuts)
    depth = tree.depth

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = [leaves_near(x, held.value, depth, probes) for x in pdf["xs"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].repeat([len(v) for v in near]).to_numpy(), "leaf": np.array([n for v in near for n in v], np.int64)})

    kind = vectors.schema["doc_id"].dataType.simpleString()
    asks = cut(coordinates(rows.join(queries, "doc_id", "left_semi"), tree.dims).mapInPandas(run, f"doc_id {kind}, leaf long"))
    return best_in_groups(asks, cut(tree.points), vectors, "leaf", k)
