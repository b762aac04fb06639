"""Grouping records into similarity clusters: reciprocal-nearest-neighbour average linkage on a sparse graph.

The graph's edges are pairs of cosine at or above the threshold: of each vector its most similar ones, and the maximum
spanning forest of each shard, so that what pairs join stays joined. The similarity of two clusters is the mean over all
their pairs, of which those that are no edge count 0. In each round every cluster points to its most similar neighbour,
and all that point to each other merge; linkage ends when no two clusters have a mean of the threshold. What is then
still linked by a pair is joined too where chains are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.similar import flat
from termloom.llm.vectors import SHARD_ROWS, classes_of_equals, clean_vectors, norm, route, tiles, to_shards
from termloom.operators.skew import join_hot
from termloom.session import cut, cut_from, release

THRESHOLD = 0.55
#: Most similar vectors of each vector whose pairs are edges. In groups of at most one more, all pairs are.
LINKS = 20
#: Edges that one task links to the end, instead of round by round over all tasks; the result is the same.
FEW = 300_000
_MASK = (1 << 64) - 1


def _strong_pairs(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs i < j of n sparse unit rows with a dot product of the threshold or more. Terms of many rows are columns
    of a matrix, the products of the others are added where they fall."""
    order = np.argsort(term, kind="stable")
    row, term, w = row[order], term[order], w[order]
    edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True])
    size = np.diff(edges)
    often = size > max(16, n // 16)
    x = np.zeros((n, int(often.sum())))
    for j, (s, e) in enumerate(zip(edges[:-1][often], edges[1:][often])):
        x[row[s:e], j] = w[s:e]
    mine = ~often & (size > 1)
    begin, size = edges[:-1][mine], size[mine]
    # each entry with all of its term
    left = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    span, first = np.repeat(size, size), np.repeat(begin, size)
    by = np.argsort(row[left], kind="stable")
    left, span, first = left[by], span[by], first[by]
    out = []
    for low in range(0, n, 1024):
        high = min(n, low + 1024)
        s = x[low:high] @ x.T
        a, b = np.searchsorted(row[left], (low, high))
        for c in range(a, b, 65_536):
            of, m, f = left[c : min(b, c + 65_536)], span[c : min(b, c + 65_536)], first[c : min(b, c + 65_536)]
            other = np.repeat(f, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            s.ravel()[:] += np.bincount((np.repeat(row[of], m) - low) * n + row[other], np.repeat(w[of], m) * w[other], s.size)
        i, j = np.nonzero(s >= threshold)
        keep = i + low < j
        out.append((i[keep] + low, j[keep], s[i[keep], j[keep]]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best_of_each(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the pairs that are among the k best of one of their two."""
    side, pair = np.r_[a, b], np.tile(np.arange(len(a)), 2)
    order = np.lexsort((pair, -w[pair], side))
    side, pair = side[order], pair[order]
    first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]]) if len(side) else np.zeros(0, np.int64)
    place = np.arange(len(side)) - np.repeat(first, np.diff(np.r_[first, len(side)]))
    return pair[place < k]


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indexes of the edges of a maximum spanning forest: each component takes its best edge, all at once, until none
    is left."""
    rank = np.empty(len(w), np.int64)
    rank[np.lexsort((b, a, w))] = np.arange(len(w))
    label, chosen, live = np.arange(n), [], np.arange(len(w))
    while True:
        x, y = label[a[live]], label[b[live]]
        live = live[x != y]
        if not len(live):
            return np.unique(np.concatenate(chosen)) if chosen else live
        x, y = label[a[live]], label[b[live]]
        best = np.full(n, -1, np.int64)
        np.maximum.at(best, x, rank[live])
        np.maximum.at(best, y, rank[live])
        at = np.empty(len(w), np.int64)
        at[rank[live]] = live
        picks = at[np.unique(best[best >= 0])]
        chosen.append(picks)
        for u, v in zip(label[a[picks]], label[b[picks]]):
            while label[u] != u:
                u = label[u]
            while label[v] != v:
                v = label[v]
            label[max(u, v)] = min(u, v)
        while (label[label] != label).any():
            label = label[label]


def sparse_graph(reps: DataFrame, threshold: float, rows: int = SHARD_ROWS, links: int = LINKS) -> DataFrame:
    """``a`` < ``b``, ``total``, ``na``, ``nb``: the kept pairs of cosine at or above the threshold. ``total`` is the sum
    over the pairs of ids of the two classes, ``na`` and ``nb`` the numbers of their ids."""

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        a, b, w = _strong_pairs(*flat(table), table.num_rows, threshold)
        keep = np.union1d(spanning_forest(table.num_rows, a, b, w), _best_of_each(a, b, w, links))
        ids, size = table["id"].to_numpy(), table["size"].to_numpy()
        a, b, w = a[keep], b[keep], w[keep]
        return pa.table({"a": ids[a], "b": ids[b], "total": w * size[a] * size[b], "na": size[a], "nb": size[b]})

    kinds = "a long, b long, total double, na long, nb long"
    cool, parts = to_shards(route(reps, threshold), rows)
    edges = cool.groupBy("shard").applyInArrow(shard, kinds)
    if parts is not None:
        edges = edges.union(tiles(parts).groupBy("shard", "tile").applyInArrow(shard, kinds))
    return edges.groupBy("a", "b").agg(F.max("total").alias("total"), F.first("na").alias("na"), F.first("nb").alias("nb"))


def _mean() -> Column:
    return F.round(F.col("total") / (F.col("na") * F.col("nb")), 12)


def _merged(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """The edges after the merges (``old`` -> ``new`` of ``size`` ids), those between two clusters added up."""
    for side in ("a", "b"):
        to = merges.select(F.col("old").alias(side), F.col("new").alias("__new"), F.col("size").alias("__size"))
        edges = edges.join(to, side, "left").withColumns({side: F.coalesce("__new", side), f"n{side}": F.coalesce("__size", f"n{side}")}).drop("__new", "__size")
    turned = F.col("a") > F.col("b")
    edges = edges.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total",
        F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"),
    )
    return edges.groupBy("a", "b").agg(F.sum("total").alias("total"), F.first("na").alias("na"), F.first("nb").alias("nb"))


def _reciprocal(edges: DataFrame, threshold: float) -> DataFrame:
    """The mutual best pairs of a mean of the threshold as merges: ``old``, ``new``, ``size``, a row for either side.
    Equal means are parted by a sum of the two ids that is the same seen from either side."""
    strong = edges.withColumn("mean", _mean()).where(F.col("mean") >= threshold)
    order = F.struct("mean", (-F.col("a").bitwiseXOR(F.col("b"))).alias("tie"), (-F.col("a")).alias("low"), (-F.col("b")).alias("high"))
    strong = strong.select("a", "b", order.alias("order"), (F.col("na") + F.col("nb")).alias("size"))
    sides = strong.select(F.col("a").alias("x"), "a", "b", "order", "size").union(strong.select("b", "a", "b", "order", "size"))
    best = sides.groupBy("x").agg(F.max_by(F.struct("a", "b", "size"), "order").alias("m")).select("m.*")
    pairs = best.groupBy("a", "b", "size").agg(F.count("*").alias("sides")).where("sides = 2")
    return pairs.select("size", F.col("a").alias("new"), F.explode(F.array("a", "b")).alias("old")).select("old", "new", "size")


def _smallest(edges: DataFrame) -> DataFrame:
    """Each cluster to the smallest of its neighbours, where that is smaller than itself; targets that go on too are
    followed. Sizes play no part any more."""
    both = edges.select(F.col("a").alias("new"), F.col("b").alias("old")).union(edges.select("b", "a"))
    merges = both.groupBy("old").agg(F.min("new").alias("new")).where("new < old")
    for _ in range(2):
        to = merges.select(F.col("old").alias("new"), F.col("new").alias("further"))
        merges = merges.join(to, "new", "left").select("old", F.coalesce("further", "new").alias("new"))
    return merges.withColumn("size", F.lit(1).cast("long"))


def link_here(a: np.ndarray, b: np.ndarray, total: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, chains: bool) -> dict[int, int]:
    """Linkage of edges at hand, in the same rounds as over all tasks: the cluster of each node, its smallest."""
    near: dict[int, dict[int, float]] = {}
    size: dict[int, int] = {}
    for x, y, t, p, q in zip(a.tolist(), b.tolist(), total.tolist(), na.tolist(), nb.tolist()):
        near.setdefault(x, {})[y] = t
        near.setdefault(y, {})[x] = t
        size[x], size[y] = p, q
    to, name = {x: x for x in near}, {x: x for x in near}

    def best(x: int) -> int | None:
        top = None
        for y, t in near[x].items():
            mean = round(t / (size[x] * size[y]), 12)
            if mean >= threshold:
                low, high = min(name[x], name[y]), max(name[x], name[y])
                if top is None or (mean, -(low ^ high), -low, -high) > top[0]:
                    top = (mean, -(low ^ high), -low, -high), y
        return top[1] if top else None

    points: dict[int, int | None] = {}
    fresh = set(near)
    while fresh:
        for x in fresh:
            points[x] = best(x)
        merges = {(min(x, y), max(x, y)) for x in fresh if (y := points[x]) is not None and points[y] == x}
        fresh = set()
        for x, y in merges:
            big, small = (x, y) if len(near[x]) >= len(near[y]) else (y, x)  # the fewer edges move
            del near[big][small], near[small][big]
            for z, t in near.pop(small).items():
                del near[z][small]
                near[big][z] = near[z][big] = near[big].get(z, 0.0) + t
            size[big] += size[small]
            name[big] = min(name[x], name[y])
            to[small] = big
            del points[small]
            fresh.add(big)
        fresh |= {y for x in fresh for y in near[x]}

    def root(x: int) -> int:
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    if chains:
        for x in near:
            for y in near[x]:
                p, q = root(x), root(y)
                if p != q:
                    to[q] = p
                    name[p] = min(name[p], name[q])
    return {x: name[root(x)] for x in to}


def link(edges: DataFrame, threshold: float = THRESHOLD, chains: bool = True, few: int = FEW, written: bool = False) -> DataFrame:
    """``id``, ``cluster`` of every node that an edge joins to others; the cluster is its smallest id. Edges that are
    ``written``, as a table of cut(), aren't written again, and deleted.

    Average linkage down to the threshold; with ``chains`` the clusters that an edge still joins are one. Rounds run over
    all tasks until at most ``few`` edges are left, which one task links to the end.
    """
    edges = edges if written else cut(edges)
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("cluster", F.col("id"))
    kept = labels = cut(labels)
    used, turn, average = [], 0, True
    while n := edges.count():
        if n <= few:
            ended = average

            def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                rows = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("total", pa.float64()), ("na", pa.int64()), ("nb", pa.int64())]))
                to = link_here(*[rows[c].to_numpy() for c in ("a", "b", "total", "na", "nb")], threshold if ended else float("inf"), chains)
                yield from pa.table({"old": pa.array(list(to), pa.int64()), "new": pa.array(list(to.values()), pa.int64())}).to_batches()

            merges = cut(edges.repartition(1).sortWithinPartitions("a", "b").mapInArrow(here, "old long, new long").where("old != new"))
        else:
            merges = cut(_reciprocal(edges, threshold) if average else _smallest(edges))
            if average and not merges.limit(1).count():
                if not chains:
                    break
                average = False
                continue
            before, edges = edges, cut(_merged(edges, merges))
            release(before)
        to = merges.select(F.col("old").alias("cluster"), "new")
        to = F.broadcast(to) if n <= few else to  # at most two rows an edge
        labels = labels.join(to, "cluster", "left").select("id", F.coalesce("new", "cluster").alias("cluster"))
        used.append(merges)
        turn += 1
        if n <= few:
            release(edges)
            break
        if turn % 4 == 0:
            before, labels = kept, cut(labels)
            release(before, *used)
            kept, used = labels, []
    return labels


def clusters(df: DataFrame, key: str = "doc_id", column: str = "map", threshold: float = THRESHOLD, least: int = 5, chains: bool = True, few: int = FEW) -> DataFrame:
    """``cluster_key``, ``doc_id``: one row per member of each group of ``least`` or more.

    Groups are clusters of average linkage, joined where a pair at or above the threshold still links them: so two ids are
    in one group if a chain of such pairs joins them. Without ``chains`` they stay apart. The key is the group's smallest
    id. Equal maps are in one group. Null and empty maps and null ids take no part, nor do entries that are null, zero or
    not finite; rows of one id count once; other columns play no part. A group may hold any share of the ids.
    """
    members, reps = classes_of_equals(df, key, column)
    labels = link(cut_from(lambda: sparse_graph(reps, threshold)), threshold, chains, few, written=True)
    classes = reps.select(F.col("id").alias("rep"), "size").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.withColumn("cluster", F.coalesce("cluster", "rep"))
    # a group's smallest id is the smallest of its classes' ids, which are the smallest of their members
    sizes = classes.groupBy("cluster").agg(F.sum("size").alias("all"), F.min("rep").alias("cluster_key"), F.count("*").alias("classes")).where(F.col("all") >= least)
    grouped = join_hot(classes, cut(sizes), ["cluster"], "classes").select("rep", "size", "cluster_key")
    return join_hot(members, cut(grouped), ["rep"], "size").select("cluster_key", F.col("id").alias("doc_id"))


def describe(df: DataFrame, grouped: DataFrame, key: str = "doc_id", column: str = "map", typical: int = 3) -> DataFrame:
    """``cluster_key``, ``size``, ``typical``: the ids most similar to the group's mean vector, best first."""
    vectors = clean_vectors(df, key, column).withColumnRenamed("id", "doc_id").join(grouped, "doc_id")
    rows = vectors.select("cluster_key", "doc_id", F.explode("vec").alias("e"), norm("vec").alias("norm"))
    rows = cut(rows.select("cluster_key", "doc_id", F.col("e.term").alias("term"), (F.col("e.w") / F.col("norm")).alias("w")))
    centre = rows.groupBy("cluster_key", "term").agg(F.sum("w").alias("c"))
    fit = rows.join(centre, ["cluster_key", "term"]).groupBy("cluster_key", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("c")), 9).alias("fit"))
    part = Window.partitionBy("cluster_key", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(F.desc("fit"), "doc_id")
    best = fit.withColumn("r", F.row_number().over(part)).where(F.col("r") <= typical)
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc("fit"), "doc_id"))).where(F.col("r") <= typical)
    names = ranked.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda s: s["doc_id"]).alias("typical"))
    return grouped.groupBy("cluster_key").agg(F.count("*").alias("size")).join(names, "cluster_key")
