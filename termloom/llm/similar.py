"""Most similar vectors for every vector: a small-world graph per shard, the shards' results merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.hnsw import Hnsw, exact_dots, sketch
from termloom.llm.vectors import SHARD_ROWS, as_lists, classes_of_equals, lists, route, to_shards
from termloom.operators.skew import join_hot, salt_of
from termloom.session import cut, cut_from

K = 20
#: How far below the threshold a sketch may put a pair whose exact cosine is still computed.
SLACK = 0.4
#: Dimensions of the sketches that graphs are searched over: near pairs stand out from chance in the fewer.
DIMS = {"near": 64, "far": 128}
NEAR = 0.8
_PAIRS = "id long, other long, cos double"


def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and weights of all entries of a shard, in the order of its rows."""
    term, count = lists(table["terms"])
    return np.repeat(np.arange(table.num_rows), count), term, lists(table["ws"])[0]


def best_of_all(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, queries: np.ndarray, k: int, threshold: float, among: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of the rows ``queries`` the k most similar of n sparse unit rows (or of the first ``among``) with at least
    the threshold, exactly: row, other, dot product. Entries come by row; of equal ones the smaller row comes first."""
    order = np.argsort(term, kind="stable")
    row, term, w = row[order], term[order], w[order]
    edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True])
    lists_ = [(row[s:e], w[s:e]) for s, e in zip(edges[:-1], edges[1:]) if e - s > 1]
    common = [x for x in lists_ if len(x[0]) > n // 8]  # as columns of a matrix
    x = np.zeros((n, len(common)))
    for j, (r, v) in enumerate(common):
        x[r, j] = v
    rare = [x for x in lists_ if len(x[0]) <= n // 8]
    out = []
    for low in range(0, len(queries), 512):
        q = queries[low : low + 512]
        place = np.full(n, -1)
        place[q] = np.arange(len(q))
        s = x[q] @ x.T
        for r, v in rare:
            at = place[r]
            mine = at >= 0
            if mine.any():
                s[at[mine][:, None], r[None]] += v[mine, None] * v[None]
        s[np.arange(len(q)), q] = -np.inf
        s[s < threshold] = -np.inf
        s = s[:, :among]
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(s, top, 1)
        i, j = np.nonzero(np.isfinite(best))
        out.append((q[i], top[i, j], best[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (queries, queries, np.zeros(0))


def _pairs(a: np.ndarray, b: np.ndarray, cos: np.ndarray, k: int, threshold: float) -> pa.Table:
    """The k best of each a at the threshold or above, seen from both sides: what a search found from one side holds for
    the other."""
    keep = (cos >= threshold) & (a != b)
    a, b, cos = a[keep], b[keep], cos[keep]
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    a, b, cos = a[place < k], b[place < k], cos[place < k]
    return pa.table({"id": np.r_[a, b], "other": np.r_[b, a], "cos": np.r_[cos, cos]})


def _hits(graph: Hnsw, q: np.ndarray, own: bool, ef: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query (a node of the graph, or a vector) the nodes with a similarity of ``least``: places of query and
    node; and the queries whose beam is full of such. Those leave others out, and sketches are too coarse to tell which
    are the best: they have no pairs here."""
    a, b, full = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(q), 1024):
        ids, sims = graph.neighbours(q[low : low + 1024], ef, least) if own else graph.search(q[low : low + 1024], ef)
        hit = (ids >= 0) & (sims >= least)
        filled = hit.all(1)
        full.append(low + np.flatnonzero(filled))
        i, j = np.nonzero(hit & ~filled[:, None])
        a.append(low + i), b.append(ids[i, j])
    return np.concatenate(a), np.concatenate(b), np.concatenate(full)


def class_neighbours(reps: DataFrame, k: int, threshold: float, ef: int | None = None, rows: int = SHARD_ROWS, frequent: int | None = None) -> DataFrame:
    """``id``, ``other``, ``cos``: the k most similar of the different vectors ``reps`` with at least the threshold.

    Each shard has a graph. A shard over ``rows`` vectors is cut into parts; a part's graph is built once, kept as flat
    arrays in a table, and searched by all vectors of its shard.
    """
    beam, least = ef or max(48, 2 * k + 8), threshold - SLACK
    dims = DIMS["near" if threshold >= NEAR else "far"]

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        row, term, w = flat(table)
        n = table.num_rows
        graph = Hnsw(sketch(row, term, w, n, dims))
        a, b, full = _hits(graph, np.arange(n), True, beam, least)
        cos = exact_dots(row, term, w, n, a, b)
        far, other, dots = best_of_all(row, term, w, n, full, k, threshold)
        ids = table["id"].to_numpy()
        return _pairs(ids[np.r_[a, far]], ids[np.r_[b, other]], np.r_[cos, dots], k, threshold)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        row, term, w = flat(table)
        n = table.num_rows
        level, links = Hnsw(sketch(row, term, w, n, dims)).flat()
        one = lambda x: as_lists(np.asarray(x), np.array([len(x)]))
        return pa.table({
            "shard": table["shard"][:1], "part": table["part"][:1], "parts": table["parts"][:1], "ids": one(table["id"].to_numpy()),
            "count": one(np.bincount(row, minlength=n).astype(np.int32)), "terms": one(term), "ws": one(w), "level": one(level), "links": one(links),
        })

    def search(graphs: pa.Table, asks: pa.Table) -> pa.Table:
        if not graphs.num_rows or not asks.num_rows:
            return _pairs(*[np.zeros(0, np.int64)] * 2, np.zeros(0), k, threshold)
        asks = asks.sort_by("id")
        g = {c: lists(graphs[c])[0] for c in ("ids", "count", "terms", "ws", "level", "links")}
        n, m = len(g["ids"]), asks.num_rows
        row, term, w = np.repeat(np.arange(n), g["count"]), g["terms"], g["ws"]
        graph = Hnsw.from_flat(sketch(row, term, w, n, dims), g["level"], g["links"])
        mine, term_, w_ = flat(asks)
        row, term, w = np.r_[row, n + mine], np.r_[term, term_], np.r_[w, w_]
        a, b, full = _hits(graph, sketch(mine, term_, w_, m, dims), False, beam, least)
        cos = exact_dots(row, term, w, n + m, n + a, b)
        far, other, dots = best_of_all(row, term, w, n + m, n + full, k + 1, threshold, n)
        return _pairs(asks["id"].to_numpy()[np.r_[a, far - n]], g["ids"][np.r_[b, other]], np.r_[cos, dots], k, threshold)

    cool, parts = to_shards(route(reps, threshold, *([frequent] if frequent else [])), rows)
    found = cool.groupBy("shard").applyInArrow(shard, _PAIRS)
    if parts is not None:
        kinds = "shard long, part int, parts int, ids array<long>, count array<int>, terms array<long>, ws array<double>, level array<byte>, links array<int>"
        kinds = kinds.replace("shard long", f"shard {parts.schema['shard'].dataType.simpleString()}")
        graphs = cut(parts.groupBy("shard", "part").applyInArrow(build, kinds))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        kept = graphs.withColumn("block", F.explode(every)).drop("parts")
        asks = parts.withColumnRenamed("part", "block").withColumn("part", F.explode(every)).select("shard", "part", "block", "id", "terms", "ws")
        met = kept.groupBy("shard", "part", "block").cogroup(asks.groupBy("shard", "part", "block")).applyInArrow(search, _PAIRS)
        found = found.union(met)
    found = found.groupBy("id", "other").agg(F.max("cos").alias("cos"))
    best = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def most_similar(df: DataFrame, key: str = "doc_id", column: str = "map", k: int = K, threshold: float = 0.9) -> DataFrame:
    """``doc_a`` < ``doc_b`` where one is among the k most similar of the other and their cosine is ``threshold`` or
    more.

    Null and empty maps and null ids take no part, nor do entries that are null, zero or not finite; rows of one id count
    once; other columns play no part. Of equal cosines the smaller id comes first; an equal map is more similar than any
    other. k pairs per id at most come out, however many ids share a map.
    """
    members, reps = classes_of_equals(df, key, column)
    copied = reps.where("size > 1").select("id", "size")

    def sized() -> DataFrame:
        near = class_neighbours(reps, k, threshold)
        near = near.join(copied.withColumnRenamed("size", "id_size"), "id", "left").join(copied.toDF("other", "other_size"), "other", "left")
        near = near.fillna(1, ["id_size", "other_size"])
        return near.withColumn("most", F.max(F.greatest("id_size", "other_size")).over(Window.partitionBy("id")))

    near = cut_from(sized)
    single = near.where("most = 1").select("id", "other")
    several = cut(join_hot(members, copied.withColumnRenamed("id", "rep"), ["rep"], "size"))
    # the first k + 1 ids of each class, found in parts: a class may hold a third of all ids
    part = Window.partitionBy("rep", "part").orderBy("id")
    firsts = several.withColumn("part", salt_of("id")).withColumn("place", F.row_number().over(part)).where(F.col("place") <= k + 1)
    firsts = firsts.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1).select("rep", "id", "place", "size")
    heads = firsts.groupBy("rep", "size").agg(F.array_sort(F.collect_list("id")).alias("first"))

    # an id's k first copies: the first k, or of the first k + 1 those besides itself
    own = join_hot(several.select("rep", "id"), heads, ["rep"], "size")
    own = own.select("id", F.explode(F.slice(F.array_remove("first", F.col("id")), 1, k)).alias("other"))

    # what a class's ids take from the classes near it: so many as their copies leave
    wide = near.where("most > 1")
    taken = Window.partitionBy("id").orderBy(F.desc("cos"), "other").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("left", k - (F.col("id_size") - 1) - F.coalesce(F.sum("other_size").over(taken), F.lit(0))).where(F.col("left") > 0)
    wide = wide.join(heads.select(F.col("rep").alias("other"), "first"), "other", "left")
    wide = wide.select(F.col("id").alias("rep"), F.explode(F.slice(F.coalesce("first", F.array("other")), F.lit(1), F.col("left").cast("int"))).alias("other"), "id_size")
    # only classes of k ids at most have room for others
    mine = several.where(F.col("size") <= k).select("rep", "id")
    wide = wide.where("id_size = 1").select(F.col("rep").alias("id"), "other").union(wide.where("id_size > 1").join(mine, "rep").select("id", "other"))
    pairs = single.union(own).union(wide)
    return pairs.select(F.least("id", "other").alias("doc_a"), F.greatest("id", "other").alias("doc_b")).distinct()
