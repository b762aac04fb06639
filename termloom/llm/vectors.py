"""Sparse vectors from maps: cleaning, classes of equal maps, and routing that brings similar vectors together.

Routing: terms are ordered by how many vectors have them, rarest first. A vector's prefix is the shortest start of its
terms after which the rest has a norm below the threshold. If two vectors have a cosine of the threshold or more, the
first term they share lies in both prefixes; so they meet wherever vectors go by prefix term, and no pair is lost.

A frequent prefix term t is cut by a second term. What a pair needs beyond t is at least threshold - |x_t| * M, M being
the largest weight of t: so the first term u that both share after t lies in the prefix of the rest of each vector under
that remainder, and they meet at (t, u). Only vectors for which t alone may do (no remainder) also meet at (t, none),
and go to (t, u) for all their u, where those with a remainder find them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.skew import join_hot
from termloom.session import cut, release

#: Rows that a shard has on average half of; a fuller one is cut into parts.
SHARD_ROWS = 2048
#: Counters of the terms' frequencies, a power of two. Terms of one counter count as equally frequent, which leaves the
#: order a common one: what the executors get stays at this size whatever the vocabulary.
COUNTERS = 1 << 20
#: Frequency from which a prefix term is cut by a second one.
FREQUENT = 2048
_SMALL = 1e-9


def _signed(df: DataFrame, key: str, column: str) -> DataFrame:
    """``id``, ``vec`` (entries term, w), ``s1``, ``s2``: a sign of the map, whatever the order of its entries."""
    entry = F.transform(F.map_entries(F.col(column)), lambda e: F.struct(e["key"].alias("term"), e["value"].cast("double").alias("w")))
    kept = F.filter(entry, lambda e: e["w"].isNotNull() & ~F.isnan(e["w"]) & (F.abs(e["w"]) != float("inf")) & (e["w"] != 0))
    rows = df.select(F.col(key).cast("long").alias("id"), kept.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))

    def sign(seed: int) -> Column:
        return F.aggregate("vec", F.lit(0).cast("long"), lambda s, e: s.bitwiseXOR(F.xxhash64(F.lit(seed), e["term"], e["w"])))

    return rows.withColumns({"s1": sign(1), "s2": sign(2)})


def clean_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """``id``, ``vec`` (entries term, w) once per id. Entries that are null, zero or not finite are absent terms; null ids
    and vectors without entries take no part; of an id's different vectors that with the smallest sign counts."""
    rows = _signed(df, key, column)
    return rows.groupBy("id").agg(F.min_by("vec", F.struct("s1", "s2")).alias("vec"))


def classes_of_equals(df: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """``members`` (id, rep), and one vector per class: ``id`` (the rep), ``size``, ``terms`` (64-bit hashes), ``ws`` (of
    unit norm). Equal maps are one vector with many ids; what takes part is as in clean_vectors. Both are written tables.

    Equal hashes of different terms would be taken for one term.
    """
    rows = _signed(df, key, column)
    own = cut(rows.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("s")).select("id", "s.s1", "s.s2"))
    classes = cut(own.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    members = cut(join_hot(own, classes, ["s1", "s2"], "size").select("id", "rep"))
    vecs = rows.groupBy("s1", "s2").agg(F.first("vec").alias("vec")).join(classes, ["s1", "s2"])
    vecs = vecs.withColumn("norm", norm("vec"))
    reps = vecs.select(
        F.col("rep").alias("id"), "size", F.transform("vec", lambda e: F.xxhash64(e["term"])).alias("terms"),
        F.transform("vec", lambda e: e["w"] / F.col("norm")).alias("ws"),
    )
    reps = cut(reps)
    release(own, classes)
    return members, reps


def norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))


def lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists one after the other, and the length of each list."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False), np.diff(a.offsets.to_numpy())


def as_lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(values))


def frequencies(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each counter how many vectors have its terms, and their largest weight."""
    entries = reps.select(F.explode(F.arrays_zip("terms", "ws")).alias("e"))
    found = entries.groupBy(F.pmod("e.terms", F.lit(COUNTERS)).alias("b")).agg(F.count("*").alias("n"), F.max(F.abs("e.ws")).alias("top")).toArrow()
    df, top = np.zeros(COUNTERS, np.int64), np.zeros(COUNTERS)
    b = found["b"].to_numpy()
    df[b], top[b] = found["n"].to_numpy(), found["top"].to_numpy()
    return df, top


def _pair_key(t: np.ndarray | int, u: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.asarray(t, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) + np.asarray(u, np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def prefixes(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, df: np.ndarray, top: np.ndarray, threshold: float, frequent: int):
    """Entries (row, term, w) of n unit vectors in the order of their terms, without those that no other vector has, and
    the keys (row, key) that each vector goes to."""
    at = term & np.int64(len(df) - 1)
    count = df[at]
    order = np.lexsort((term, count, row))
    order = order[count[order] > 1]
    row, term, w, count, at = row[order], term[order], w[order], count[order], at[order]
    size = np.bincount(row, minlength=n)
    start = np.r_[0, np.cumsum(size)]
    sums = np.r_[0.0, np.cumsum(w * w)]
    left = sums[start[1:]][row] - sums[:-1]  # what is left of the squared norm from an entry on
    inside = left >= threshold * threshold - _SMALL
    plain = inside & (count <= frequent)
    rows, keys = [row[plain]], [term[plain]]
    for i in np.flatnonzero(inside & (count > frequent)):
        rest = slice(i + 1, start[row[i] + 1])
        needed = threshold - abs(w[i]) * top[at[i]]
        second = term[rest] if needed <= _SMALL else term[rest][left[rest] >= needed * needed - _SMALL]
        got = _pair_key(term[i], second)
        if needed <= _SMALL:
            got = np.r_[got, _pair_key(term[i], np.int64(0))]
        rows.append(np.full(len(got), row[i]))
        keys.append(got)
    return (row, term, w, size), (np.concatenate(rows), np.concatenate(keys))


def route(reps: DataFrame, threshold: float, frequent: int = FREQUENT) -> DataFrame:
    """``id``, ``size``, ``terms``, ``ws``, ``route`` (the keys it goes to) of each vector that may have a partner."""
    stats = reps.sparkSession.sparkContext.broadcast(frequencies(reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, top = stats.value
        for batch in batches:
            term, count = lists(batch.column("terms"))
            w, _ = lists(batch.column("ws"))
            n = batch.num_rows
            (_, term, w, size), (row, key) = prefixes(np.repeat(np.arange(n), count), term, w, n, df, top, threshold, frequent)
            order = np.argsort(row, kind="stable")
            ways = np.bincount(row, minlength=n)
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), as_lists(term, size), as_lists(w, size), as_lists(key[order], ways)], ["id", "size", "terms", "ws", "route"])
            yield out.filter(pa.array(ways > 0))

    return reps.select("id", "size", "terms", "ws").mapInArrow(run, "id long, size long, terms array<long>, ws array<double>, route array<long>")


def to_shards(routed: DataFrame, rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The routed vectors once per shard: ``shard``, ``id``, ``size``, ``terms``, ``ws``; and apart from these, with
    ``part`` and ``parts``, those of shards of over ``rows`` vectors, or None if there are none.

    A shard takes the vectors of many keys, and is one group of at most ``rows`` vectors.
    """
    routed = cut(routed)
    total = routed.select(F.sum(F.size("route"))).first()[0] or 0
    shards = max(1, -(-total * 2 // rows))
    placed = routed.select("id", F.explode(F.array_distinct(F.transform("route", lambda t: F.pmod(F.xxhash64(t), F.lit(shards))))).alias("shard"))
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"))
    hot = cut(sizes.where(F.col("n") > rows).select("shard", F.ceil(F.col("n") / rows).cast("int").alias("parts")))
    # by rows, not by bytes as the optimiser would: a shard's cost is its computation
    tasks = max(2 * routed.sparkSession.sparkContext.defaultParallelism, total // (8 * rows))
    vectors = routed.select("id", "size", "terms", "ws")
    if not hot.limit(1).count():
        return placed.join(vectors, "id").repartition(tasks, "shard"), None
    cool = placed.join(hot, "shard", "left_anti").join(vectors, "id").repartition(tasks, "shard")
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")
    return cool, placed.join(hot, "shard").withColumn("part", part).join(vectors, "id")


def tiles(parts: DataFrame) -> DataFrame:
    """Rows of cut shards once per pair of parts (``tile``): any two vectors of a shard share a tile, and no task gets
    more than two parts."""
    low, high = F.least("other", "part"), F.greatest("other", "part")
    rows = parts.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part"))))
    return rows.withColumn("tile", low * F.col("parts") + high).drop("other", "part", "parts")
