"""Most similar vectors and clusters against brute force, and on dirty tables."""

import math
import random

import numpy as np
import pytest

from termloom.llm import clusters, similar
from termloom.llm.hnsw import Hnsw, exact_dots, sketch
from termloom.llm.vectors import classes_of_equals, prefixes, route, tiles, to_shards

SCHEMA = "doc_id long, map map<string,double>"


def cosine(a, b):
    dot = sum(w * b.get(t, 0.0) for t, w in a.items())
    return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def corpus(n, seed=3):
    """Families of similar maps, with a term that a third of all share."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        family = i // 6
        base = random.Random(family)
        m = {f"f{family}x{k}": base.random() + 0.1 for k in range(8)}
        m |= {f"n{rng.randrange(400)}": rng.random() * 0.6 for _ in range(rng.randrange(1, 5))}
        if i % 3 == 0:
            m["hot"] = 0.2
        out[i + 1] = m
    return out


def pairs_at(docs, threshold):
    ids = sorted(docs)
    return {(a, b): c for i, a in enumerate(ids) for b in ids[i + 1 :] if (c := cosine(docs[a], docs[b])) >= threshold}


def expected_pairs(docs, threshold, k):
    near = {}
    for (a, b), c in pairs_at(docs, threshold).items():
        near.setdefault(a, []).append((-c, b))
        near.setdefault(b, []).append((-c, a))
    return {(min(a, b), max(a, b)) for a, l in near.items() for _, b in sorted(l)[:k]}


def components(docs, threshold, least):
    label = {d: d for d in docs}
    for a, b in pairs_at(docs, threshold):
        x, y = label[a], label[b]
        if x != y:
            for d in docs:
                if label[d] == max(x, y):
                    label[d] = min(x, y)
    size = {}
    for d in docs:
        size[label[d]] = size.get(label[d], 0) + 1
    return {(label[d], d) for d in docs if size[label[d]] >= least}


@pytest.mark.parametrize("threshold", [0.9, 0.8])
def test_similar_against_brute_force(spark, threshold):
    docs = corpus(300)
    df = spark.createDataFrame(list(docs.items()), SCHEMA)
    got = {tuple(r) for r in similar.most_similar(df, threshold=threshold).collect()}
    want = expected_pairs(docs, threshold, 20)
    assert got <= set(pairs_at(docs, threshold)) and len(got & want) >= 0.98 * len(want) and want


@pytest.mark.parametrize("size, rows", [(10, 2048), (150, 2048), (500, 2048), (2000, 2048), (2000, 300)])
def test_large_family(spark, size, rows):
    """A family of different near maps, more than a search holds: each has its 20 most similar all the same."""
    rng = random.Random(5)
    base = [rng.random() + 0.5 for _ in range(12)]
    docs = {i: {f"f{k}": x * (0.7 + 0.6 * rng.random()) for k, x in enumerate(base)} | {f"own{i}x{k}": 0.2 * rng.random() for k in range(3)} for i in range(1, size + 1)}
    terms = {t: j for j, t in enumerate({t for m in docs.values() for t in m})}
    x = np.zeros((size, len(terms)))
    for i, m in docs.items():
        for t, w in m.items():
            x[i - 1, terms[t]] = w
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -1)
    best = np.argsort(-sims, axis=1)[:, : min(20, size - 1)]
    assert (np.take_along_axis(sims, best, 1) >= 0.9).all()
    want = {(min(i, j) + 1, max(i, j) + 1) for i, near in enumerate(best.tolist()) for j in near}
    reps = classes_of_equals(spark.createDataFrame(list(docs.items()), SCHEMA), "doc_id", "map")[1]
    near = similar.class_neighbours(reps, 20, 0.9, rows=rows).collect()
    assert {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in near} == want


def test_few_neighbours_each(spark):
    docs = corpus(120)
    df = spark.createDataFrame(list(docs.items()), SCHEMA)
    got = {tuple(r) for r in similar.most_similar(df, k=2, threshold=0.6).collect()}
    assert got == expected_pairs(docs, 0.6, 2)


@pytest.mark.parametrize("threshold", [0.55, 0.8])
def test_clusters_against_brute_force(spark, threshold):
    docs = corpus(240)
    df = spark.createDataFrame(list(docs.items()), SCHEMA)
    got = {tuple(r) for r in clusters.clusters(df, threshold=threshold, least=3).collect()}
    assert got == components(docs, threshold, 3) and got


def test_hot_shard_is_cut_into_parts(spark):
    """All vectors share their prefix term: parts of few rows still find all pairs."""
    rng = random.Random(1)
    docs = {i: {"hot": 1.0, f"a{i % 40}": 0.9 + rng.random() / 10} for i in range(1, 201)}
    df = spark.createDataFrame(list(docs.items()), SCHEMA)
    reps = classes_of_equals(df, "doc_id", "map")[1]
    cool, parts = to_shards(route(reps, 0.3), rows=32)
    assert max(r["count"] for r in tiles(parts).groupBy("shard", "tile").count().collect()) < 120
    assert max([r["count"] for r in cool.groupBy("shard").count().collect()], default=0) <= 32
    edges = clusters.sparse_graph(reps, 0.3, rows=32)
    assert clusters.link(edges).select("cluster").distinct().count() == 1
    near = {(r["id"], r["other"]) for r in similar.class_neighbours(reps, 20, 0.99, rows=32).collect()}
    assert {p for p in near if p[0] < p[1]} == {p for p, c in pairs_at(docs, 0.99).items()}


@pytest.mark.parametrize("threshold", [0.4, 0.55, 0.9])
def test_frequent_terms_lose_no_pair(threshold):
    """However few vectors make a term frequent, two at or above the threshold share a key; weights may be negative."""
    rng = np.random.default_rng(4)
    n, width = 220, 30
    x = rng.random((n, width)) ** 3 * (rng.random((n, width)) < 0.25) * rng.choice([1, 1, 1, -1], (n, width))
    x[:, 0] += rng.random(n) * (rng.random(n) < 0.6)
    x[0], x[1, :] = 0, 0
    x[0, 0], x[1, :3] = 1, (0.9, 0.1, 0.4)
    x = x[np.abs(x).sum(1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, term = np.nonzero(x)
    df, top = np.zeros(1024, np.int64), np.zeros(1024)
    np.add.at(df, term, 1)
    np.maximum.at(top, term, np.abs(x[row, term]))
    pairs = np.argwhere(np.triu(x @ x.T, 1) >= threshold)
    assert len(pairs) > 20
    for frequent in (1, 20, 60, 10_000):
        _, (rows, keys) = prefixes(row, term.astype(np.int64), x[row, term], len(x), df, top, threshold, frequent)
        goes: dict[int, set[int]] = {}
        for r, k in zip(rows.tolist(), keys.tolist()):
            goes.setdefault(r, set()).add(k)
        assert all(goes[a] & goes[b] for a, b in pairs.tolist())


def average_linkage(n, weights, threshold):
    """Brute force: the best pair merges, until none has the threshold."""
    groups = [{i} for i in range(n)]
    while True:
        means = [(sum(weights.get((min(x, y), max(x, y)), 0.0) for x in a for y in b) / (len(a) * len(b)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        top = max(means, default=(0, 0, 0))
        if top[0] < threshold:
            return {frozenset(g) for g in groups}
        groups[top[1]] |= groups.pop(top[2])


def grouped(labels):
    out = {}
    for i, c in labels:
        out.setdefault(c, set()).add(i)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("few", [0, 5, 10**6])
def test_average_linkage_against_brute_force(spark, few):
    """Rounds over all tasks, in one task and both give the same clusters, which aren't the chains."""
    rng = random.Random(8)
    n = 40
    weights = {(i, j): 0.56 + 0.4 * rng.random() for i in range(n) for j in range(i + 1, n) if i // 5 == j // 5 and rng.random() < 0.8 or rng.random() < 0.03}
    edges = spark.createDataFrame([(i, j, w, 1, 1) for (i, j), w in weights.items()], EDGES)
    got = clusters.link(edges, 0.55, chains=False, few=few).collect()
    alone = {frozenset([i]) for i in range(n)} - {frozenset([r["id"]]) for r in got}
    assert grouped(got) | alone == average_linkage(n, weights, 0.55)
    assert all(r["cluster"] <= r["id"] for r in got)
    chained = grouped(clusters.link(edges, 0.55, few=few).collect())
    label = {i: i for i in range(n)}
    for a, b in weights:
        x, y = label[a], label[b]
        label = {i: min(x, y) if c in (x, y) else c for i, c in label.items()}
    assert chained == {g for g in grouped(label.items()) if len(g) > 1} and chained != grouped(got)


EDGES = "a long, b long, total double, na long, nb long"


@pytest.mark.parametrize("few", [0, 10**6])
def test_long_chain_ends(spark, few):
    """A chain whose links grow stronger merges one pair a round: average linkage parts it, chains join it."""
    n = 12
    edges = spark.createDataFrame([(i, i + 1, 0.6 + i / 1000, 1, 1) for i in range(1, n)] + [(100, 101, 0.7, 1, 1)], EDGES)
    got = {r["id"]: r["cluster"] for r in clusters.link(edges, few=few).collect()}
    assert got == {i: 1 for i in range(1, n + 1)} | {100: 100, 101: 100}
    parted = grouped(clusters.link(edges, chains=False, few=few).collect())
    assert parted == {frozenset([i, i + 1]) for i in range(1, n, 2)} | {frozenset([100, 101])}


def test_strong_pairs_are_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.random((1500, 60)) * (rng.random((1500, 60)) < rng.random(60) ** 3)
    x[:, 0] += 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, col = np.nonzero(x)
    a, b, w = clusters._strong_pairs(row, col, x[row, col], 1500, 0.8)
    want = np.argwhere(np.triu(x @ x.T, 1) >= 0.8)
    assert {*zip(a.tolist(), b.tolist())} == {*map(tuple, want.tolist())} and np.allclose(w, (x[a] * x[b]).sum(1))


DIRTY = [(1, {"a": 1.0, "b": 2.0}), (1, {"a": 1.0, "b": 2.0}), (2, {"a": 1.0, "b": 2.0, "z": 0.0}), (3, None), (4, {}), (None, {"a": 1.0}), (5, {"a": float("nan"), "c": 1.0}), (6, {"c": 3.0, "d": None}), (7, {"q": float("inf")})]


def test_dirty_vectors(spark, same):
    df = spark.createDataFrame(DIRTY, SCHEMA).selectExpr("*", "'x' AS id", "'y' AS terms", "1 AS cluster_key", "2 AS other")
    same(similar.most_similar(df), [(1, 2), (5, 6)])
    same(clusters.clusters(df, least=2), [(1, 1), (1, 2), (5, 5), (5, 6)])
    assert similar.most_similar(df.limit(0)).count() == 0 and clusters.clusters(df.limit(0)).count() == 0
    grouped = clusters.clusters(df, least=2)
    same(clusters.describe(df, grouped), [(1, 2, [1, 2]), (5, 2, [5, 6])])


def test_copies_beyond_k(spark):
    """Of 30 equal maps each has its 20 most similar among them, by id; pairs stay in proportion to the ids."""
    df = spark.createDataFrame([(i, {"a": 1.0}) for i in range(1, 31)] + [(99, {"a": 1.0, "b": 0.1})], SCHEMA)
    got = {tuple(r) for r in similar.most_similar(df).collect()}
    copies = {(min(i, j), max(i, j)) for i in range(1, 31) for j in [x for x in range(1, 31) if x != i][:20]}
    assert got == copies | {(i, 99) for i in range(1, 21)}
    same_groups = {tuple(r) for r in clusters.clusters(df).collect()}
    assert same_groups == {(1, i) for i in [*range(1, 31), 99]}


def test_graph_recall():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 32))
    x = (centres[rng.integers(0, 60, 1500)] + 0.4 * rng.normal(size=(1500, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = Hnsw(x).neighbours(np.arange(1500), 64)
    sims = x @ x.T
    np.fill_diagonal(sims, -1)
    true = np.argsort(-sims, axis=1)[:, :20]
    assert np.mean([len(set(t) & set(i[:30])) / 20 for t, i in zip(true, ids)]) > 0.95
    assert Hnsw(np.zeros((0, 8), np.float32)).layers and len(Hnsw(x[:1]).neighbours(np.array([0]))[0]) == 1


def test_exact_dots():
    row, term, w = np.array([0, 0, 1, 1, 2]), np.array([5, 9, 9, 7, 8]), np.array([1.0, 2, 3, 4, 5])
    assert list(exact_dots(row, term, w, 3, np.array([0, 0, 1]), np.array([1, 2, 1]))) == [6, 0, 25]
    assert sketch(row, term, w, 3).shape == (3, 128)


def test_spanning_forest():
    a, b, w = np.array([0, 1, 0, 3]), np.array([1, 2, 2, 4]), np.array([0.9, 0.8, 0.7, 0.6])
    assert list(clusters.spanning_forest(5, a, b, w)) == [0, 1, 3]
    assert len(clusters.spanning_forest(3, a[:0], b[:0], w[:0])) == 0
