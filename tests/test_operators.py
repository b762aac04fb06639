"""Micro-fixtures worked out from the operators' formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import text as tx
from termloom.functions.stem import stem
from termloom.operators import cluster, dom, index, kdtree, linalg, recommend, similarity
from termloom.operators.skew import join_hot, with_key_totals
from termloom.session import cut, cut_from
from termloom.sources import formats, jdbc
from termloom.streaming import incremental

CORPUS = [(1, "apple apple pear"), (2, "apple pear"), (3, "apple pear kiwi"), (4, "apple kiwi"), (5, "plum"), (6, ""), (7, None)]


@pytest.fixture(scope="module")
def tf(spark):
    return index.term_frequencies(index.tokens(spark.createDataFrame(CORPUS, "doc_id long, text string"))).cache()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokenize(spark):
    assert one(spark, tx.tokenize(F.lit("Foo\nBar don't e-mail 42 café"))) == ["foobar", "dont", "email", "caf"]
    assert one(spark, tx.tokenize(F.lit("Kelvin"))) == ["elvin"]


def test_term_stats(tf, same):
    same(index.term_stats(tf), [("apple", 4, 5, 7, 2.645751), ("pear", 3, 3, 3, 1.732051), ("kiwi", 2, 2, 2, 1.414214), ("plum", 1, 1, 1, 1.0)])
    same(index.doc_magnitudes(tf).select("doc_id", "mag"), [(1, 5), (2, 2), (3, 3), (4, 2), (5, 1)])


def test_vocabulary(tf, same):
    stats = index.term_stats(tf)
    same(stats.where(index.in_vocabulary(F.col("df"), F.lit(5))).select("term"), [("apple",)])
    same(stats.where(index.in_vocabulary(F.col("df"), F.lit(5), compat=False)).select("term"), [])


@pytest.mark.parametrize("norms, want", [("stored", [0.074664889, 0.060963627, 0.039528471]), ("true", [0.942990334, 0.603687701, 0.372104204])])
def test_similarity(tf, norms, want):
    rows = index.weights(tf, index.term_stats(tf)).select("doc_id", "term", F.col("weight").alias("w"))
    lengths = tf.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm")) if norms == "stored" else similarity.true_norms(rows)
    sims = similarity.cosines(rows.where("doc_id = 1"), rows, lengths, lengths)
    assert [r["sim"] for r in sims.where("b in (2, 3, 4)").orderBy("b").collect()] == pytest.approx(want, abs=1e-8)


def test_centroid_step(tf, same):
    rows = index.weights(tf, index.term_stats(tf)).select("doc_id", "term", F.col("weight").alias("w"))
    members = rows.sparkSession.createDataFrame([(0, 1), (0, 2)], "cluster_id long, doc_id long")
    old = rows.where("doc_id = 1").select(F.lit(0).cast("long").alias("doc_id"), "term", "w")
    got = cluster.centroid_stats(members, rows, old)
    same(got.select("term", "mean", "std", "df", "shift"), [("apple", 0.375, 0.25, 2, 0.015625), ("pear", 0.333333333, 0.0, 2, 0.0)])


def test_stopwords(spark, same):
    toks = spark.createDataFrame([(1, w) for w in ("t", "th", "the", "then")], "doc_id long, term string")
    same(index.without_stopwords(toks, ["the"]).select("term"), [("t",), ("th",), ("then",)])
    same(index.without_stopwords(toks, ["the"], prefixes=True).select("term"), [("then",)])


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("formalize", "formal"), ("adoption", "adopt"), ("controll", "control"), ("probate", "probat"), ("rate", "rate"), ("is", "is")])
def test_stem(word, want):
    assert stem(word) == want


def test_votes(spark):
    targets = spark.createDataFrame([(v,) for v in range(6)], "v int").select(recommend.vote_target(F.col("v"))).collect()
    assert [r[0] for r in targets] == [1, -1, -0.1, 1, 2, 3]
    for args, want in [((5, 2, 30, 4, 60), 0.5), ((3, 0, 30, 4, 60), 0.00125), ((1, 4, 60, 4, 60), -2), ((4, 1, 10, 0, 0), 1000)]:
        assert one(spark, recommend.preference(*[F.lit(a) for a in args])) == pytest.approx(want)


def test_sort_by_dimension(spark, same):
    rows = spark.createDataFrame([(1, "t", 0.3), (3, "t", 0.1)], "doc_id long, term string, w double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    same(similarity.by_dimension(rows, docs, "t").select("doc_id", "place"), [(3, 1), (1, 2), (2, 3)])


def test_linear_algebra():
    x, y = np.array([[1.0, 2], [2, 1], [3, 3]]), np.array([1.0, 2, 4])
    q, r = linalg.modified_gram_schmidt(x)
    assert np.abs(np.diag(r)) == pytest.approx([3.741657387, 1.388730150])
    assert q @ r == pytest.approx(x)
    assert linalg.least_squares(x, y)[0] == pytest.approx([10 / 9, 1 / 9])
    assert linalg.solve(np.array([[1.0, 2], [2, 4]]), np.ones(2)) is None
    values, vectors = linalg.eigen(np.array([[2.0, 1], [1, 2]]))
    assert values == pytest.approx([3, 1]) and (vectors[0] >= 0).all()


def test_arrays(spark):
    assert one(spark, linalg.linspace(0.0, 1.0, 5)) == [0, 0.25, 0.5, 0.75, 1]
    assert one(spark, linalg.slice_of(F.array(*map(F.lit, "abcd")), 1, 3)) == ["b", "c"]
    assert one(spark, linalg.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [None, None]


def test_text_functions(spark):
    assert one(spark, tx.base64_text(F.lit("Hello world."))) == "SGVsbG8gd29ybGQu"
    assert one(spark, tx.query_map(F.lit("name=Ann&age=18&name=Bo&x"))) == {"name": "Ann", "age": "18", "x": ""}
    for name, want in [("a.css", "text/css"), ("a.xyz", "text/html;charset=UTF-8"), ("readme", "text/plain"), ("[1]", "application/json")]:
        assert one(spark, tx.content_type(F.lit(name))) == want
    assert one(spark, tx.number_or_zero(F.lit("12abc"))) == 12 and one(spark, tx.number_or_zero(F.lit("abc"))) == 0
    assert one(spark, tx.entity_encode(F.lit("aé☃"))) == "a&#233;&#9731;"
    assert one(spark, tx.first_index(F.lit("abc"), "c")) == 2 and one(spark, tx.count_char(F.lit("banana"), "a")) == 3


CARD = '<div><p class="mw-empty-elt">blank text</p><p>Hi</p><p>Hello <b>you</b><style>q</style></p><img class="thumbimage x" src="//h/i.png"></div>'


def test_markup_tree(spark, same):
    nodes = dom.parse_pages(spark.createDataFrame([("1", CARD), ("2", None), ("3", "")], "id string, text string"), "id", "text").cache()
    assert nodes.where("page_id = '1'").count() == 8
    same(dom.first_match(nodes, "p.mw-empty-elt"), [("1", 2)])
    same(dom.first_match(nodes, "p!.mw-empty-elt"), [("1", 3)])
    same(dom.descendants(nodes, "div b").select("node_id"), [(5,)])
    same(dom.children(nodes, "p", "b").select("node_id"), [(5,)])
    text = dom.read_text(nodes, skip="style")
    same(text.where("page_id = '1' and node_id = 4").select("text"), [("Hello you",)])
    same(dom.cards(nodes).where("page_id = '1'").select("image"), [("h/i.png",)])
    assert dom.parse("<br/>a</b></p>")[0]["data"] == "<>a"
    assert [n["tag"] for n in dom.parse("<ul><li>a<!-- <p> --></ul><p x=1 y>")] == ["root", "ul", "li", "p"]


def test_formats(spark, tmp_path, same):
    lines = spark.createDataFrame([("12:The  big title 25",), ("no colon",)], "value string")
    same(formats.parse_titles(lines), [("12", "The big title", 25.0)])
    formats.write_lines(spark.createDataFrame([("pear 2:1,3|4,1|",)], "line string"), "line", str(tmp_path / "i"))
    same(formats.read_index(spark, str(tmp_path / "i")).select("term", "df", "doc_id", "tf", "weight"), [("pear", 2, "1", 3, 1.5), ("pear", 2, "4", 1, 0.5)])
    (tmp_path / "kv").write_text("200|OK\n404|Not | Found\n")
    same(formats.read_key_values(spark, str(tmp_path / "kv")), [("200", "OK"), ("404", "Not | Found")])


def test_incremental(spark, tmp_path, tf, same):
    docs = spark.createDataFrame(CORPUS, "doc_id long, text string")
    docs.where("doc_id <= 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    incremental.start_index(stream(), str(tmp_path / "out")).awaitTermination()
    docs.where("doc_id > 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.start_index(stream(), str(tmp_path / "out")).awaitTermination()
    same(incremental.index_stats(spark, str(tmp_path / "out")), [tuple(r) for r in index.term_stats(tf).drop("std").collect()])
    new = spark.createDataFrame([(9, "pear pear fig")], "doc_id long, text string")
    same(incremental.document_vector(spark, str(tmp_path / "out"), new).select("term", "weight"), [("pear", 2 / 3)])


def test_k_means(spark):
    rows = spark.createDataFrame([(d, t, 1.0) for d, t in [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "a")]], "doc_id long, term string, w double")
    got = {r["doc_id"]: r["cluster_id"] for r in cluster.k_means(rows, similarity.true_norms(rows), k=2).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_k_means_ends_by_its_shifts(spark, monkeypatch):
    """Neither the caller's rounds nor the safety bound end it in silence."""
    import inspect

    rows = spark.createDataFrame([(d, t, 1.0) for d, t in [(1, "a"), (2, "b"), (3, "a")]], "doc_id long, term string, w double")
    norms = similarity.true_norms(rows)
    assert inspect.signature(cluster.k_means).parameters["rounds"].default is None
    with pytest.warns(UserWarning, match="ended by its 1 rounds"):
        cluster.k_means(rows, norms, k=2, rounds=1)
    monkeypatch.setattr(cluster, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        cluster.k_means(rows, norms, k=2)


def test_k_means_sends_no_centroid_per_block(spark, monkeypatch):
    """Centroids have nearly all terms of all documents: a copy for each block of documents outgrows an executor."""
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    rows = cut(spark.range(2000).selectExpr("id as doc_id", "explode(transform(sequence(1, 12), i -> concat(id, ' ', i))) as term", "0.5D as w"))
    monkeypatch.setattr(similarity, "BLOCK", 20)
    before = sent()
    with pytest.warns(UserWarning):
        cluster.k_means(rows, similarity.true_norms(rows), k=4, rounds=2).collect()
    assert sent() - before < 8_000_000  # the rows are 24,000


@pytest.mark.parametrize("part", [1 << 21, 40])
def test_k_means_by_parts(spark, monkeypatch, part):
    """As by brute force: with centroids in one part or in turns of many, a seed without a norm whose cluster takes the least similar
    document, negative weights, and documents that share no term with any centroid."""
    rng, k = np.random.default_rng(3), 5
    vectors = {d: {f"t{t}": float(w) for t, w in zip(rng.integers(0, 60, 6), rng.normal(0.4, 1, 6).round(3))} for d in range(300)}
    vectors |= {2: {"t1": 0.0}, 300: {"alone": 1.0}, 301: {"t1": 0.0}}
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    centres = dict(enumerate(dict(vectors[d]) for d in range(k)))
    for _ in range(3):
        best = {}
        for d, v in vectors.items():
            if norm(v):
                best[d] = max((round(sum(x * m.get(t, 0) for t, x in v.items()) / (norm(v) * norm(m)), 9), -c) for c, m in centres.items() if norm(m))
        want = {d: -c for d, (_, c) in best.items()}
        empty = sorted(set(range(k)) - {*want.values()})
        want |= dict(zip(sorted(best, key=lambda d: (best[d][0], d)), empty))
        for c in range(k):
            own = [vectors[d] for d in want if want[d] == c]
            centres[c] = {t: round(sum(v.get(t, 0) for v in own) / len(own), 9) for t in {t for v in own for t in v}}
    rows = spark.createDataFrame([(d, t, w) for d, v in vectors.items() for t, w in v.items()], "doc_id long, term string, w double")
    monkeypatch.setattr(cluster, "PART", part, raising=False)
    with pytest.warns(UserWarning):
        got = cluster.k_means(rows, similarity.true_norms(rows), k=k, threshold=-1.0, rounds=3)
    assert {r["doc_id"]: r["cluster_id"] for r in got.collect()} == want


def test_k_means_of_nothing(spark):
    rows = spark.createDataFrame([], "doc_id long, term string, w double")
    assert cluster.k_means(rows, similarity.true_norms(rows)).collect() == []


def test_every_document_has_a_cluster(spark, same):
    """No common term is similarity 0: the smallest id of those clusters, before any of negative similarity."""
    schema = "doc_id long, term string, w double"
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "q", 1.0), (3, "b", -1.0), (4, "c", 2.0), (5, "z", 0.0)], schema)
    centres = spark.createDataFrame([(7, "a", 1.0), (3, "b", 1.0), (9, "c", 1.0)], schema)
    norms = similarity.true_norms
    same(cluster.assign(rows, norms(rows), centres, norms(centres)), [(1, 7, 1.0), (2, 3, 0.0), (3, 7, 0.0), (4, 9, 1.0)])
    same(cluster.assign(rows, norms(rows), centres.limit(0), norms(centres.limit(0))), [])


def test_key_totals_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i, 2) for i in range(300)] + [("cold", 1, 5)], "k string, i long, v long")
    got = with_key_totals(rows, "k", "i", {"total": F.col("v")})
    assert got.count() == 301
    assert {(r["k"], r["total"]) for r in got.collect()} == {("hot", 600), ("cold", 5)}


def test_global_rank_and_prior_totals(spark):
    from termloom.operators.order import global_rank, prior_totals

    df = spark.createDataFrame([(i * 37 % 101, "a") for i in range(101)], "v long, k string")
    assert {(r["v"], r["place"]) for r in global_rank(df, [F.desc("v")], parts=4).collect()} == {(v, 101 - v) for v in range(101)}
    got = prior_totals(df, "k", "v", {"s": F.col("v")}, block=10).collect()
    assert {(r["v"], r["s"]) for r in got} == {(v, v * (v - 1) // 2) for v in range(101)}
    assert global_rank(df.limit(0), [F.desc("v")]).count() == 0


def test_build_index(spark, tmp_path):
    from termloom.plans.build import TABLES, build_index, read_index

    docs = spark.createDataFrame([(i, f"apple pear w{'abcdefgh'[i % 2]} x{'abcdefgh'[i % 8]}") for i in range(20)] + [(99, None)], "doc_id long, text string")
    build_index(docs, str(tmp_path / "ix"), ["pear"], compat=True, k=2, rounds=3)
    tables = read_index(spark, str(tmp_path / "ix"))
    assert set(tables) == set(TABLES) and tables["docs"].count() == 20
    assert {r["term"] for r in tables["term_stats"].collect()} == {"wa", "wb"}
    assert {r["df"] for r in tables["term_stats"].collect()} == {10}
    clusters = {}
    for r in tables["assign"].collect():
        clusters.setdefault(r["cluster_id"], set()).add(r["doc_id"] % 2)
    assert sorted(map(sorted, clusters.values())) == [[0], [1]]


def test_random(spark):
    from termloom.functions.random import gaussian, random_matrix, uniform

    got = [r["v"] for r in random_matrix(spark, 20, 5, uniform(-2.0, 3.0, 1)).collect()]
    assert len(got) == 100 and min(got) >= -2 and max(got) < 3
    assert random_matrix(spark, 3, 2, gaussian(0.0, 1.0, 1)).agg(F.max("i"), F.max("j")).first() == (2, 1)


def test_fit_and_rerank(spark):
    x, y = np.array([[1.0, 2], [2, 1], [3, 3]]), np.array([1.0, 2, 3])
    votes = spark.createDataFrame([("u", 1, 3), ("u", 2, 4), ("u", 3, 5), ("few", 1, 3)], "user_id string, doc_id long, vote int")
    cells = spark.createDataFrame([("u", d + 1, t, float(x[d, k])) for d in range(3) for k, t in enumerate("ab")] + [("few", 1, "a", 1.0), ("few", 1, "b", 2.0)], "user_id string, doc_id long, term string, x double")
    beta = recommend.fit_words(cells, votes, parts=2)
    got = {(r["user_id"], r["term"]): r["beta"] for r in beta.collect()}
    want = linalg.least_squares(x, y)[0]
    assert got == {("u", "a"): pytest.approx(want[0]), ("u", "b"): pytest.approx(want[1])}
    found = spark.createDataFrame([("u", 7, 0.9, 1), ("u", 8, 0.8, 2), ("few", 7, 0.5, 1)], "user_id string, doc_id long, sim double, rank int")
    rows = spark.createDataFrame([(7, "a", 0.1), (8, "a", 5.0)], "doc_id long, term string, w double")
    order = {(r["user_id"], r["doc_id"]): r["place"] for r in recommend.rerank(found, beta, rows).collect()}
    assert order == {("u", 8): 1, ("u", 7): 2, ("few", 7): 1}


def test_profiles_and_candidates(spark, same):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (2, "b", 1.0), (3, "b", 1.0), (4, "c", 1.0)], "doc_id long, term string, w double")
    votes = recommend.latest_votes(spark.createDataFrame([("u", "1", 3, 1), ("u", "1", 4, 2), ("u", "99", 5, 1), ("u", None, 5, 1), (None, "1", 5, 1), ("u", "2", 9, 1)], "user_id string, page_id string, vote int, voted_at int"))
    same(votes, [("u", 1, 4), ("u", 99, 5)])
    same(recommend.profiles(votes, rows), [("u", "a", 1.0)])
    same(recommend.candidates(votes, rows, similarity.true_norms(rows)).select("doc_id", "rank"), [(2, 1)])


def test_tree_index(spark, same):
    """Search over all leaves is exact, over few it finds most; documents come and go."""
    rng = np.random.default_rng(6)
    centres = rng.random((20, 6))
    x = np.abs(centres[rng.integers(0, 20, 600)] + 0.08 * rng.normal(size=(600, 6)))
    data = [(i, f"t{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    rows = spark.createDataFrame(data, "doc_id long, term string, w double")
    queries = rows.select("doc_id").where("doc_id % 10 = 0").distinct()
    vectors = similarity.as_vectors(rows, similarity.true_norms(rows))
    exact = {(r["a"], r["b"]) for r in similarity.best_matches(vectors.join(queries, "doc_id", "left_semi"), vectors, 5, others=True).collect()}
    tree = kdtree.build(rows, [f"t{j}" for j in range(4)], leaf=40)
    assert tree.depth == 4 and max(r["count"] for r in tree.points.groupBy("leaf").count().collect()) <= 60
    found = lambda t, probes: {(r["a"], r["b"]) for r in kdtree.search(t, vectors, queries, rows, 5, probes).collect()}
    assert found(tree, 16) == exact
    assert len(found(tree, 6) & exact) >= 0.9 * len(exact)
    gone = spark.createDataFrame([(i,) for i in range(0, 600, 3)], "doc_id long")
    less = kdtree.delete(tree, gone)
    assert less.points.count() == 400 and all(b % 3 for _, b in found(less, 16))
    back = kdtree.insert(less, rows.join(gone, "doc_id", "left_semi"))
    assert found(back, 16) == exact
    one = kdtree.build(rows.where("doc_id < 0"), ["t0"])
    assert one.depth == 0 and one.points.count() == 0


def test_leaves_by_distance():
    cuts = np.zeros(8)
    cuts[1], cuts[2], cuts[3] = 5, 1, 9
    x = np.array([4.0, 2.0])
    assert kdtree.leaves_near(x, cuts, 2, 4) == [5, 4, 6, 7] or kdtree.leaves_near(x, cuts, 2, 4) == [5, 6, 4, 7]
    assert kdtree.leaves_near(x, cuts, 2, 1) == [5] and kdtree.leaves_near(x, cuts, 0, 3) == [1]


def test_unseen_asks_for_more(spark, same):
    """With nearly all seen, the search goes on until the vector has its k."""
    rows = spark.createDataFrame([(i, "a", 1.0) for i in range(60)] + [(i, f"x{i}", i / 100) for i in range(1, 60)], "doc_id long, term string, w double")
    seen = spark.createDataFrame([(0, i) for i in range(1, 50)], "a long, b long")
    got = similarity.nearest(rows, similarity.true_norms(rows), rows.where("doc_id = 0").select("doc_id"), 5, lambda pairs: pairs.join(seen, ["a", "b"], "left_semi"))
    assert [r["b"] for r in got.orderBy("rank").collect()] == [50, 51, 52, 53, 54]
    none = similarity.nearest(rows, similarity.true_norms(rows), rows.where("doc_id = 0").select("doc_id"), 5, lambda pairs: pairs)
    assert none.count() == 0


def test_stopwords_from_a_table(spark, tmp_path, same):
    (tmp_path / "stop.txt").write_text("the\n  of \n\n")
    toks = spark.createDataFrame([(1, t) for t in ("the", "o", "of", "sea", "offer")], "doc_id long, term string")
    words = formats.read_stopwords(spark, str(tmp_path / "stop.txt"))
    same(index.without_stopwords(toks, words).select("term"), [("o",), ("sea",), ("offer",)])
    same(index.without_stopwords(toks, words, prefixes=True).select("term"), [("sea",), ("offer",)])


def test_entities_file(spark, tmp_path, same):
    (tmp_path / "entities").write_text("& &amp;\né &eacute;\nbroken\na b c\n")
    same(formats.read_entities(spark, str(tmp_path / "entities")), [("&", "&amp;"), ("é", "&eacute;")])


def test_database(spark, same):
    """A database on Spark's own class path, read in parts and with a pushed filter."""
    url = "jdbc:derby:memory:pages;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(i, f"name {i}") for i in range(20)], "id int, title string").write.format("jdbc").option("url", url).option("dbtable", "page").options(**options).mode("overwrite").save()
    pages = jdbc.read_jdbc(spark, url, "page", "id", 0, 20, 4, **options)
    assert pages.rdd.getNumPartitions() == 4
    same(pages.where("id = 7"), [(7, "name 7")])
    assert "EqualTo" in pages.where("id = 7")._jdf.queryExecution().executedPlan().toString()


def test_matrix_column(spark, same):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "i long, j long, v double")
    same(linalg.with_column(m, 1, spark.createDataFrame([(0, 9.0), (1, 8.0)], "i long, v double")), [(0, 0, 1.0), (0, 1, 9.0), (1, 1, 8.0)])


def test_tables_on_the_way_are_deleted(spark):
    made = []

    def build():
        made.append(cut(spark.range(5)))
        return made[0].where("id > 1")

    out = cut_from(build)
    assert out.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        made[0].count()


def test_join_of_hot_keys(spark, same):
    left = spark.createDataFrame([("hot", i) for i in range(90)] + [("cold", 1), ("none", 2), (None, 3)], "k string, id long")
    right = spark.createDataFrame([("hot", 90, "h"), ("cold", 1, "c"), ("gone", 0, "g")], "k string, n long, v string")
    for share in (1, 2, 1000):
        got = join_hot(left, right, ["k"], "n", share)
        same(got.groupBy("k", "v").count(), [("hot", "h", 90), ("cold", "c", 1)])
    assert join_hot(left.limit(0), right.limit(0), ["k"], "n").count() == 0
