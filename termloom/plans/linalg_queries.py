"""Queries over vectors and matrices."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import linalg as la
from termloom.sources.tables import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), "label")


def vector_operations(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with linspace(0, 1) of its length: dot product, norm, sum, difference, scaled and unit vector, slice."""
    a, b = F.col("a"), la.linspace(0.0, 1.0, 64)
    short = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s * 0.5 + x), 5)
    return _vectors(spark, d).select(
        "vec_id", F.round(la.dot(a, b), 5).alias("dot"), F.round(la.norm(a), 6).alias("norm"), short(la.add(a, b)).alias("sum_fold"), short(la.subtract(a, b)).alias("diff_fold"),
        short(la.scale(a, 2.5)).alias("scale_fold"), short(la.normalize(a)).alias("unit_fold"), F.size(la.slice_of(a, 3, 9)).alias("slice_size"),
        F.round(F.element_at(la.slice_of(a, 3, 9), 1), 6).alias("slice_first"), la.equal(a, la.add(a, la.constant(1e-9, 64)), 1e-6).alias("same"),
    )


def matrix_transpose(spark: SparkSession, d: str) -> DataFrame:
    return la.transpose(la.coo(_vectors(spark, d), "vec_id", "a")).withColumn("v", F.round("v", 6))


def matrix_row_column(spark: SparkSession, d: str) -> DataFrame:
    m = la.coo(_vectors(spark, d), "vec_id", "a")
    return la.row(m, 0).select(F.lit("row").alias("kind"), F.col("j").cast("long").alias("k"), F.round("v", 6).alias("v")).union(la.column(m, 0).select(F.lit("column"), "i", F.round("v", 6)))


def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return la.gram(la.coo(_vectors(spark, d), "vec_id", "a")).withColumn("v", F.round("v", 4))


def matrix_product(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by their Gram matrix."""
    m = la.coo(_vectors(spark, d), "vec_id", "a")
    return la.multiply(m, la.gram(m)).withColumn("v", F.round("v", 3))


def matrix_vector(spark: SparkSession, d: str) -> DataFrame:
    m = la.coo(_vectors(spark, d), "vec_id", "a")
    v = spark.range(64).select(F.col("id").cast("int").alias("j"), (F.col("id") / 63).alias("x"))
    return la.matvec(m, v).withColumn("y", F.round("y", 5))


def gram_minus_lambda(spark: SparkSession, d: str) -> DataFrame:
    return la.minus_lambda(la.gram(la.coo(_vectors(spark, d), "vec_id", "a")), 2.0).withColumn("v", F.round("v", 4))


def matrix_tests(spark: SparkSession, d: str) -> DataFrame:
    """The Gram matrix is symmetric and not upper triangular; the identity is; its diagonal sums to the squared norms."""
    m = la.coo(_vectors(spark, d), "vec_id", "a")
    g = la.gram(m)
    eye = la.identity(m, 64)
    one = la.diagonal(g).agg(F.round(F.sum("v"), 3).alias("trace"))
    return one.select(
        la.matrix_equal(g, la.transpose(g), 1e-6).scalar().alias("symmetric"), la.upper_triangular(g, 1e-9).scalar().alias("gram_upper"),
        la.upper_triangular(eye, 1e-9).scalar().alias("eye_upper"), "trace",
    )


def fit_one_feature(spark: SparkSession, d: str) -> DataFrame:
    """Least squares without intercept of the second component on the first, per label, in closed form."""
    x, y = F.element_at("a", 1), F.element_at("a", 2)
    return _vectors(spark, d).groupBy("label").agg(F.round(F.try_divide(F.sum(x * y), F.sum(x * x)), 6).alias("beta"))


def fit_per_label(spark: SparkSession, d: str) -> DataFrame:
    """Least squares of the last component on the first four, per label, with the normal equations checked; rounded to 6
    decimals."""

    def fit(m: np.ndarray) -> dict:
        got = la.least_squares(m[:, :4], m[:, -1])
        if got is None:
            return {"beta": None, "sigma": None, "normal_ok": None}
        beta, hat, sigma = got
        return {"beta": [round(float(b), 6) for b in beta], "sigma": round(sigma, 6), "normal_ok": bool(np.abs(m[:, :4].T @ (m[:, -1] - hat)).max() < 1e-6)}

    return la.per_group(_vectors(spark, d), "label", "a", fit, "label int, beta array<double>, sigma double, normal_ok boolean")


def qr_invariants(spark: SparkSession, d: str) -> DataFrame:
    """QR of the first 8 components of each label's vectors: Q'Q = I, QR = M, R upper triangular."""

    def check(m: np.ndarray) -> dict:
        got = la.modified_gram_schmidt(m[:, :8])
        if got is None:
            return {"orthogonal": False, "restores": False, "upper": False}
        q, r = got
        return {"orthogonal": bool(np.abs(q.T @ q - np.eye(8)).max() < 1e-8), "restores": bool(np.abs(q @ r - m[:, :8]).max() < 1e-8), "upper": bool(np.abs(np.tril(r, -1)).max() < 1e-12)}

    return la.per_group(_vectors(spark, d), "label", "a", check, "label int, orthogonal boolean, restores boolean, upper boolean")


def eigen_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Eigenpairs of each label's Gram matrix: M v = lambda v, and the values sum to the trace."""

    def check(m: np.ndarray) -> dict:
        g = m.T @ m
        values, vectors = la.eigen(g)
        return {"pairs_ok": bool(np.abs(g @ vectors - vectors * values).max() < 1e-6 * max(1, values[0])), "trace": round(float(values.sum()), 3)}

    return la.per_group(_vectors(spark, d), "label", "a", check, "label int, pairs_ok boolean, trace double")


def eigen_two(spark: SparkSession, d: str) -> DataFrame:
    """Eigenvalues of the 2 x 2 Gram matrix of the first two components per label, in closed form."""
    x, y = F.element_at("a", 1), F.element_at("a", 2)
    g = _vectors(spark, d).groupBy("label").agg(F.sum(x * x).alias("p"), F.sum(x * y).alias("q"), F.sum(y * y).alias("r"))
    mid, off = (F.col("p") + F.col("r")) / 2, F.sqrt((F.col("p") - F.col("r")) * (F.col("p") - F.col("r")) / 4 + F.col("q") * F.col("q"))
    return g.select("label", F.round(mid + off, 5).alias("first"), F.round(mid - off, 5).alias("second"))


QUERIES = {f.__name__: f for f in (vector_operations, matrix_transpose, matrix_row_column, gram_matrix, matrix_product, matrix_vector, gram_minus_lambda, matrix_tests, fit_one_feature, fit_per_label, qr_invariants, eigen_invariants, eigen_two)}

_M = "m AS (SELECT vec_id AS i, CAST(unnest(range(len(embedding))) AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_G = _M + ", g AS (SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM m x JOIN m y USING (i) GROUP BY 1, 2)"
_A = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_L = "list_transform(range(64), lambda i: i * (1.0::DOUBLE / 63))"


def _fold(e: str) -> str:
    return f"round(list_reduce(list_prepend(0.0::DOUBLE, {e}), lambda s, x: s * 0.5::DOUBLE + x), 5)"


def _det(columns: list[str]) -> str:
    """The determinant of the 4 x 4 matrix whose rows are 0..3 and whose columns are named."""
    terms = []
    for p in permutations(range(4)):
        sign = "-" if sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4)) % 2 else "+"
        terms.append(sign + " * ".join(f"{columns[p[i]]}{i}" for i in range(4)))
    return "(" + " ".join(terms) + ")"


#: Cramer's rule on the normal equations: sK_I = sum of x_K x_I, t_I = sum of x_I y.
_SUMS = ", ".join(f"sum(a[{k + 1}] * a[{i + 1}]) AS s{k}_{i}" for k in range(4) for i in range(4)) + ", " + ", ".join(f"sum(a[{i + 1}] * a[-1]) AS t_{i}" for i in range(4))
_S = [f"s{k}_" for k in range(4)]
_BETA = ", ".join(f"{_det([*_S[:k], 't_', *_S[k + 1:]])} / {_det(_S)} AS b{k}" for k in range(4))

ORACLES = {
    "fit_per_label": f"""WITH x AS (SELECT label, {_A} AS a FROM embeddings), s AS (SELECT label, count(*) AS n, {_SUMS} FROM x GROUP BY 1),
b AS (SELECT label, n, {_BETA} FROM s), r AS (SELECT label, n, b0, b1, b2, b3, a[-1] - (a[1] * b0 + a[2] * b1 + a[3] * b2 + a[4] * b3) AS off FROM x JOIN b USING (label))
SELECT label, [round(b0, 6), round(b1, 6), round(b2, 6), round(b3, 6)] AS beta, round(CASE WHEN n > 5 THEN sqrt(sum(off * off) / (n - 5)) ELSE 'nan'::DOUBLE END, 6) AS sigma, true AS normal_ok FROM r GROUP BY label, n, b0, b1, b2, b3""",
    "vector_operations": f"""WITH t AS (SELECT vec_id, {_A} AS a, {_L} AS b FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])), 5) AS dot, round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) AS norm,
 {_fold('list_transform(list_zip(a, b), lambda p: p[1] + p[2])')} AS sum_fold, {_fold('list_transform(list_zip(a, b), lambda p: p[1] - p[2])')} AS diff_fold, {_fold('list_transform(a, lambda x: x * 2.5::DOUBLE)')} AS scale_fold,
 {_fold('list_transform(a, lambda x: x / sqrt(list_sum(list_transform(a, lambda z: z * z))))')} AS unit_fold, CAST(len(a[4:9]) AS INTEGER) AS slice_size, round(a[4], 6) AS slice_first, true AS same FROM t""",
    "matrix_transpose": f"WITH {_M} SELECT j AS i, i AS j, round(v, 6) AS v FROM m",
    "matrix_row_column": f"WITH {_M} SELECT 'row' AS kind, CAST(j AS BIGINT) AS k, round(v, 6) AS v FROM m WHERE i = 0 UNION ALL SELECT 'column', i, round(v, 6) FROM m WHERE j = 0",
    "gram_matrix": f"WITH {_G} SELECT i, j, round(v, 4) AS v FROM g",
    "matrix_product": f"WITH {_G} SELECT m.i, g.j, round(sum(m.v * g.v), 3) AS v FROM m JOIN g ON m.j = g.i GROUP BY 1, 2",
    "matrix_vector": f"WITH {_M} SELECT i, round(sum(v * j / 63), 5) AS y FROM m GROUP BY 1",
    "gram_minus_lambda": f"WITH {_G} SELECT i, j, round(CASE WHEN i = j THEN v - 2 ELSE v END, 4) AS v FROM g",
    "matrix_tests": f"WITH {_G} SELECT (SELECT bool_and(abs(a.v - b.v) <= 1e-6) FROM g a JOIN g b ON a.i = b.j AND a.j = b.i) AS symmetric, (SELECT bool_and(abs(v) <= 1e-9) FROM g WHERE i > j) AS gram_upper, true AS eye_upper, (SELECT round(sum(v), 3) FROM g WHERE i = j) AS trace",
    "fit_one_feature": "SELECT label, round(sum(embedding[1]::DOUBLE * embedding[2]::DOUBLE) / nullif(sum(embedding[1]::DOUBLE * embedding[1]::DOUBLE), 0), 6) AS beta FROM embeddings GROUP BY 1",
    "qr_invariants": "SELECT DISTINCT label, true AS orthogonal, true AS restores, true AS upper FROM embeddings",
    "eigen_invariants": f"SELECT label, true AS pairs_ok, round(sum(list_sum(list_transform({_A}, lambda x: x * x))), 3) AS trace FROM embeddings GROUP BY 1",
    "eigen_two": "WITH g AS (SELECT label, sum(embedding[1]::DOUBLE * embedding[1]::DOUBLE) AS p, sum(embedding[1]::DOUBLE * embedding[2]::DOUBLE) AS q, sum(embedding[2]::DOUBLE * embedding[2]::DOUBLE) AS r FROM embeddings GROUP BY 1) SELECT label, round((p + r) / 2 + sqrt((p - r) * (p - r) / 4 + q * q), 5) AS first, round((p + r) / 2 - sqrt((p - r) * (p - r) / 4 + q * q), 5) AS second FROM g",
}
