"""Vectors as arrays, matrices as rows (i, j, v), and decompositions per group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def normalize(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), size))


def equal(a: Column, b: Column, tolerance: float) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda e: e)


def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + i * F.lit((high - low) / (n - 1)))


def constant(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(value), n)


def slice_of(a: Column, begin: int, end: int) -> Column:
    return F.slice(a, begin + 1, end - begin)


def coo(df: DataFrame, key: str, column: str) -> DataFrame:
    """Arrays as a matrix: ``i`` is the key, ``j`` the place from 0."""
    return df.select(F.col(key).alias("i"), F.posexplode(column).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def row(m: DataFrame, i: int) -> DataFrame:
    return m.where(F.col("i") == i).select("j", "v")


def column(m: DataFrame, j: int) -> DataFrame:
    return m.where(F.col("j") == j).select("i", "v")


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j").select("i", "v")


def identity(df: DataFrame, n: int) -> DataFrame:
    ids = df.sparkSession.range(n).select(F.col("id").alias("i"))
    return ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))


def with_row(m: DataFrame, i: int, values: DataFrame) -> DataFrame:
    """The matrix with row i replaced by ``values`` (j, v)."""
    return m.where(F.col("i") != i).unionByName(values.select(F.lit(i).alias("i"), "j", "v"))


def with_column(m: DataFrame, j: int, values: DataFrame) -> DataFrame:
    """The matrix with column j replaced by ``values`` (i, v)."""
    return m.where(F.col("j") != j).unionByName(values.select("i", F.lit(j).alias("j"), "v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("v2"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", F.col("j2").alias("j")).agg(F.sum(F.col("v") * F.col("v2")).alias("v"))


def gram(m: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """M'N without forming M'. Without N, the products are summed within each row first: no join."""
    if n is not None:
        right = n.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("v2"))
        return m.join(right, m["i"] == right["k"]).groupBy(F.col("j").alias("i"), F.col("j2").alias("j")).agg(F.sum(F.col("v") * F.col("v2")).alias("v"))
    rows = m.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("r"))
    pairs = rows.select(F.explode("r").alias("a"), "r").select("a", F.explode("r").alias("b"))
    return pairs.groupBy(F.col("a.j").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def matvec(m: DataFrame, v: DataFrame) -> DataFrame:
    """``v`` has j, x."""
    return m.join(v, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def minus_lambda(m: DataFrame, by: float) -> DataFrame:
    return m.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") - by).otherwise(F.col("v")).alias("v"))


def matrix_equal(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """One row ``equal``; an absent cell is 0."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full")
    off = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return both.agg(F.coalesce(F.bool_and(off <= tolerance), F.lit(True)).alias("equal"))


def upper_triangular(m: DataFrame, tolerance: float) -> DataFrame:
    return m.where("i > j").agg(F.coalesce(F.bool_and(F.abs("v") <= tolerance), F.lit(True)).alias("upper"))


def modified_gram_schmidt(m: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Q and R of a matrix, None if a column depends on those before it."""
    q, r = m.astype(float).copy(), np.zeros((m.shape[1], m.shape[1]))
    scale_ = max(np.abs(m).max(initial=0.0), 1e-300)
    for j in range(m.shape[1]):
        r[j, j] = np.linalg.norm(q[:, j])
        if r[j, j] <= 1e-12 * scale_:
            return None
        q[:, j] /= r[j, j]
        r[j, j + 1 :] = q[:, j] @ q[:, j + 1 :]
        q[:, j + 1 :] -= np.outer(q[:, j], r[j, j + 1 :])
    return q, r


def back_substitute(r: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.zeros(len(b))
    for i in range(len(b) - 1, -1, -1):
        x[i] = (b[i] - r[i, i + 1 :] @ x[i + 1 :]) / r[i, i]
    return x


def solve(m: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    qr = modified_gram_schmidt(m)
    return None if qr is None else back_substitute(qr[1], qr[0].T @ b)


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Coefficients without intercept, fitted values, residual scale (nan without spare rows)."""
    beta = solve(x, y)
    if beta is None:
        return None
    fit = x @ beta
    spare = len(y) - x.shape[1] - 1
    return beta, fit, float(np.sqrt(((y - fit) ** 2).sum() / spare)) if spare > 0 else float("nan")


def eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors with a first component of 0 or more, of a symmetric matrix,
    to machine precision: no tolerance or number of rounds is needed."""
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(vectors[0] < 0, -1.0, 1.0)


def per_group(df: DataFrame, group: str, column_: str, f: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Applies f to the matrix of each group's arrays; a group must fit a task, as one dense matrix does."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(np.stack(pdf.sort_values("key")["a"].to_numpy()).astype(float))
        return pd.DataFrame([{group: pdf[group].iloc[0]} | out])

    keyed = df.select(group, F.col(column_).alias("a"), F.monotonically_increasing_id().alias("key"))
    return keyed.groupBy(group).applyInPandas(run, schema)


def gram_by_group(df: DataFrame, group: str, column_: str) -> DataFrame:
    """``group``, ``i``, ``j``, ``v``: the Gram matrix of each group, summed where the rows lie."""
    cells = df.select(group, F.posexplode(column_).alias("i", "x"), F.col(column_).alias("a"))
    pairs = cells.select(group, "i", "x", F.posexplode("a").alias("j", "y"))
    return pairs.groupBy(group, "i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("v"))
