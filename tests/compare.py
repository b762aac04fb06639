"""A query against its SQL in DuckDB over the same tables, as the driver compares them."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np

SMALL = "/root/testdata/sf0.001"


def connect(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_plain, v)) + "]"
    if v is None or v != v:
        return "null"
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in data)


def assert_same(spark, con, query, sql: str, folder: str = SMALL) -> None:
    df = query(spark, folder)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = got.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want)
