"""Comparison of a query's rows with those of its SQL in DuckDB, over the same files."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value) -> str:
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, list):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert ours == theirs
