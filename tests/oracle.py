"""Comparing a query with its SQL in DuckDB, without regard to the order of rows."""

import os

import duckdb


def _norm(x):
    if x is None or x != x:
        return "None"
    if isinstance(x, float):
        return f"{round(x, 5):g}"
    if hasattr(x, "tolist"):
        return str([_norm(v) for v in x.tolist()])
    if isinstance(x, (list, tuple)):
        return str([_norm(v) for v in x])
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("+00:00", "").split(".")[0]
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
    return len(got)
