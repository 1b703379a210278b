"""Holds a query's rows against DuckDB's over the same Parquet tables."""

import math
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def assert_same(df, sf_dir, sql):
    columns, expected = sql_rows(sf_dir, sql)
    assert sorted(df.columns) == columns
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected
