"""Compares a query of the catalogue with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(df) -> tuple[list[str], list[str]]:
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[str]]:
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())


def agree(spark, con, sf_dir: str, query, sql: str) -> None:
    got, want = rows_of(query(spark, sf_dir)), rows_of_sql(con, sql)
    assert got[0] == want[0]
    assert got[1] == want[1]
