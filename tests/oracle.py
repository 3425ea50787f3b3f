"""Rows of a query and of its SQL, made comparable."""

import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def _key(row):
    return tuple((v is not None, isinstance(v, str), v) if v is not None else (False, False, 0) for v in row)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=_key)


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    got = con.execute(sql)
    at = {d[0]: i for i, d in enumerate(got.description)}
    names = sorted(at)
    return names, sorted((tuple(_plain(r[at[c]]) for c in names) for r in got.fetchall()), key=_key)
