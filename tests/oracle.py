"""Rows of a query and of its SQL in one comparable form."""

import glob
import os

import duckdb


def plain(x):
    if hasattr(x, "asDict") or isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    return float(f"{x:.9g}") if isinstance(x, float) else x


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(sf_dir, sql, tables=()):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, frame in dict(tables).items():
        con.register(name, frame)
    found = con.execute(sql)
    cols = [c[0] for c in found.description]
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(cols), sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)
