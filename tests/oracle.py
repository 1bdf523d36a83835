"""Runs a query and its SQL over the same tables."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{f + ('/*.parquet' if os.path.isdir(f) else '')}'")
    return con


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def same(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    have = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert have == want
    return have
