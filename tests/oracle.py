"""Runs a query and its SQL over the same tables and compares rows as multisets, columns by name."""

import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        p = f"{sf}/{t}/*.parquet" if os.path.isdir(f"{sf}/{t}") else f"{sf}/{t}"
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(spark, con, query, sql, sf):
    df = query(spark, sf)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
