"""Rows of a Spark query against those of its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    ours = _sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = _sorted(tuple(plain(r[k]) for k in at) for r in cursor.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
