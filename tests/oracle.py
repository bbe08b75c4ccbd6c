"""Runs a query and its DuckDB SQL over the same tables and compares rows, order-insensitively."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in records), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(df, con, sql):
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want.fetchall())
    assert len(got) == len(expected), (len(got), len(expected))
    for a, b in zip(got, expected, strict=True):
        assert a == b, (a, b)
