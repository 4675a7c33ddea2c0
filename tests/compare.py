"""Runs a query and its SQL in DuckDB over the same Parquet tables and tells how they differ."""

import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return tuple(sorted((k, plain(x)) for k, x in v.items())) if isinstance(v, dict) else v


def difference(df, con, sql):
    """None if equal as bags of rows with columns by name, else what differs."""
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    got = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in want), key=repr)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if repr(g) != repr(w) and g != w]
    return f"{len(bad)} of {len(got)} rows, {order}: {bad[:2]}" if bad else None
