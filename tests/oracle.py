"""Compares a query with its SQL in another engine: same columns, same rows, order left out."""

import glob
import os

import duckdb


def normal(v):
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    return str(v)


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(d + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(spark, d, query, sql):
    df = query(spark, d)
    cols = sorted(df.columns)
    ours = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    result = connect(d).execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(normal(r[i]) for i in at) for r in result.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
    return len(ours)
