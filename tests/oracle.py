"""Comparison of a query's rows with those of its SQL, whatever their order."""

import glob
import math
import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, (int, bool, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def connection(data=DATA):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def differences(df, con, sql):
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    return list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
