"""Runs a query and its SQL on the same tables and compares rows."""

import datetime
import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def compare(spark, con, query, sql, sf=SF):
    df = query(spark, sf)
    names = sorted(df.columns)
    cur = con.execute(sql)
    other = [d[0] for d in cur.description]
    assert sorted(other) == names
    want = sorted((tuple(plain(r[other.index(n)]) for n in names) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == want
