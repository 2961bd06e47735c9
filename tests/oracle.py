"""Compare registered queries with their SQL on the same tables."""

import datetime
import decimal
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, _sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(con, sql):
    q = con.sql(sql)
    cols = sorted(q.columns)
    at = [q.columns.index(c) for c in cols]
    return cols, _sorted(tuple(plain(r[i]) for i in at) for r in q.fetchall())
