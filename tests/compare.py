"""Compare a Spark result with DuckDB's answer to the SQL counterpart."""

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(_plain(row[n]) for n in names) for row in df.collect()]
    return names, sorted(rows, key=repr)


def sql_rows(con, sql):
    result = con.execute(sql)
    found = [c[0] for c in result.description]
    names = sorted(found)
    order = [found.index(n) for n in names]
    rows = [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]
    return names, sorted(rows, key=repr)
