"""Compares a query with its SQL in DuckDB: names, and rows without regard to order."""

import math
from numbers import Real

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 5) if isinstance(x, Real) and not isinstance(x, bool) else str(x)


def same(spark_df, con, sql: str) -> None:
    names = sorted(spark_df.columns)
    got = [tuple(_cell(r[n]) for n in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    assert sorted(found) == names
    want = [tuple(_cell(r[found.index(n)]) for n in names) for r in cur.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
