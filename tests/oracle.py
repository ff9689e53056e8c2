"""Comparison of a query's rows with its SQL's."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, Decimal):
        return float(v)
    return round(v, 6) if isinstance(v, float) else v


def same(df, sql, sf_dir):
    got = [tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    rel = connection(sf_dir).sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = [tuple(_plain(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
