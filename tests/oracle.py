"""Comparison of a query with its SQL on the driver's tables."""

import datetime
import math
from functools import cache

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return float(value) if hasattr(value, "as_tuple") else value


@cache
def connection(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def differences(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = connection(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())
    return [] if found == wanted else [sorted(set(found) - set(wanted))[:3], sorted(set(wanted) - set(found))[:3], (len(found), len(wanted))]
