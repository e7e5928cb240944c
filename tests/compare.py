"""Compares a query with DuckDB SQL on the same tables, as sets of rows."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
