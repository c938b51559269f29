"""Compares a query with its SQL on DuckDB: same columns, same rows in any order."""

import decimal
import glob
import os

import duckdb

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connection(root):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def assert_matches(spark, query, sql, root):
    df = query(spark, root)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = connection(root)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
