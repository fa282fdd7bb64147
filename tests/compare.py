"""Runs a query and its SQL over the same tables and compares rows, whatever their order."""

import datetime
import os

import duckdb

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if v == v else "nan"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return plain(v.item()) if hasattr(v, "item") else v


def assert_same(spark, query, sql, folder=DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = query(spark, folder)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = got.collect()
    a = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    b = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in want)
    assert a == b
