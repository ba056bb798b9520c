"""Runs a query in both engines and compares the rows."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, (bytearray, memoryview)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, f, sql, sf_dir, files=""):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{files}'")
    cursor = con.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0], f"{name}: columns {got[0]}, not {want[0]}"
    assert len(got[1]) == len(want[1]), f"{name}: {len(got[1])} rows, not {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, f"{name}: {len(bad)} of {len(want[1])} rows differ, first {str(bad[0])[:600]}"
    return len(got[1])
