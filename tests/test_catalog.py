"""Queries against their SQL, on the small test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from caseweave import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    result = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted((tuple(plain(x) for _, x in sorted(zip(columns, r, strict=True))) for r in result.fetchall()), key=repr)
    df = catalog.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalog.ORACLE_SQL) > 100
