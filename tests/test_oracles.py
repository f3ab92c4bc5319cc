"""Every query with SQL against DuckDB on the same tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(r[i], 6) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    wanted = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(wanted.fetchall(), wanted.columns)
    assert a == b, (list((a - b).items())[:5], list((b - a).items())[:5])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
