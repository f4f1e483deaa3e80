"""Every query with SQL equals it on the smallest tables."""

import duckdb
import pytest

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return value.replace(tzinfo=None).isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=str)


def test_pagerank_is_a_distribution(spark):
    rows = catalog.pagerank(spark, SF).collect()
    assert rows and max(r["rank"] for r in rows) == 1.0 and min(r["rank"] for r in rows) > 0
