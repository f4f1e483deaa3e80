"""Queries against their SQL on rows that the given tables hold rarely: ties of rounding, large groups."""

import shutil

import duckdb
import pytest

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    rel = con.sql(catalog.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
    return got


def test_reading_grades_round_ties_as_sql(spark, tmp_path):
    # Words, sentences and groups of vowels whose grades are ties of a tenth in some roundings.
    text = lambda words, ends, vowels: " ".join(["ba" * (vowels - words + 1)] + ["ba"] * (words - 1)) + "." + " ." * (ends - 1)
    sizes = [(w, s, v) for s in range(1, 8) for w in range(1, 40) for v in range(w, 90, 3)]
    sizes += [(16, 1, 160), (46, 1, 115), (56, 1, 112), (66, 1, 99), (76, 1, 76), (20, 3, 126), (28, 3, 168), (4, 4, 47)]
    spark.createDataFrame([(i, 1, "user", text(*s)) for i, s in enumerate(sizes)] + [(-1, 1, "user", ""), (-2, 1, "user", None)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.sql(catalog.ORACLE_SQL["reading_grades"]).fetchall(), key=str)
    got = catalog.QUERIES["reading_grades"](spark, str(tmp_path)).select("conv_id", "turn", "grade").collect()
    assert sorted((tuple(r) for r in got), key=str) == want


@pytest.fixture
def folder(tmp_path):
    for t in ("part", "supplier", "orders", "lineitem"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    return tmp_path


def test_cap_statistics_takes_large_orders(spark, folder):
    duckdb.sql(f"copy (select * replace (case when l_orderkey < 40 then 1 else l_orderkey end as l_orderkey) from '{SF}/lineitem.parquet') to '{folder}/lineitem.parquet' (format parquet)")
    assert duckdb.sql(f"select count(distinct l_suppkey) from '{folder}/lineitem.parquet' where l_orderkey = 1").fetchall()[0][0] == 10
    duckdb.sql(f"copy (select * replace (l_suppkey + 10 * (l_linenumber % 5) as l_suppkey) from '{SF}/lineitem.parquet') to '{folder}/more.parquet' (format parquet)")
    duckdb.sql(f"copy (select * replace (case when l_orderkey < 40 then 1 else l_orderkey end as l_orderkey) from '{folder}/more.parquet') to '{folder}/lineitem.parquet' (format parquet)")
    assert duckdb.sql(f"select count(distinct l_suppkey) from '{folder}/lineitem.parquet' where l_orderkey = 1").fetchall()[0][0] > 15
    same_as_sql(spark, folder, "cap_statistics", ["lineitem"])
