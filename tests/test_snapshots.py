"""Snapshots: gate, torn writes, damage; version differences and refresh."""

import pathlib

import pytest
from pyspark.sql import functions as F

from graphloom.operators import versions as V
from graphloom.sinks import contract as W

NODES = "id string, label string, type string, extra int"


def nodes(spark, n=20):
    rows = [(f"n{i}", f"label {i}", None if i % 3 else "gene", i) for i in range(n)] + [("n1", "a label", "gene", 1), (None, "x", "y", 1)]
    return W.coerced(spark.createDataFrame(rows, NODES).repartition(3), "nodes")


def test_contract_rows(spark):
    df = nodes(spark)
    assert df.columns == W.CONTRACT["nodes"] and df.count() == 20
    assert df.where("id = 'n1'").first()["label"] == "a label"  # the row that knows its type
    empty = W.coerced(spark.createDataFrame([], "source_id string, target_id string, relation string"), "assertions")
    assert empty.collect() == [] and empty.columns == W.CONTRACT["assertions"]


def test_publish_needs_validation_and_reads_back(spark, tmp_path):
    root, tables = f"file://{tmp_path}/s", {"nodes": nodes(spark)}
    with pytest.raises(W.Refused):
        W.publish(tables, root, "v1")  # never validated
    W.validate(tables, {"ids": tables["nodes"].where("id = 'n3'")}, root)
    with pytest.raises(W.Refused):
        W.publish(tables, root, "v1")  # a check found a row
    other = {"nodes": tables["nodes"].where("id <> 'n3'")}
    W.validate(other, {"ids": other["nodes"].where("id = 'n3'")}, root)
    with pytest.raises(W.Refused):
        W.publish({"nodes": other["nodes"].where("id <> 'n4'")}, root, "v1")  # passed, but for other rows
    folder = W.publish(other, root, "v1", rows_a_file=4)
    back = W.load(spark, root)["nodes"]
    assert sorted(map(str, back.collect())) == sorted(map(str, other["nodes"].collect()))
    told = spark.read.parquet(f"{folder}/_manifest").collect()
    assert sum(r["rows"] for r in told) == 19 and len(told) > 3 and all(len(r["sha256"]) == 64 and r["bytes"] > 0 for r in told)
    assert W.damage(spark, root).collect() == []
    (pathlib.Path(folder.removeprefix("file://")) / "nodes" / told[0]["file"]).unlink()
    assert [(r["file"], r["fault"]) for r in W.damage(spark, root).collect()] == [(told[0]["file"], "missing")]
    with pytest.raises(LookupError):
        W.published(spark, root, "v9")


def test_a_torn_write_is_never_seen(spark, tmp_path):
    root, first = f"file://{tmp_path}/s", {"nodes": nodes(spark)}
    W.validate(first, {}, root)
    W.publish(first, root, "v1")

    def broken(batches):
        yield from batches
        raise ValueError("lost")

    torn = {"nodes": first["nodes"], "synonyms": first["nodes"].mapInArrow(broken, first["nodes"].schema)}
    with pytest.raises(Exception, match="lost"):
        W.publish(torn, root, "v2")
    assert W.published(spark, root).split("/")[-1].startswith("v1-") and set(W.load(spark, root)) == {"nodes"}


def test_csv_has_empty_fields_for_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None, [1, 2]), ('q"x,y', "", None)], "id string, label string, at array<int>")
    W.write_csv(df.coalesce(1), ["at", "id", "label"], f"file://{tmp_path}/c")
    lines = sorted(x for p in tmp_path.glob("c/*.csv") for x in p.read_text().splitlines())
    assert lines == ['"[1,2]",a,', ',"q""x,y",', "at,id,label"]


def test_changes_and_refresh(spark):
    schema = "k long, a string, b double, c int"
    old = spark.createDataFrame([(1, "x", 1.0, 0), (2, None, 2.0, 0), (3, "z", None, 0), (4, "w", 4.0, 0), (None, "n", 1.0, 0)], schema)
    new = spark.createDataFrame([(1, "x", 1.0, 9), (2, "y", 3.0, 0), (3, "z", None, 0), (5, None, None, 0)], schema)
    got = {r["k"]: (r["change"], list(r["fields"])) for r in V.changes(old, new, "k", ["a", "b"]).collect()}
    assert got == {2: ("changed", ["a", "b"]), 4: ("gone", []), 5: ("added", [])}
    seen = []

    def compute(df):
        seen.append(sorted(r["k"] for r in df.collect()))
        return df.groupBy("k").agg(F.sum("b").alias("s"))

    first = old.where("k is not null").groupBy("k").agg(F.sum("b").alias("s"))
    rows = V.refreshed(first, new, V.changes(old, new, "k", ["a", "b"]), "k", compute)
    assert {r["k"]: r["s"] for r in rows.collect()} == {1: 1.0, 2: 3.0, 3: None, 5: None} and seen == [[2, 5]]
    assert V.changes(old.limit(0), new.limit(0), "k", ["a"]).collect() == []
