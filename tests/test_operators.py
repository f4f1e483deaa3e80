"""Operators on small invented tables: deep hierarchies, unicode, empty and null rows."""

import unicodedata

from pyspark.sql import functions as F

from graphloom.functions import parsing as P
from graphloom.operators import account, merge, ontology, validate, xref


def test_closure_of_a_deep_chain_with_a_cycle(spark):
    edges = [(f"t{i}", f"t{i + 1}") for i in range(15)] + [("x", "y"), ("y", "x")]
    got = {tuple(r) for r in ontology.ancestors(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert got == {(f"t{i}", f"t{j}") for i in range(16) for j in range(i + 1, 16)} | {("x", "y"), ("y", "x")}
    assert ontology.ancestors(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_names_follow_unicode(spark):
    texts = ["Ångström–Straße", "ﬁne Ⅳ", "Ελλάς ΐ", "a\u0301e\u0301", "ＡＢＣ", "x+Y  z", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", P.unmarked(F.col("t")).alias("u"), P.normal_name(F.col("t")).alias("n"), P.composed_text(F.col("t")).alias("c")).collect()
    for r in rows:
        t = texts[r["i"]]
        want = None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        assert r["u"] == want and (t is None) == (r["n"] is None)
    by = {r["i"]: r for r in rows}
    assert by[0]["n"] == "angstrom stra e" and by[1]["n"] == "fine iv" and by[5]["n"] == "x+y z" and by[4]["c"] == "ABC" and by[0]["c"] == "Ångström-Straße"


def test_parsers_give_null_for_what_they_do_not_know(spark):
    df = spark.createDataFrame([("", ""), (None, None), ("HP:0040282", "1/0"), ("3/4", "12.5%"), ("-", "n")], "a string, b string")
    got = df.select(P.coded_frequency(F.col("a")).alias("a"), P.coded_frequency(F.col("b")).alias("b"), P.refseq_chromosome(F.col("a")).alias("c"), P.orcid(F.col("b")).alias("o"), P.exact_xref(F.col("a")).alias("x")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(None, None), (None, None), (0.55, None), (0.75, 0.125), (None, None)]
    assert not any(r["c"] or r["o"] or r["x"] for r in got)


def test_lineages_that_break(spark):
    is_a = spark.createDataFrame([("a", "b"), ("b", "R")], "child string, parent string")
    lines = spark.createDataFrame([("a", ["a", "b", "R"]), ("c", ["c", "R"]), ("d", []), ("e", ["a", "b"])], "term string, path array<string>")
    assert {r["term"] for r in validate.broken_lineage(lines, is_a, "R").collect()} == {"c", "d", "e"}


def test_empty_tables(spark):
    pairs = spark.createDataFrame([], "ext string, id string")
    assert xref.cross_reference(pairs, pairs, pairs.select("id")).count() == 0
    assert merge.cap_statistics(spark.createDataFrame([], "a int, b int, score double"), 3).first()["kept"] == 0
    calls = spark.createDataFrame([], "call_id int, subjects array<int>")
    assert account.follow_calls(spark.createDataFrame([], "user int, subject int"), calls).count() == 0
