"""Links of sources, qualification and choice of genes and pathways on small tables with nulls, repeats and nothing."""

from graphloom.operators import eligible as L


def test_links_are_resolved_and_told_apart(spark):
    rows = [("a", "X:1", "g1", None, "r", "supports", "d"), ("a", "X:1", "g1", "zz", "r", "contradicts", "e"), ("b", "X:1", None, "sym", "r", "supports", None), ("b", "X:9", "g1", None, "r", "supports", None), ("b", None, "g1", None, "r", "supports", None), ("b", "X:1", None, "none", "r", "supports", None), ("b", "X:1", "g1", None, "r", None, None)]
    df = spark.createDataFrame(rows, "source string, raw string, gene string, symbol string, ref string, polarity string, detail string")
    ids = spark.createDataFrame([("X:1", "D:2"), ("X:1", "D:1"), (None, "D:3")], "raw string, id string")
    genes = spark.createDataFrame([("sym", "g7"), ("sym", "g6"), (None, "g5")], "symbol string, gene string")
    known = L.resolved(df, ids, genes)
    assert sorted(tuple(r) for r in L.links(known).collect()) == [("D:1", "g1", "a", "r", "contradicts", "e"), ("D:1", "g6", "b", "r", "supports", None)]
    assert sorted(tuple(r) for r in L.unlinked(known).collect()) == [("a", 2, 0), ("b", 4, 3)]
    assert L.links(L.resolved(df.limit(0), ids, genes)).collect() == []


def test_variant_links_count_each_variant_once(spark):
    v = [("g", ["a", "a", "b"], f"v{i}") for i in range(9)] + [("g", ["a"], "v0"), ("g", None, "v1"), (None, ["a"], "v2"), ("h", ["a"], "v3"), ("h", ["a"], "v3"), ("g", ["c"], None)]
    got = L.variant_links(spark.createDataFrame(v, "gene string, ids array<string>, variant string"), spark.createDataFrame([("a",), ("c",), ("a",)], "id string")).collect()
    assert [(r["id"], r["gene"], r["n"], r["firsts"]) for r in got] == [("a", "g", 9, ["v0", "v1", "v2", "v3", "v4"])]


def test_first_failing_rule_is_named(spark):
    terms = [(1, "Plain", True, None, False), (2, "Susceptibility to x", True, None, None), (3, "Group", True, None, False), (4, "Some CANCER", True, None, False), (5, "Some cancer", True, ["ORPHA:5", None], False), (6, None, None, None, False), (7, "x", True, [], False), (8, "x", True, [], False), (9, "x", True, [], True), (10, "x", True, [], False)]
    t = spark.createDataFrame(terms, "id long, label string, rare boolean, matches array<string>, deprecated boolean")
    genes = [(i, "g", "OMIM:1" if i != 6 else "ICD:1") for i in (1, 2, 3, 4, 5, 6, 7, 9)] + [(1, "g", "ORPHA:1"), (1, "old", "OMIM:1"), (8, "old", "OMIM:8"), (8, None, "ORPHA:8"), (10, "g", None)]
    sg = spark.createDataFrame(genes, "id long, gene string, key string")
    ph = spark.createDataFrame([(i, "p") for i in range(1, 11) if i != 7] + [(7, None), (1, "q"), (1, "q")], "id long, term string")
    ok, below = spark.createDataFrame([("g",), ("g",)], "gene string"), spark.createDataFrame([(3, 31), (1, 30)], "term long, n long")
    keys = spark.createDataFrame([(1, "OMIM:3")], "id long, key string")
    v = L.qualify(t, below, sg, keys, ph, ok)
    assert sorted(tuple(r) for r in v.collect()) == [(1, "omim_and_orpha", 1, 2, None), (2, "omim_only", 1, 1, "label is no disease"), (3, "omim_only", 1, 1, "too many descendants"), (4, "omim_only", 1, 1, "label needs a registry"), (5, "omim_only", 1, 1, None), (6, "orpha_only", 1, 1, "not rare"), (7, "omim_only", 1, 0, "no phenotype"), (8, "omim_and_orpha", 0, 1, "no approved gene")]
    report = {(r["section"], r["name"]): (r["n"], r["firsts"]) for r in L.qualified_report(v, sg, ph, ok).collect()}
    assert report[("out", "not rare")] == (1, ["6"]) and report[("in", "omim_only")] == (1, None)
    assert {k[1]: n for k, (n, _) in report.items() if k[0] == "total"} == {"genes": 1, "most ids of a gene": 2, "phenotypes": 2, "links of withdrawn genes": 2}
    empty = {(r["section"], r["name"]): r["n"] for r in L.qualified_report(v.limit(0), sg, ph, ok).collect()}
    assert empty == {("total", "genes"): 0, ("total", "most ids of a gene"): 0, ("total", "phenotypes"): 0, ("total", "links of withdrawn genes"): 2}
    seeds = spark.createDataFrame([(3,), (9,), (3,)], "id long")
    assert sorted(tuple(r) for r in L.eligible(t, below, seeds).collect()) == [(i, i == 3) for i in (1, 2, 3, 4, 5, 7, 8, 10)]
    assert {r["id"] for r in L.eligible(t, below, seeds, require_rare=False).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 10}


def test_genes_and_pathways(spark):
    pair = lambda x: spark.createDataFrame(x, "id long, gene string")
    ids = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id long")
    pairs = pair([(1, "b"), (1, "a"), (2, "a"), (2, "c"), (2, "c"), (3, "x"), (3, "y"), (3, "z"), (4, "q"), (1, None)])
    seeds = spark.createDataFrame([("s",), ("c",), ("c",), (None,)], "gene string")
    chosen = lambda most: sorted(tuple(r) for r in L.select_genes(ids, seeds, pairs, 2, most).collect())
    assert chosen(3) == [("a", False, 2), ("c", True, 1), ("s", True, 0)]
    assert chosen(1) == [("c", True, 1), ("s", True, 0)] and len(chosen(99)) == 4
    assert {r["gene"] for r in L.focus_genes(ids, pair([(1, "own"), (2, None)]), pairs, 2).collect()} == {"own", "a", "c"}
    m = [(p, g) for p, n in (("p", 3), ("q", 5), ("r", 9), ("one", 1)) for g in [f"g{i}" for i in range(n)]] + [("p", "g0"), (None, "g0"), ("p", None), ("t", "g3"), ("t", "g4")]
    scope, focus = spark.createDataFrame([("g0",), ("g3",), ("g4",)], "gene string"), spark.createDataFrame([("g0",)], "gene string")
    got = sorted(tuple(r) for r in L.scoped_pathways(spark.createDataFrame(m, "pathway string, gene string"), scope, focus, 8, 4).collect())
    assert got == [("one", "g0", 1, "focus"), ("p", "g0", 3, "focus"), ("q", "g0", 5, "focus"), ("t", "g3", 2, "core"), ("t", "g4", 2, "core")]
