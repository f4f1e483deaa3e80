"""Graph checks and thread lists on small tables with nulls, ties and nothing."""

import random
from datetime import datetime, timedelta

from graphloom.operators import account as A
from graphloom.operators import gates as G


def names(spark):
    nodes = spark.createDataFrame([("A:1", "Alpha"), ("A:2", "alpha"), ("A:3", "a:1"), ("A:4", None), ("A:5", " ")], "id string, label string")
    return G.resolver(nodes, spark.createDataFrame([("A:4", "ALPHA"), ("A:4", "Delta "), ("A:5", "delta"), (None, "x")], "node_id string, synonym string"))


def test_names_by_priority(spark):
    got = {r["name"]: r["id"] for r in names(spark).collect()}
    assert got == {"a:1": "A:1", "a:2": "A:2", "a:3": "A:3", "a:4": "A:4", "a:5": "A:5", "alpha": "A:1", "delta": "A:4"}


def test_golden_facts_and_counterexamples(spark):
    edges = spark.createDataFrame([("A:1", "r", "A:2", 0.9), ("A:2", "r", "A:1", 0.1), ("A:3", "r", "A:4", 0.5)], "source_id string, relation string, target_id string, confidence double")
    facts = [("Alpha", "r", "A:2"), ("a:2", "r", "ALPHA"), ("A:3", "r", "delta"), ("A:1", "s", "A:2"), ("nobody", "r", "A:1"), (None, "r", "A:1")]
    got = {(r["a"], r["relation"], r["b"]): r["status"] for r in G.golden(spark.createDataFrame([*facts, facts[0]], "a string, relation string, b string"), names(spark), edges).collect()}
    assert got == dict(zip(facts, ["ok", "ok", "weak", "missing", "unknown name", "unknown name"], strict=True))
    pairs = [("A:1", "A:2"), ("A:2", "A:3"), ("A:1", "A:4"), ("A:1", "A:3"), ("A:1", "zz")]
    clusters = spark.createDataFrame([("A:1", 1), ("A:2", 2), ("A:3", 1)], "node string, cluster long")
    links = spark.createDataFrame([("A:2", "A:1"), ("A:1", "A:3")], "a string, b string")
    seen = {(r["a"], r["b"]): r["status"] for r in G.counterexamples(spark.createDataFrame(pairs, "a string, b string"), names(spark), clusters, links).collect()}
    assert seen == dict(zip(pairs, ["ok", "not linked", "no cluster", "same cluster", "unknown name"], strict=True))


def test_coverage_and_inferred_edges(spark):
    core = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "x", "g"), ("y", "a", "s"), ("b", "y", "g"), ("z", "z", "s")], "source_id string, target_id string, relation string")
    assert tuple(G.core_coverage(core, edges, {"genes": ["g"], "symptoms": ["s", "t"]}).first()) == (3, 2, 1, 1)
    assert tuple(G.core_coverage(core.limit(0), edges.limit(0), {"genes": ["g"]}).first()) == (0, 0, 0)
    rows = [(1, "w", "inferred", 0.9, None), (2, "r", "inferred", 0.5, '{"method":"m","basis":"b","explanation":"e"}'), (3, "r", "observed", 1.0, None), (4, "r", "inferred", 0.5, "not json")]
    found = G.inferred_faults(spark.createDataFrame(rows, "id long, relation string, origin string, confidence double, features string"), ["w"])
    assert sorted((r["id"], r["fault"]) for r in found.collect()) == [(1, "confidence over the cap"), (1, "no explanation"), (1, "no features"), (1, "no method or basis"), (1, "weak relation too confident"), (4, "no explanation"), (4, "no method or basis")]


def test_thread_list_counts_unread(spark):
    rnd, start = random.Random(2), datetime(2024, 1, 1)
    at = lambda: start + timedelta(minutes=rnd.randrange(40))  # noqa: E731  many ties
    sent = [(rnd.choice(["busy", "busy", "quiet"]), rnd.randrange(4), at()) for _ in range(120)]
    reads = [(t, u, at()) for t in ("busy", "quiet") for u in (0, 1, 9)] + [("busy", 1, at()), ("busy", 2, None), ("empty", 0, at())]
    threads = [(t, u) for t in ("busy", "quiet", "empty") for u in (0, 1, 2, 9)]
    df = A.thread_list(spark.createDataFrame(threads, "thread string, user long"), spark.createDataFrame(sent, "thread string, user long, sent_at timestamp").repartition(3), spark.createDataFrame(reads, "thread string, user long, read_at timestamp"))
    got = {(r["thread"], r["user"]): (r["unread"], r["last"], r["wrote"]) for r in df.collect()}
    want = {}
    for t, u in threads:
        read = max((r[2] for r in reads if r[:2] == (t, u) and r[2]), default=None)
        own = [m for m in sent if m[0] == t]
        want[t, u] = (sum(m[1] != u and (read is None or m[2] > read) for m in own), max((m[2] for m in own), default=None), any(m[1] == u for m in own))
    assert got == want
