"""Cheapest paths against plain enumeration on small graphs."""

import math
import random

import pytest

from graphloom.operators import paths as P

EDGES = "id string, source_id string, target_id string, confidence double, origin string, status string, n_evidence long, extra int"


def graph(seed):
    rnd = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(14)]
    edges = []
    for i in range(46):
        a, b = rnd.choice(nodes), rnd.choice(nodes)
        edges.append((f"e{i:02d}", a, b, rnd.choice([0.5, 0.6, 0.7, 0.9, 1.0]), rnd.choice(["observed", "inferred"]), "active" if rnd.random() < 0.9 else "pending_review", rnd.randrange(1, 4), 1))
    generic = {n: rnd.randrange(1, 12) for n in nodes[::2]}
    return nodes, edges, generic


def plain(edges, generic, hub, pairs, hops, k):
    best = {}
    for i, a, b, c, origin, status, n, _ in edges:
        if status == "active" and a != b and c >= 0.6:
            for key in ((a, b), (b, a)):
                one = (-math.log(c), -n, i, c, origin == "observed")
                best[key] = min(best.get(key, one), one)
    out = []
    for s, t in pairs:
        found, todo = [], [([s], [], 0.0)]
        while todo:
            ns, es, pen = todo.pop()
            for (a, b), e in best.items():
                if a == ns[-1] and b not in ns:
                    if b == t:
                        found.append((ns + [b], es + [e], pen))
                    elif len(es) + 1 < hops and not (b in generic and generic[b] >= hub):
                        todo.append((ns + [b], es + [e], pen + (0.4 * math.log(max(generic[b], 1)) if b in generic else 0)))
        found.sort(key=lambda f: (round(sum(e[0] for e in f[1]) + f[2], 9), ">".join(f[0])))
        out += [(s, t, r + 1, round(sum(e[0] for e in f[1]), 6), min(e[3] for e in f[1]), all(e[4] for e in f[1]), len(f[1]), ">".join(f[0])) for r, f in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,hops,k", [(1, 4, 3), (2, 2, 5)])
def test_paths_equal_enumeration(spark, seed, hops, k):
    nodes, edges, generic = graph(seed)
    pairs = [(a, b) for a in nodes[:4] for b in nodes[6:9]] + [("n00", "n00"), ("n00", "nowhere")]
    df = spark.createDataFrame(edges, EDGES)
    got = P.k_cheapest(df, spark.createDataFrame(pairs, "source string, target string"), hops, k, spark.createDataFrame(list(generic.items()), "node string, degree long"), spark.createDataFrame([(9,)], "threshold long"))
    rows = sorted((r["source"], r["target"], r["rank"], abs(r["total_cost"]), r["min_confidence"], r["all_observed"], r["hops"], r["nodes"]) for r in got.collect())
    want = [(*w[:3], abs(w[3]), *w[4:]) for w in plain(edges, generic, 9, [p for p in pairs if p[0] != p[1]], hops, k)]
    assert rows == want and len(rows) > 5


def test_no_edges_no_paths(spark):
    none = spark.createDataFrame([], EDGES)
    pairs = spark.createDataFrame([("a", "b")], "source string, target string")
    assert P.k_cheapest(none, pairs, 3, 2, spark.createDataFrame([], "node string, degree long")).collect() == []
    covered = P.coverage(pairs, pairs.limit(0), none, spark.createDataFrame([("x", "db", 2)], "edge_id string, source_type string, n long"))
    assert [tuple(r) for r in covered.collect()] == [("a", "b", "no_supported_route", "db", 0)]
