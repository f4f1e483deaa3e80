"""Signed clustering against plain quality sums and rules."""

import random
from collections import defaultdict

import pytest

from graphloom.operators import clusters as L
from graphloom.plans.clusters import _signed_links

SCHEMA = "a long, b long, positive double, negative double"


def planted(groups=3, size=8, seed=2):
    rnd = random.Random(seed)
    links = []
    for i in range(groups * size):
        for j in range(i):
            inside = i // size == j // size
            if rnd.random() < (0.7 if inside else 0.04):
                links.append((j, i, round(rnd.uniform(0.5, 1.0), 3), 0.0))
            elif not inside and rnd.random() < 0.05:
                links.append((j, i, 0.0, 1.5))
    return links


def quality(links, of, resolution=1.0):
    total = 0.0
    for sign, at in ((1, 2), (-1, 3)):
        k, inner, m2 = defaultdict(float), 0.0, 0.0
        for x in links:
            k[of[x[0]]] += x[at]
            k[of[x[1]]] += x[at]
            inner += 2 * x[at] * (of[x[0]] == of[x[1]])
            m2 += 2 * x[at]
        total += sign * (inner - resolution * sum(v * v for v in k.values()) / (m2 or 1))
    return total


def found(spark, links, nodes, parts=3, **options):
    rows = L.leiden(spark.createDataFrame(links, SCHEMA).repartition(parts), spark.createDataFrame([(n,) for n in nodes], "node long"), **options).collect()
    assert sorted(r["node"] for r in rows) == sorted(nodes)
    return {r["node"]: r["cluster"] for r in rows}


def test_as_good_as_planted_groups_and_no_single_move_is_better(spark):
    links, nodes = planted(), [*range(24), 99]
    of = found(spark, links, nodes)
    assert of[99] == 99  # no links
    best = quality(links, of)
    assert best >= quality(links, {i: i // 8 for i in range(24)} | {99: 99}) - 1e-6  # at least as good as the groups put in
    for node in range(24):
        for to in {*of.values(), -1}:
            assert quality(links, of | {node: to}) <= best + 1e-5
    assert of == found(spark, links, nodes, parts=7)  # whatever the partitions


def test_clusters_are_connected(spark):
    """On a sparse random graph every cluster is one piece."""
    rnd = random.Random(5)
    links = [(min(i, j), max(i, j), 1.0, 0.0) for i, j in {tuple(sorted(rnd.sample(range(24), 2))) for _ in range(45)}]
    of = found(spark, links, range(24))
    near = defaultdict(set)
    for a, b, *_ in links:
        near[a].add(b)
        near[b].add(a)
    for c in set(of.values()):
        inside = {n for n in of if of[n] == c}
        seen, todo = set(), [min(inside)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n] & inside
        assert seen == inside


def test_forbidden_pairs_are_parted(spark):
    """One dense group with forbidden pairs: each node moves to its best allowed cluster."""
    links = [(i, j, 1.0, 0.0) for j in range(12) for i in range(j)] + [(i, j, 1.0, 0.0) for j in range(20, 26) for i in range(20, j)]
    links = [x for x in links if x[:2] not in {(0, 1), (2, 3)}] + [(0, 1, 0.0, 2.0), (2, 3, 0.0, 2.0), (2, 20, 1.0, 0.0)]
    links = [x for x in links if x[:2] not in {(2, 5), (2, 6)}]
    nodes = spark.createDataFrame([(n, 0 if n < 12 else 20) for n in [*range(12), *range(20, 26)]], "node long, cluster long")
    of = {r["node"]: r["cluster"] for r in L.parted(spark.createDataFrame(links, SCHEMA), nodes).collect()}
    assert of[0] != of[1] and of[2] != of[3] and of[2] == of[20]  # 2 has fewer ties than 3, one of them to 20's cluster; 1 has none elsewhere
    assert all(of[i] == of[4] for i in range(4, 12))


def test_signed_clusters_of_odd_input(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,), (3,)], "node long")
    none = spark.createDataFrame([], SCHEMA)
    assert sorted(map(tuple, L.signed_clusters(none, nodes).collect())) == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]
    odd = spark.createDataFrame([(1, 2, 1.0, None), (2, 1, None, 3.0), (3, 3, 9.0, None)], SCHEMA)  # pull and push at once, a loop
    got = {r["node"]: r["cluster"] for r in L.signed_clusters(odd, nodes).collect()}
    assert got[1] != got[2] and got[3] == 3
    assert L.signed_clusters(none, nodes.limit(0)).collect() == []


def test_links_of_a_supplier_of_many_parts_are_whole(spark, tmp_path):
    """Seventy parts of one supplier make all their pairs."""
    spark.range(140).selectExpr("7L AS l_suppkey", "id % 70 AS l_partkey", "IF(id % 2 = 0, 'A', 'N') AS l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
    links = _signed_links(spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"]) for r in links} == {(a, b) for b in range(70) for a in range(b)} and len(links) == 70 * 69 // 2
    assert all(r["positive" if (r["a"] + r["b"]) % 2 == 0 else "negative"] > 0 for r in links)
