"""Vector search in blocks, exact quantiles, and sorted places against plain Python."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import merge as M
from graphloom.operators import search as S
from graphloom.shared import placed


def test_vector_top_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(60)] + [(90, None), (91, [0.0] * 5), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [1.0] * 4), (94, [1.0] * 4), (95, [])]
    q = [(i, x) for i, x in v if i % 4 == 1]
    index, asks = spark.createDataFrame(v, "id long, v array<double>").repartition(3), spark.createDataFrame(q, "query long, q array<double>")
    want = []
    for a, x in q:
        near = sorted((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6), b) for b, y in v if x and y and len(x) == len(y) and None not in x and None not in y and any(x) and any(y))
        want += [(a, b, -s, r + 1) for r, (s, b) in enumerate(near[:6])]
    for small in (0, 1 << 20):
        got = S.vector_top(index, asks, 6, rows=7, small_bytes=small)
        assert sorted((r["query"], r["id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)
    assert S.vector_top(index.limit(0), asks, 6).collect() == []


def test_quantiles_of_a_hot_key(spark):
    rnd = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 7}", rnd.choice([None, float(rnd.randrange(50)), rnd.random()]), i) for i in range(400)] + [("none", None, 1), (None, 2.0, 1)]
    got = {r["k"]: (r["a"], r["b"]) for r in M.exact_quantiles(spark.createDataFrame(rows, "k string, x double, t long").repartition(5), "k", "x", "t", {"a": 0.5, "b": 0.95}).collect()}
    of = defaultdict(list)
    for k, x, _ in rows:
        if x is not None:
            of[k].append(x)
    assert {k: g for k, g in got.items() if k} == {k: (round(float(np.quantile(x, 0.5)), 4), round(float(np.quantile(x, 0.95)), 4)) for k, x in of.items() if k}


def test_places(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.randrange(20), i) for i in range(300)]
    df = placed(spark.createDataFrame(rows, "k string, x int, t int").repartition(4), ["k"], [F.desc("x"), F.col("t")])
    of = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-r[1], r[2])):
        of[r[0]].append(r)
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str((*r, i)) for rs in of.values() for i, r in enumerate(rs))
