"""Similarity of pairs from packed profiles against plain rounds; rows of pairs, terms and ancestors are not made."""

import random

import pytest

from graphloom.operators import ontology as O
from graphloom.operators import packed


def sample():
    rnd = random.Random(4)
    parents = {t: {rnd.randrange(t)} | {rnd.randrange(t)} for t in range(1, 60)}
    ups = {0: {0}}
    for t in range(1, 60):
        ups[t] = {t}.union(*(ups[p] for p in parents[t]))
    rows = [(p, t, rnd.choice([None, 0.0, 0.3, 1.0])) for p in range(40) for t in rnd.sample(range(60), rnd.randrange(1, 9))]
    return parents, ups, [*rows, (90, 5, 0.0)]  # one profile has no weight at all


def frames(spark, parents, rows):
    p = spark.createDataFrame([(a, str(t), f) for a, t, f in rows], "profile long, term string, frequency double").repartition(3)
    closure = O.ancestors(spark.createDataFrame([(str(c), str(x)) for c, up in parents.items() for x in up], "child string, parent string"))
    return p, closure, O.information_content(p, closure)


def plain(ups, ic, rows, a, b):
    w = {}
    for p, t, f in rows:
        w.setdefault(p, {})[t] = max(w.get(p, {}).get(t, 0.0), 0.5 if f is None else f)
    of = {p: {t: x for t, x in ts.items() if x > 0 and ic[t] > 0} for p, ts in w.items()}

    def share(one, two):
        held = set().union(*(ups[t] for t in of.get(two, {})), set())
        den = sum(x * ic[t] for t, x in of.get(one, {}).items())
        return sum(x * min(ic[t], max((ic[u] for u in ups[t] & held), default=0.0)) for t, x in of.get(one, {}).items()) / den if den else 0.0

    return min(1.0, max(0.0, (share(a, b) + share(b, a)) / 2))


def test_equals_plain(spark):
    parents, ups, rows = sample()
    p, closure, ic = frames(spark, parents, rows)
    asked = [(a, b) for a in range(40) for b in range(a + 1, 40)] + [(3, 90), (90, 777)]
    pairs = spark.createDataFrame(asked, "a long, b long")
    known = {int(r["term"]): r["ic"] for r in ic.collect()}
    got = {(r["a"], r["b"]): r["similarity"] for r in O.similarity(p, ic, closure, pairs).collect()}
    assert got == {k: pytest.approx(plain(ups, known, rows, *k), abs=1e-9) for k in asked}
    assert O.similarity(p, ic, closure, pairs.limit(0)).collect() == []


def test_a_pair_is_one_row(spark):
    parents, _, rows = sample()
    p, closure, ic = frames(spark, parents, rows)
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    plan = O.similarity(p, ic, closure, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Generate" not in plan and "Aggregate" not in plan


def test_shared_terms_are_counted_for_similar_pairs_only(spark):
    parents, ups, rows = sample()
    p, closure, ic = frames(spark, parents, rows)
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40)], "a long, b long")
    known = {int(r["term"]): r["ic"] for r in ic.collect()}
    own = {a: {t for x, t, _ in rows if x == a and known[t] >= 2.0} for a in range(40)}
    got = O.similar(p, ic, closure, pairs, 0.3, 1, 1000)
    assert {(r["a"], r["b"]): r["shared"] for r in got.collect()} == {(a, b): len(own[a] & own[b]) for a in range(40) for b in range(a + 1, 40) if own[a] & own[b] and round(plain(ups, known, rows, a, b), 6) >= 0.3}


def test_ranking_judges_only_profiles_that_can_be_among_the_best(spark, monkeypatch):
    rnd = random.Random(6)
    is_a = [(f"t{i}", f"kind{i % 3}") for i in range(60)] + [(f"kind{i}", "root") for i in range(3)]
    rows = [(p, f"t{(p // 4 * 7 + rnd.randrange(9)) % 60}", 0.5) for p in range(200) for _ in range(4)]
    p = spark.createDataFrame(rows, "profile long, term string, frequency double").repartition(3)
    closure = O.ancestors(spark.createDataFrame(is_a, "child string, parent string"))
    ic = O.information_content(p, closure)
    asked = [(q, t, True) for q in range(0, 200, 20) for t in sorted({t for x, t, _ in rows if x == q})] + [(q, f"t{q % 60}", False) for q in range(0, 200, 20)]
    asked += [(q, "kind1", True) for q in range(0, 200, 20)] + [(777, "kind2", True)]  # 777 has wide terms only
    queries = spark.createDataFrame(asked, "query long, term string, present boolean")
    excluded = spark.createDataFrame([(1, "t5"), (21, "kind1"), (60, "t3")], "profile long, term string")
    judged, two_sided = [], O.two_sided
    monkeypatch.setattr(O, "two_sided", lambda a, b, pairs, least: judged.append(pairs.where("a <> 777").count()) or two_sided(a, b, pairs, least))
    got = [sorted(map(tuple, O.rank_profiles(queries, p, excluded, ic, closure, 3, rare=rare).collect())) for rare in (30, 10**6)]
    assert got[0] == got[1] and len(got[0]) == 33
    assert sum(judged[:2]) < judged[2] * 0.8 and len(judged) == 3


def test_dealt_pairs_share_packs(spark, monkeypatch):
    """The same values from tasks of ranges of profiles, where a pack goes to a task once."""
    parents, _, rows = sample()
    p, closure, ic = frames(spark, parents, rows)
    asked = [(a, b) for a in range(40) for b in range(a + 1, 40)] + [(3, 90), (90, 777), (778, 779)]
    pairs = spark.createDataFrame(asked, "a long, b long")
    want = {(r["a"], r["b"]): r["similarity"] for r in O.similarity(p, ic, closure, pairs).collect()}
    monkeypatch.setattr(packed, "DEALT", 100)
    got = O.similarity(p, ic, closure, pairs, True).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(asked)
    assert O.similarity(p, ic, closure, pairs.limit(0), True).collect() == []
