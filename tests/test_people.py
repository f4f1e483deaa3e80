"""People, follow-up questions, expert clusters and ids in queries on small tables with nulls, ties and nothing."""

import random

from graphloom.functions import parsing as P
from graphloom.operators import people as H
from pyspark.sql import functions as F


def test_people_of_a_common_name(spark):
    rnd = random.Random(2)
    people = [(i, f"R{i}" if i % 4 else None, rnd.choice(["a b", "a b", "a b", "c d", "", None])) for i in range(300)]
    places = [(i, rnd.choice(["x", "y", "z", None])) for i in range(300) for _ in range(2)]
    asks = [(1, "R7", "a b"), (2, None, "a b"), (3, "R9", None), (4, "none", "c d"), (5, None, ""), (6, None, "no one")]
    wanted = [(1, "x"), (1, "y"), (2, None), (4, "z"), (6, "x")]
    put = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = put(asks, "ask long, orcid string, name_key string"), put(wanted, "ask long, place string"), put([*people, people[0], (None, None, "a b")], "id long, orcid string, name_key string"), put(places, "id long, place string")

    def plain(ask, orcid, key):
        here = {p for a, p in wanted if a == ask and p}
        kinds = {}
        for i, r, n in people:
            if orcid and r == orcid:
                kinds[i] = (0, i, "orcid")
            elif key and n == key:
                near = any(j == i and p in here for j, p in places)
                kinds[i] = (1, i, "name_and_place") if near else (2, i, "name")
        return [(ask, i, m, at + 1) for at, (_, i, m) in enumerate(sorted(kinds.values())[:5])]

    got = sorted((tuple(r) for r in H.match_people(*tables).collect()), key=lambda r: (r[0], r[3]))
    assert got == [x for a in asks for x in plain(*a)] and {r[2] for r in got} == {"orcid", "name_and_place", "name"}
    assert H.match_people(tables[0], tables[1].limit(0), tables[2].limit(0), tables[3]).collect() == []


def test_chains_lead_to_each_id_once(spark):
    e = spark.createDataFrame([("p", "w", "o1"), ("p", "w", "o2"), ("o1", "a", "d1"), ("d1", "a", "o2"), ("q", "t", "d2"), ("q", "t", "q"), ("q", "w", None), ("p", "a", "o9"), (None, "w", "o1")], "source_id string, relation string, target_id string")
    people = spark.createDataFrame([("p",), ("q",), ("r",)], "id string")
    got = lambda chains: sorted(tuple(r) for r in H.led_to(people, e, chains).where("id IS NOT NULL").collect())
    assert got([["t"], ["w", "a"]]) == [("p", "d1"), ("q", "d2")]
    assert H.led_to(people.limit(0), e, [["t"]]).collect() == []


def test_question_that_splits_best(spark):
    rnd = random.Random(4)
    asks = [(a, rnd.randrange(12)) for a in range(30) for _ in range(rnd.randrange(1, 7))] + [(99, None)]
    terms = [(c, rnd.choice("stuvw")) for c in range(12) for _ in range(3)] + [(3, None)]
    known = [(a, "t") for a in range(0, 30, 2)]
    put = lambda rows, schema: spark.createDataFrame(rows, schema)
    a, t, k = put(asks, "ask long, cluster long"), put(terms, "cluster long, term string"), put(known, "ask long, term string")
    want, parted = {}, set()
    for ask in range(30):
        own = {c for x, c in asks if x == ask}
        options = []
        for term in "stuvw":
            n = sum((c, term) in terms for c in own)
            if (ask, term) not in known and 0 < n < len(own):
                options.append((-min(n, len(own) - n), abs(2 * n - len(own)), term, n))
        if options:
            _, _, term, n = min(options)
            want[ask] = (term, n, len(own))
            parted |= {(ask, c, (c, term) in terms) for c in own}
    q = H.best_questions(a, t, k)
    assert {r["ask"]: (r["term"], r["n_with"], r["n"]) for r in q.collect()} == want and len(want) > 15
    assert {tuple(r) for r in H.sides(q, a, t).collect()} == parted
    assert H.best_questions(a.limit(0), t, k).collect() == []


def test_expert_clusters(spark):
    put = lambda rows, schema: spark.createDataFrame(rows, schema)
    hits = put([(1, "g", "gene", "G", 1.0), (1, "m", "mechanism", "Loss, of Function", 0.9), (1, "c2", "cluster", "C", 3.0), (1, "g9", "gene", "low", 0.1), (2, "m", "mechanism", None, 0.9), (3, "zz", "gene", "none", 1.0)], "ask long, node string, kind string, label string, base double")
    clusters = put([("c1", "With loss OF function (all)"), ("c2", None), ("c3", "loss of functions")], "cluster string, text string")
    members = put([("c1", "d1"), ("c1", "d2"), ("c1", "d2"), ("c2", "d3"), ("c3", "d4")], "cluster string, id string")
    causes = put([("d1", "g", "e1", 0.8), ("d2", "h", "e2", 0.5), ("d4", "g9", "e4", 0.9)], "id string, gene string, edge string, confidence double")
    links = put([("g", "m", "l1", 0.9), ("h", "m", "l2", 0.4)], "gene string, node string, edge string, confidence double")
    trials = put([("d1", "t1"), ("d2", "t1"), ("d2", "t2"), ("d1", None)], "id string, trial string")
    got = [tuple(r) for r in H.expert_clusters(hits, clusters, members, causes, links, trials.where("trial IS NOT NULL")).orderBy("ask", "rank").collect()]
    # d1 reaches g directly (0.8), which beats 0.72 by m; d2 reaches m by 0.2; c2 is named itself.
    assert got == [(1, "c1", 0.8 * 0.25 + 0.05 + 0.3, 2, 2, round((0.8 + 0.5 + 0.4) / 3, 6), 1), (1, "c2", 0.2, 1, 0, 0.0, 2), (2, "c1", round(0.5 * (0.72 + 0.2) / 2, 6), 2, 2, round((0.8 + 0.9 + 0.5 + 0.4) / 4, 6), 1)]
    assert H.expert_clusters(hits.limit(0), clusters, members, causes, links, trials).collect() == []


def test_expert_clusters_of_asks_with_a_common_node(spark, monkeypatch):
    """What a common node reaches is written once, however many asks match it; a node of their own changes single members."""
    put = lambda rows, schema: spark.createDataFrame(rows, schema)
    n_asks, n_ids = 30, 40
    hits = put([(a, "m", "gene", "M", 1.0) for a in range(n_asks)] + [(a, f"g{a}", "gene", "G", 1.0) for a in range(0, n_asks, 3)], "ask long, node string, kind string, label string, base double")
    clusters = put([("c0", None), ("c1", None)], "cluster string, text string")
    members = [(f"c{i % 2}", f"d{i}") for i in range(n_ids)]
    causes = [(f"d{i}", f"g{i % 7}", f"e{i}", (50 + i) / 100) for i in range(n_ids)]
    links = [(f"g{j}", "m", f"l{j}", (40 + 9 * j) / 100) for j in range(6)]
    sizes, write = {}, H.staged

    def count(df, label):
        out = write(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(H, "staged", count)
    found = H.expert_clusters(hits, clusters, put(members, "cluster string, id string"), put(causes, "id string, gene string, edge string, confidence double"), put(links, "gene string, node string, edge string, confidence double"), put([("d0", "t0")], "id string, trial string"))
    got = {(r["ask"], r["cluster"]): (r["score"], r["strength"]) for r in found.collect()}
    link, conf = {g: (e, c) for g, _, e, c in links}, {e: c for _, _, e, c in causes} | {e: c for _, _, e, c in links}
    want = {}
    for a in range(n_asks):
        for c in ("c0", "c1"):
            total, edges = 0.0, set()
            for i, g, e, p in causes:
                ways = [(-p, [e])] if a % 3 == 0 and g == f"g{a}" else []
                ways += [(-p * link[g][1], [e, link[g][0]])] if g in link else []
                if (c, i) in members and ways:
                    total -= min(ways)[0]
                    edges |= set(min(ways)[1])
            want[a, c] = (total / 40, sum(conf[e] for e in edges) / len(edges))
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 2e-6 for k in want for x, y in zip(got[k], want[k], strict=True))
    assert sizes["reached"] <= n_ids and sizes["other"] <= n_ids


def test_ids_in_queries(spark):
    rows = [("MONDO:7606", True, ["MONDO:7606", "MONDO:0007606"]), (" hp_0001263", True, ["HP_0001263", "HP:0001263"]), ("PMID: 0012", True, ["PMID: 0012", "PMID:12"]), ("orpha:000", True, ["ORPHA:000", "ORPHA:0"]), ("R01-X_a.b", True, ["R01-X_A.B", "R01-X:A.B"]), ("a name: b", False, None), ("x", False, None), ("", False, None), (None, False, None), ("MONDO:12345678", True, ["MONDO:12345678"])]
    q = spark.createDataFrame([(r[0],) for r in rows], "q string").select("q", P.is_id_query(F.col("q")).alias("is_id"), P.id_candidates(F.col("q")).alias("ids"))
    got = {r["q"]: (r["is_id"], r["ids"]) for r in q.collect()}
    for text, is_id, ids in rows:
        assert got[text][0] == is_id and (not is_id or got[text][1] == ids), text
