"""Cluster lineages on a deeper ontology against plain Python; names told apart."""

import random
from collections import Counter

from graphloom.operators import lineages as N
from graphloom.operators import ontology as O


def ontology():
    rnd = random.Random(4)
    layers = [["R"], ["S1", "S2", "S3"], [f"a{i}" for i in range(6)], [f"b{i}" for i in range(9)], [f"c{i}" for i in range(14)]]
    return [(t, p) for above, layer in zip(layers, layers[1:]) for t in layer for p in sorted({*rnd.sample(above, min(2, len(above)) if above != ["R"] else 1)})]


def plain(isa, members, notes, ranked, ic, least):
    parents = {}
    for c, p in isa:
        parents.setdefault(c, []).append(p)

    def up(t):
        return {t}.union(*(up(p) for p in parents.get(t, [])))

    systems = {c for c, p in isa if p == "R"}
    clusters, chosen, shared = {c for c, _ in members}, {}, Counter()
    for c in clusters:
        votes = Counter(s for i in {i for x, i in members if x == c} for s in set().union(*(up(t) for j, t in notes if j == i)) & systems)
        if votes:
            s = min(votes, key=lambda x: (-votes[x], x))
            terms = [t for x, t, _ in sorted(ranked, key=lambda r: r[2]) if x == c and ic[t] >= least and s in up(t) - {t}]
            chosen[c] = (s, terms[0] if terms else None)
            shared.update(up(terms[0]) if terms else [])
    out = {c: [] for c in clusters}
    for c, (s, at) in chosen.items():
        path, at = [], at or s
        while at != s:
            path.append(at)
            at = min((p for p in parents[at] if s in up(p)), key=lambda p: (-shared[p], p))
        out[c] = [s, *reversed(path)]
    return out


def test_lineages_equal_plain_climb(spark):
    rnd = random.Random(9)
    isa = ontology()
    terms = sorted({c for c, _ in isa if c[0] in "abc"})
    members = [(i % 8, i) for i in range(40)] + [(99, 100)]
    notes = [(i, t) for i in range(38) for t in rnd.sample(terms, 3)]
    ranked = [(c, t, r + 1) for c in range(8) for r, t in enumerate(rnd.sample(terms, 12))]
    ic = {t: rnd.choice([1.0, 2.0, 3.0]) for t in terms}
    frame = spark.createDataFrame
    edges = frame(isa, "child string, parent string")
    got = N.lineages(frame(members, "cluster long, id long"), frame(notes, "id long, term string"), frame(ranked, "cluster long, term string, rank int"), frame(list(ic.items()), "term string, ic double"), edges, O.ancestors(edges), "R")
    rows = {r["cluster"]: list(r["lineage"]) for r in got.collect()}
    assert rows == plain(isa, members, notes, ranked, ic, 2.0) and rows[99] == [] and max(map(len, rows.values())) >= 3
    wide = {r["term"]: r["children"] for r in N.fan_out(got).collect()}
    assert wide[""] == len({x[0] for x in rows.values() if x}) and sum(wide.values()) == len({(a, b) for x in rows.values() for a, b in zip(["", *x], x)})


def test_names_are_told_apart(spark):
    rows = [(1, 1, "Own", "t", "g"), (2, 5, None, "t", "g"), (3, 5, None, "T", "g"), (4, 2, None, None, None), (5, 2, None, None, None), (6, 3, None, None, "g"), (7, 3, None, "x", None), (8, 1, None, "x", None)]
    got = {r["cluster"]: r["name"] for r in N.cluster_names(spark.createDataFrame(rows, "cluster long, n long, own string, term string, gene string")).collect()}
    assert got == {1: "Own", 2: "t · g · t (cluster 2)", 3: "T · g · T (cluster 3)", 4: "2 related conditions (cluster 4)", 5: "2 related conditions (cluster 5)", 6: "g disorders", 7: "x", 8: "8"}
