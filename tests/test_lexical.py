"""Trigram searches and names in texts against plain Python."""

import random
import re

from graphloom.operators import entities as N
from graphloom.operators import trigram as G

NAMES = ["red bolt", "Red-Bolt", "blue bolt", "bolt", "the very long bolt of steel", "anvil", "á b", "", None, "zz top", "small red ring", "ring"]
ASKS = ["bolt", "red bolt", "bolts", "anvl", "rng", "q", "", None, "very long bolt"]


def words(t):
    t = "".join({"á": "a"}.get(c, c) for c in (t or ""))
    return re.sub("[^a-z0-9]+", " ", t.lower()).split()


def run(t):
    return [f"  {w} "[i : i + 3] for w in words(t) for i in range(len(w) + 1)]


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_similar_words(spark):
    index = spark.createDataFrame(list(enumerate(NAMES)), "id long, text string")
    got = {(r["query"], r["id"]): (r["similarity"], r["word_similarity"]) for r in G.similar_words(index, spark.createDataFrame([(q,) for q in ASKS], "query string"), 100).collect()}
    want = {}
    for q in ASKS:
        for i, t in enumerate(NAMES):
            a, b = set(run(q)), run(t)
            if a and b:
                s, w = jac(a, set(b)), max(jac(a, set(b[x : y + 1])) for x in range(len(b)) for y in range(x, len(b)))
                if round(s, 6) >= 0.3 or round(w, 6) >= 0.6:
                    want[q, i] = (round(s, 6), round(w, 6))
    assert got == want and ("bolt", 4) in got and got["bolt", 4][1] == 1.0 > got["bolt", 4][0]


def test_fuzzy(spark):
    index = spark.createDataFrame([*enumerate(NAMES), (0, "anvil")], "id long, text string")
    whole = lambda t: {f"  {' '.join(words(t))} "[i : i + 3] for i in range(len(" ".join(words(t))) + 1)}
    for least in (0.3, 0.6):
        got = {(r["query"], r["id"]): r["score"] for r in G.fuzzy(index, spark.createDataFrame([(q,) for q in ASKS], "query string"), least, 100).collect()}
        want = {}
        for q in ASKS:
            for i, t in [*enumerate(NAMES), (0, "anvil")]:
                if words(q) and words(t) and round(jac(whole(q), whole(t)), 6) >= least:
                    want[q, i] = max(want.get((q, i), 0), round(jac(whole(q), whole(t)), 6))
        assert got == want


def mentions(texts, names, most):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    known = {}
    for i, n in names:
        if i is not None and 1 <= len(cut(n)) <= most:
            known.setdefault(tuple(cut(n)), set()).add(i)
    out = []
    for key, t in texts:
        w = cut(t)
        found = [(p, k) for p in range(len(w)) for k in range(1, most + 1) if tuple(w[p : p + k]) in known and p + k <= len(w)]
        for p, k in found:
            if not any((a, b) != (p, k) and a <= p and a + b >= p + k for a, b in found):
                ids = known[tuple(w[p : p + k])]
                out.append((key, p + 1, k, " ".join(w[p : p + k]), min(ids) if len(ids) == 1 else None, len(ids)))
    return sorted(out, key=str)


def test_mentions_equal_plain_search(spark):
    rnd = random.Random(7)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "e5"]
    phrase = lambda n: rnd.choice([" ", "-", ", "]).join(rnd.choice(vocabulary) for _ in range(n))
    names = [(i, phrase(rnd.randrange(1, 5))) for i in range(30)] + [(90, None), (91, "--"), (None, "alpha"), (92, "alpha beta gamma e5 e5 e5")]
    texts = [(i, phrase(rnd.randrange(0, 30))) for i in range(40)] + [(50, None), (51, ""), (52, "beta " * 5000)]
    got = N.mentions(spark.createDataFrame([(*t, "x") for t in texts], "key long, text string, name string").repartition(3), spark.createDataFrame(names, "id long, name string"), 4)
    assert sorted(map(tuple, got.collect()), key=str) == mentions(texts, names, 4)
