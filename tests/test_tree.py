"""Tree build against a plain recursion on random parent links with cycles, chains and wide groups."""

import math
import random

import pytest

from graphloom.operators import tree as R

SCHEMA = "id string, parent string, label string, leaf boolean, depth int"


def plain(rows, most):
    of = {i: [p, lab or "", bool(leaf)] for i, p, lab, leaf in rows}
    for i in of:
        if of[i][0] not in of:
            of[i][0] = None
    for i in sorted(of):  # the least node of each cycle goes to the top
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = of[at][0]
        if at is not None:
            of[min(seen[seen.index(at) :])][0] = None
    kids = lambda i: [c for c in of if of[c][0] == i]
    gone = {i for i in of if of[i][0] is not None and len(kids(i)) == 1 and not of[kids(i)[0]][2]}
    for i in of:
        while of[i][0] in gone:
            of[i][0] = of[of[i][0]][0]
    for i in gone:
        del of[i]
    key = lambda i: (of[i][1].lower(), i)
    for g in [None, *of]:
        leaves = sorted((c for c in of if g is not None and of[c][0] == g and of[c][2]), key=key)
        if len(leaves) > most:
            size = math.ceil(len(leaves) / math.ceil(len(leaves) / most))
            for at in range(0, len(leaves), size):
                chunk, name = leaves[at : at + size], f"{g}/r{at // size + 1}"
                head = lambda c: of[c][1].strip()[:2].capitalize() or "?"
                of = of | {name: [g, f"{head(chunk[0])}–{head(chunk[-1])}", False]} | {c: [name, *of[c][1:]] for c in chunk}
    count = lambda i: of[i][2] + sum(map(count, kids(i)))
    depth = lambda i: 0 if of[i][0] is None else 1 + depth(of[i][0])
    out = []
    for p in {of[i][0] for i in of}:
        ordered = sorted(kids(p), key=lambda i: (-count(i) if kids(i) else 1, *key(i)))
        out += [(i, p, of[i][1], of[i][2], depth(i), count(i), n) for n, i in enumerate(ordered)]
    return sorted(out)


def links(seed):
    rnd = random.Random(seed)
    groups = [f"g{i:02d}" for i in range(30)]
    rows = [(g, rnd.choice(groups + [None, "missing"]) if i else None, rnd.choice(["Alpha", "beta", None, f"Ga{i}"]), False) for i, g in enumerate(groups)]
    rows += [(f"x{i}", rnd.choice(groups[:12] + [None]), f"{rnd.choice('abC')}{i}", True) for i in range(60)]
    return rows + [("c1", "c3", "c", False), ("c2", "c1", "c", False), ("c3", "c2", "c", False), ("c4", "c2", "c", False), ("s", "s", "self", False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_recursion(spark, seed):
    rows = links(seed)
    got = R.build(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA).repartition(3), 4)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows, 4), key=str)


def test_empty_tree(spark):
    assert R.build(spark.createDataFrame([], SCHEMA)).collect() == []
