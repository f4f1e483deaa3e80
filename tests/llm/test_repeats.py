"""Byte, word and line repeats against brute force, with nulls, ties, empty and repeated rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import induced_sort, line_dedup, substring_dedup, suffix_dedup

NULL = 10**12


def documents(spark, rnd, alphabet):
    parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30, 200))) for _ in range(15)]
    docs = []
    for i in range(120):
        text = ""
        for _ in range(rnd.randrange(5)):
            p = rnd.choice(parts)
            a = rnd.randrange(len(p) // 2)
            text += p[a : a + rnd.randrange(20, 150)] + (rnd.choice("xyz") * rnd.randrange(120) if rnd.random() < 0.5 else "")
        docs.append((i, text))
    docs += [(None, parts[0] * 2), (300, None), (301, ""), (302, "q" * 500), (303, "q" * 60), docs[5]]
    return docs, spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int").repartition(4)


def cut(keys, units, length, same_document):
    """Which units go: covered by a window that starts earlier."""
    first = {}
    for k, u in zip(keys, units):
        for i in range(len(u) - length + 1):
            w = tuple(u[i : i + length])
            place = (k, i) if same_document else (k, 0)
            first[w] = min(first.get(w, place), place)
    out = []
    for k, u in zip(keys, units):
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if first[tuple(u[i : i + length])] < ((k, i) if same_document else (k, 0)):
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 4000, "shard_bytes": 6000, "memory": 1000}])
def test_suffix_dedup(spark, sizes):
    docs, df = documents(spark, random.Random(4), "abcé ")
    keys, raw = [NULL if d is None else d for d, _ in docs], [(t or "").encode() for _, t in docs]
    want = []
    for k, r, g in zip(keys, raw, cut(keys, raw, 50, False)):
        spans = sum(x and (i == 0 or not g[i - 1]) for i, x in enumerate(g))
        want.append((None if k == NULL else k, len(r), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(r, g) if not x)).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.dedupe(df, **sizes).collect()), key=str) == sorted(want, key=str)


def test_substring_dedup(spark):
    docs, df = documents(spark, random.Random(6), "ab    ")
    keys, words = [NULL if d is None else d for d, _ in docs], [(t or "").encode().split() for _, t in docs]
    want = []
    for k, w, g in zip(keys, words, cut(keys, words, 20, True)):
        want.append((None if k == NULL else k, len(w), sum(g), hashlib.sha256(b" ".join(x for x, c in zip(w, g) if not c)).hexdigest()))
    for sizes in ({}, {"batch_bytes": 3000, "shard_bytes": 5000}):
        assert sorted(map(tuple, substring_dedup.dedupe(df, **sizes).drop("n_spans").collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedupe(none).count() == substring_dedup.dedupe(none).count() == line_dedup.line_report(none).count() == 0


def test_suffix_order():
    rnd = random.Random(3)
    for _ in range(150):
        strings = [bytes(rnd.choice(b"\x01\x02\x03"[: rnd.randrange(1, 4)]) for _ in range(rnd.randrange(1, 14))) for _ in range(rnd.randrange(1, 8))]
        t, depth = b"\x00".join(strings) + b"\x00", rnd.choice([3, 5, 50])
        blocks = list(induced_sort.suffix_order(np.frombuffer(t, np.uint8), depth, memory=rnd.choice([1, 100, 1 << 20])))
        order, lcp = (np.concatenate(x).tolist() for x in zip(*blocks))
        assert sorted(order) == list(range(len(t)))
        for i in range(1, len(order)):
            a, b = t[order[i - 1] :], t[order[i] :]
            same = next((k for k in range(min(len(a), len(b), depth)) if a[k] != b[k]), min(len(a), len(b), depth))
            assert a[:depth] <= b[:depth] and lcp[i] == same


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup(spark):
    rnd = random.Random(5)

    def changed(s):
        s = list(s)
        for _ in range(rnd.randrange(4)):
            i, c = rnd.randrange(len(s)), rnd.choice("abé")
            s[i : i + rnd.randrange(2)] = [c] if rnd.random() < 0.7 else []
        return "".join(s)

    base = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(21, 40))) for _ in range(12)]
    pool = [changed(rnd.choice(base)) for _ in range(150)] + ["ab", "ba", "abé"]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(5)))) for i in range(90)] + [(None, pool[0]), (500, None), (501, "")]
    lines = [(NULL if d is None else d, n, x) for d, t in docs for n, x in enumerate((t or "").split("\n")) if x]
    first = {}
    for d, n, x in lines:
        first[x] = min(first.get(x, (d, n)), (d, n))
    near = {x for x in first if len(x) >= 20 and any(first[y] < first[x] and len(y) >= 20 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in first if y != x)}
    want = {}
    for d, n, x in lines:
        if first[x] < (d, n) or x in near:
            want.setdefault(d, []).append(str(n))
    df = spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, line string")
    got = {NULL if r["doc_id"] is None else r["doc_id"]: r["removed_lines"] for r in line_dedup.line_report(df).collect()}
    assert {d: x for d, x in got.items() if x} == {d: ",".join(x) for d, x in want.items()} and len(got) == len(docs)
    kept = {NULL if r["doc_id"] is None else r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df).collect()}
    for d, t in docs:
        d = NULL if d is None else d
        assert kept[d] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if str(n) not in want.get(d, [])))


def test_lines_of_a_template_are_all_judged(spark):
    """600 lines share most of their text; those that follow one within two edits go, the others stay."""
    rnd = random.Random(31)
    slots = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([1, 5, 6, 7]))) for _ in range(600)]
    lines = [f"the report of {s} was filed on the first working day" for s in slots]
    gone = [any(abs(len(s) - len(t)) <= 2 and distance(s, t) <= 2 for t in slots[:i]) for i, s in enumerate(slots)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_exact"] + r["n_near"] for r in line_dedup.line_report(df).collect()}
    assert got == {i: int(g) for i, g in enumerate(gone)} and 30 < sum(gone) < 570


def test_banded_distance(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(4, 9))) for _ in range(40)]
    rows = [(a, b, distance(a, b)) for a in words for b in words if abs(len(a) - len(b)) <= 2]
    got = spark.createDataFrame(rows, "a string, b string, e int").withColumn("g", line_dedup.banded_distance(F.col("a"), F.col("b"), 2))
    assert got.where("(e <= 2 and g <> e) or (e > 2 and g <= 2)").count() == 0


def shared_ids():
    rnd = random.Random(12)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    copied, own, late, twin = text(60), text(60), text(60), text(60)
    # Of the rows without an id, and of those with id 7, only one copies an earlier text.
    return [(1, copied), (None, copied), (None, own), (None, text(70)), (7, copied), (7, twin), (8, twin), (7, late)]


def test_substring_dedup_tells_rows_of_one_id_apart(spark):
    docs = shared_ids()
    for sizes in ({}, {"batch_bytes": 500, "shard_bytes": 500}):
        rows = substring_dedup.dedupe(spark.createDataFrame(docs, "doc_id long, text string"), **sizes).collect()
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in rows)
        assert got == sorted((str(d), len(t.split()), len(t.split()) if (d, t) in (docs[1], docs[4], docs[6]) else 0) for d, t in docs)


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    docs = shared_ids()
    for sizes in ({}, {"batch_bytes": 500, "shard_bytes": 500}):
        rows = suffix_dedup.dedupe(spark.createDataFrame(docs, "doc_id long, text string"), **sizes).collect()
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in rows)
        assert got == sorted((str(d), len(t), len(t) if (d, t) in (docs[1], docs[4], docs[6]) else 0) for d, t in docs)
