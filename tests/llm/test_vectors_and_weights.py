"""Vector codes, URL filters and resampling against SQL on the given tables and brute force on small ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.llm import queries, resampling, url_filter, vector_codes

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_vector_code_compression", "op12_url_filters", "op13_importance_resampling"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(map(tuple, df.select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)


# Vector codes


def lloyd(rows, parts, entries, rounds, scale):
    """rows: (key, label, floats); every part against every entry."""
    kept = [(k if k is not None else 2**63, lab, [math.floor(scale * x) for x in v]) for k, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = min((r for r in kept if len(r[2]) % parts == 0), default=None, key=lambda r: (r[0], r[2]))
    kept = sorted((r for r in kept if first and len(r[2]) == len(first[2])), key=lambda r: (r[0], r[2]))
    cut = lambda v: [v[i * len(v) // parts : (i + 1) * len(v) // parts] for i in range(parts)]
    books = [[cut(r[2])[p] for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, v: min(range(len(books[p])), key=lambda e: (far(books[p][e], v), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = {}
            for r in kept:
                got.setdefault(best(p, cut(r[2])[p]), []).append(cut(r[2])[p])
            new.append([[sum(c) // len(c) for c in zip(*got[e], strict=True)] if e in got else books[p][e] for e in range(len(books[p]))])
        books = new
    out = [(None if k == 2**63 else k, lab, "".join(f"{best(p, x):02x}" for p, x in enumerate(cut(v))), sum(far(books[p][best(p, x)], x) for p, x in enumerate(cut(v)))) for k, lab, v in kept]
    return out, ",".join(str(x) for b in books for e in b for x in e)


def vectors(n, dims, seed=3):
    rnd = random.Random(seed)
    v = [(i, rnd.choice([None, 1, 2, 3]), [rnd.choice([-0.5, 0.0, 0.25, rnd.gauss(0, 1)]) for _ in range(dims)]) for i in range(n)]
    v += [v[5], v[6], (None, None, v[7][2]), (None, 2, v[8][2]), (n, 1, None), (n + 1, 1, []), (n + 2, 1, [1.0] * (dims + 1)), (n + 3, 1, [None] + [0.0] * (dims - 1)), (n + 4, 1, [float("nan")] * dims), (-1, 1, [float("inf")] * dims)]
    return v


SCHEMA = "vec_id long, label int, embedding array<float>, key string"


@pytest.mark.parametrize("n,parts,dims", [(300, 2, 4), (9, 4, 4), (700, 1, 3)])
def test_codes_equal_plain_lloyd(spark, n, parts, dims):
    rows = [(k, lab, v and [None if x is None else float(np.float32(x)) for x in v]) for k, lab, v in vectors(n, dims)]
    coded, books = vector_codes.compress(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), parts=parts, rounds=4)
    want, listed = lloyd(rows, parts, 16, 4, 4096)
    got = [(None if r["key"] == 2**63 - 1 else r["key"], r["label"], r["code"], r["error"]) for r in coded.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert vector_codes.digest_of(books) == hashlib.sha256(listed.encode()).hexdigest()
    errors = {r["label"]: r["label_error"] for r in vector_codes.with_label_errors(coded, small=0).collect()}
    total = Counter()
    for _, label, _, e in want:
        total[label] += e
    assert errors == dict(total)


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.report(none).collect() == []
    odd = spark.createDataFrame([(1, 1, [1.0, 2.0], "x"), (2, 1, None, "x")], SCHEMA)  # no length that parts divide
    assert vector_codes.report(odd).collect() == []


def test_cells_decide_most_points():
    """On clustered points whole cells are assigned and few points compared; the tallies equal those of all pairs."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 3))
    points = (centres[rng.integers(0, 16, 4096)] + rng.integers(-40, 40, (4096, 3))).astype(np.int64)
    tree = vector_codes.grow(points)
    compared = sum(len(vector_codes.places(vector_codes.bounds(4096, lv), cells)) for lv, cells, entry in vector_codes.filtered(centres, 4096, tree[1]) if entry is None)
    assert compared < 1500
    at = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    count, total = vector_codes.tally(points, *tree, centres)
    assert (count == np.bincount(at, minlength=16)).all() and all((total[e] == points[at == e].sum(0)).all() for e in range(16))


# URL filters


def test_urls_and_rules(spark):
    rows = [
        (1, "http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "https://example.com/EN/1", "example.com", "/EN/1", "com/", "allow"),
        (4, "x://notexample.net/es/2", "notexample.net", "/es/2", "net/es/", "block"),
        (5, "x://a.net/e", "a.net", "/e", None, "allow"),
        (6, "x://a.com", "a.com", "", None, "allow"),  # an empty path does not start with the rule's
        (7, "x://a.com?u=http://b.net/es/", "a.com", "", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "no scheme.com/", "", "", None, "allow"),
        (None, "x://É.ORG/ä\nb#c", "É.org", "/ä\nb", None, "allow"),
        (None, "x://" + "a" * 100_000 + "/" + "b" * 100_000, "a" * 100_000, "/" + "b" * 100_000, None, "allow"),
    ]
    pages = spark.createDataFrame([(*r[:2], "x") for r in rows] + [(*rows[0][:2], "x")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "host string, n long, bad long")
    for small in (0, 10):
        got = [tuple(r) for r in url_filter.judge(pages, none, small_hosts=small).select("page_id", "host", "path", "rule", "verdict").collect()]
        assert sorted(got, key=str) == sorted(((r[0], *r[2:]) for r in [*rows, rows[0]]), key=str)
    assert url_filter.judge(pages.limit(0), none).collect() == []


def test_bad_hosts_go_and_doubt_stays(spark):
    hosts = [("bad.x.org", 40, 38), ("few.x.org", 1, 1), ("good.x.org", 400, 4), *((f"h{i}.x.org", 30, i % 3) for i in range(20)), *((f"s{i}.farm.co.uk", 50, 49 + i % 2) for i in range(10))]
    pages = spark.createDataFrame([(i, f"http://{h[0]}/1") for i, h in enumerate([*hosts, ("new.x.org",), ("new.farm.co.uk",), ("new.other",)])], "page_id long, url string")
    verdicts = {r["host"]: r["verdict"] for r in url_filter.judge(pages, spark.createDataFrame(hosts, "host string, n long, bad long"), rules=()).collect()}
    blocked = {h for h, v in verdicts.items() if v == "block"}
    assert blocked == {"bad.x.org", *(f"s{i}.farm.co.uk" for i in range(10))} | (blocked & {"new.farm.co.uk"})
    known = {r["host"]: r for r in url_filter.reputation(pages.select(url_filter.host_of(pages["url"]).alias("host")), spark.createDataFrame(hosts, "host string, n long, bad long")).collect()}
    assert known["new.farm.co.uk"]["mean"] > 0.8 and known["new.x.org"]["mean"] < 0.3  # by domain
    assert known["few.x.org"]["mean"] < 0.6 < known["bad.x.org"]["mean"]  # one page is little evidence
    assert known["new.other"]["deviation"] > known["good.x.org"]["deviation"]


def test_outcomes_follow_document_numbers(spark):
    pages = spark.createDataFrame([(1, "h://a.x/en/5"), (2, "h://a.x/6.html?7"), (3, "h://a.x/9/"), (4, "h://b.x/5"), (5, "h://b.x/x5"), (6, None)], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 1), (6, 0, None), (9, 1, 0), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_filter.document_outcomes(pages, labels).collect())) == [("a.x", 3, 2), ("b.x", 1, 1)]


# Resampling


def resampled(docs, target, most, buckets, least, percent, seed):
    def runs(text):
        w = [x for x in re.split(r"[\x00-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)[1]), Counter(bucket(f) for x in target for f in runs(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for d, x in docs:
        w, f = runs(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (3, 97)])
def test_resampling_equals_plain(spark, most, buckets):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["Alpha", "béta", "GAMMA", "Ünd", "x1y", "don't", "語", "zz"])
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(40)))) for i in range(200)]
    docs += [(None, docs[1][1] + " more"), (7, "again"), (300, None), (301, ""), (302, "1 2 3"), docs[9], (303, "lang " * 30_000)]
    target = ["alpha béta zz", None, "GAMMA gamma"]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, part int, bucket int").repartition(5)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(frame, aim, most=most, buckets=buckets, least_words=5, percent=30).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled(docs, target, most, buckets, 5, 30, 2024)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert resampling.resample(none, one).collect() == []
    got = sorted((str(r["doc_id"]), r["n_features"], r["rank"]) for r in resampling.resample(one, none, least_words=1, percent=100).collect())
    assert got == [("1", 2, 1), ("1", 2, 2), ("None", 0, None)]
