"""Pairs that cannot reach the threshold are not compared, and none that can is lost."""

import random

from pyspark.sql import functions as F

from graphloom.operators import trigram
from graphloom.functions.columns import trigrams


def test_few_pairs_are_compared_and_none_is_lost(spark):
    rnd = random.Random(3)
    texts = [f"supplier {i:09d}" for i in range(80)] + [f"{rnd.choice(['red', 'hot', 'blue'])} {rnd.choice(['ring', 'bolt'])} {i % 7}" for i in range(40)] + ["a", ""]
    asks = [f"supp {rnd.randrange(99999)}" for _ in range(60)] + [f"supplier {rnd.randrange(200):09d}" for _ in range(20)] + ["red ring", "bolt", "a"]
    t = trigram.unique(spark.createDataFrame([(x,) for x in texts], "text string"), "text", "t", "ts", trigrams)
    q = trigram.unique(spark.createDataFrame([(x,) for x in asks], "query string"), "query", "q", "qs", trigrams)
    score = F.round(trigram.overlap(F.col("qs"), F.col("ts")), 6)
    want = {tuple(r) for r in q.crossJoin(t).where(score >= 0.3).select("q", "t", score).collect()}
    compared = trigram.candidates(q, t, 0.3, True).select("q", "t", score.alias("score")).collect()
    assert {tuple(r) for r in compared if r["score"] >= 0.3} == want
    assert len(compared) < 2 * len(want) + 200


def test_wide_trigrams_are_not_looked_up(spark):
    """Every text and query begins alike; no query meets all texts for that."""
    t = trigram.unique(spark.createDataFrame([(f"supplier {i:09d}",) for i in range(400)], "text string"), "text", "t", "ts", trigrams)
    q = trigram.unique(spark.createDataFrame([(f"supp {i}",) for i in range(123000, 127000, 50)], "query string"), "query", "q", "qs", trigrams)
    looked_up = trigram.rarest_by_size(q, t, 0.3).join(t.select("t", F.size("ts").alias("m"), F.explode("ts").alias("gram")), ["gram", "m"])
    assert looked_up.where("gram IN ('  s', ' su', 'sup', 'upp')").isEmpty()
    assert looked_up.count() < q.count() * t.count() / 4


def test_the_best_ids_of_many_equal_names(spark):
    """Only the least ids of a name go on; an id that another of its names brings in is there."""
    index = spark.createDataFrame([(f"P{i:03d}", "red ring") for i in range(60)] + [("P059", "red rings"), ("P058", "blue bolt")], "id string, text string")
    queries = spark.createDataFrame([("red ring",), ("red rings",), ("blue bolts",)], "query string")
    got = [(r["query"], r["id"], r["rank"]) for r in trigram.fuzzy(index, queries, 0.3, 3).collect()]
    want = [("red ring", f"P{i:03d}", i + 1) for i in range(3)] + [("red rings", x, i + 1) for i, x in enumerate(["P059", "P000", "P001"])] + [("blue bolts", "P058", 1)]
    assert sorted(got) == sorted(want)
