"""Merging assertions into edges, nodes and features; evidence accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical, clamp, confidence_level, edge_id, evidence_weight, family, tier_weight
from ..model import CONTRADICTION, INFERRED_CAP, ORIGINS, TIER_WEIGHT
from ..shared import dealt, placed


def noisy_or(weight: Column, supports: Column) -> Column:
    """1 - product(1 - w) over supporting rows less the penalty for contradictions, clamped, 6 places."""
    product = F.coalesce(F.product(F.when(supports, 1 - weight)), F.lit(1.0))
    return F.round(clamp(1 - product - CONTRADICTION * F.count_if(~supports)), 6)


def valid_assertions(assertions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Known relation, both ends known, no self-loop, known tier; symmetric pairs in one order."""
    a, b = canonical(F.col("source_id"), F.col("relation"), F.col("target_id"))
    known = assertions.withColumns({"source_id": a, "target_id": b}).where(family(F.col("relation")).isNotNull() & (F.col("source_id") != F.col("target_id")) & F.col("tier").isin(list(TIER_WEIGHT)))
    ids = nodes.select("id").distinct()
    return known.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def edges(assertions: DataFrame, rows: int | None = None) -> DataFrame:
    """One scored edge per (source, relation, target) from its distinct evidence.

    Assertions are dealt by their ends once, which serves both counts; `rows`, their number at most, is counted if not given.
    """
    key = ["source_id", "relation", "target_id"]
    # Not by relation too: where it is constant Spark takes it out of the groups, and would deal them again.
    given = dealt(assertions, assertions.count() if rows is None else rows, "source_id", "target_id")
    rank = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    evidence = given.groupBy(*key, "tier", "source_type", "source_ref", "polarity").agg(F.max(evidence_weight(F.col("tier"), F.col("origin"), F.col("weight"))).alias("w"), F.min(rank).alias("rank"))
    supports = F.col("polarity") == "supports"
    merged = evidence.groupBy(*key).agg(
        noisy_or(F.col("w"), supports).alias("raw"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_evidence"), F.count_if(~supports).alias("n_contradicting")
    )
    origin = F.element_at(F.array(*map(F.lit, ORIGINS)), F.col("rank").cast("int"))
    confidence = F.when(F.col("rank") == 2, F.least(F.col("raw"), F.lit(INFERRED_CAP))).otherwise(F.col("raw"))
    return merged.select(
        edge_id(F.col("source_id"), F.col("relation"), F.col("target_id")).alias("id"),
        "source_id",
        "relation",
        "target_id",
        family(F.col("relation")).alias("family"),
        confidence.alias("confidence"),
        confidence_level(confidence).alias("level"),
        origin.alias("origin"),
        F.when(F.col("rank") > 2, "pending_review").otherwise("active").alias("status"),
        "n_evidence",
        "n_contradicting",
    )


def evidence_counts(assertions: DataFrame) -> DataFrame:
    """Rows and ordered references per edge, source type and polarity."""
    return assertions.groupBy(edge_id(F.col("source_id"), F.col("relation"), F.col("target_id")).alias("edge_id"), "source_type", "polarity").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source_ref")), ",").alias("refs")
    )


def first_non_empty(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Per key and column the first value in order that is not empty."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in columns])


def max_features(df: DataFrame, key: str, json: str) -> DataFrame:
    """Numbers of flat JSON objects merged key by key, the largest wins; one object per key."""
    pairs = df.select(key, F.explode(F.from_json(json, "map<string,double>")).alias("k", "v"))
    best = pairs.groupBy(key, "k").agg(F.max("v").alias("v"))
    return best.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", F.regexp_replace(F.col("v").cast("string"), r"\.0$", "")))), ",").alias("features"))


def score_shares(df: DataFrame, key: list[str], refs: list[str], score: str, cap: float = INFERRED_CAP) -> DataFrame:
    """The equal weight of each of k references whose noisy-OR is the capped best score."""
    k = F.size(F.collect_set(F.struct(*refs)))
    return df.groupBy(*key).agg(F.max(score).alias("best"), k.cast("long").alias("k")).withColumn("share", F.round(1 - F.pow(1 - F.least(F.lit(cap), F.col("best")), 1 / F.col("k")), 6))


def prune_people(person_work: DataFrame, topics: DataFrame, least_works: int = 2, least_topics: int = 2) -> DataFrame:
    """Persons with enough works, or with one that touches enough topics."""
    per = person_work.groupBy("person").agg(F.countDistinct("work").alias("n_works"))
    touched = person_work.join(topics, "work").groupBy("person").agg(F.countDistinct("topic").alias("n_topics"))
    return per.join(touched, "person", "left").select("person", "n_works", F.coalesce("n_topics", F.lit(0)).alias("n_topics")).where((F.col("n_works") >= least_works) | (F.col("n_topics") >= least_topics))


def content_hash(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Order-free digest of rows: their md5 digests, folded into 64-bit parts and summed per key."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return df.groupBy(key).agg(F.sum(part).alias("digest"), F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row per key under a total order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rank = 1").drop("__rank")


def top(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows per key under a total order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


def exact_quantiles(df: DataFrame, key: str, value: str, tie: str, at: dict[str, float]) -> DataFrame:
    """(key, one column a quantile) by linear interpolation at 4 places; nulls are left out.

    Values are numbered within sorted ranges, so a key may have any number of rows; of those only the two beside
    each quantile are gathered.
    """
    rows = placed(df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"), F.col(tie).alias("t")), [key], [F.col("v"), F.col("t")])
    n = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    j = rows.join(n, key)
    spot = {name: (F.col("n") - 1) * p for name, p in at.items()}
    beside = {name: (F.col("place") == F.floor(s)) | (F.col("place") == F.ceil(s)) for name, s in spot.items()}
    share = {name: F.when(F.floor(s) == F.ceil(s), 1.0).when(F.col("place") == F.floor(s), F.ceil(s) - s).otherwise(s - F.floor(s)) for name, s in spot.items()}
    return j.groupBy(key).agg(*(F.round(F.sum(F.when(beside[name], F.col("v") * share[name])), 4).alias(name) for name in at))


def symmetric_top(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, score) pairs that are among the k best of either side; ties to the larger partner."""
    both = pairs.select(F.col("a").alias("own"), F.col("b").alias("other"), "a", "b", "score").unionByName(pairs.select(F.col("b").alias("own"), F.col("a").alias("other"), "a", "b", "score"))
    return top(both, ["own"], [F.desc("score"), F.desc("other")], k).select("a", "b", "score").distinct()


def majority(df: DataFrame, key: str, vote: str) -> DataFrame:
    """The most frequent vote per key, ties to the least."""
    counted = df.groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"))
    return latest(counted, key, [F.desc("n"), F.asc(vote)])


def distinctive(df: DataFrame, group: str, term: str, member: str, n: int) -> DataFrame:
    """The n terms of each group by (share of members) * ln(1 + groups / groups with the term)."""
    cnt = df.groupBy(group, term).agg(F.countDistinct(member).alias("cnt"))
    size = df.groupBy(group).agg(F.countDistinct(member).alias("size"))
    df_ = cnt.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    total = size.agg(F.count(F.lit(1)).alias("groups"))
    scored = cnt.join(size, group).join(df_, term).join(F.broadcast(total)).withColumn("score", F.round(F.col("cnt") / F.col("size") * F.log(1 + F.col("groups") / F.col("df")), 9))
    return top(scored, [group], [F.desc("score"), F.asc(term)], n).select(group, term, "score", "rank")


def wide_hash(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Order-free digest of rows: both halves of their md5 digests as whole 64-bit numbers, summed per key."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.groupBy(key).agg(half(1).alias("high"), half(17).alias("low"), F.count(F.lit(1)).alias("n"))


def breakdown(assertions: DataFrame) -> DataFrame:
    """How each edge's confidence comes about: support by tier weights, penalty, result, and whether it was clamped."""
    supports, weight = F.col("polarity") == "supports", tier_weight(F.col("tier"))
    g = assertions.groupBy(edge_id(F.col("source_id"), F.col("relation"), F.col("target_id")).alias("edge_id")).agg(
        F.round(1 - F.coalesce(F.product(F.when(supports, 1 - weight)), F.lit(1.0)), 6).alias("support_score"), F.count_if(~supports).alias("n_contradicting")
    )
    penalty = F.round(CONTRADICTION * F.col("n_contradicting"), 6)
    plain = F.col("support_score") - penalty
    return g.select("edge_id", "support_score", "n_contradicting", penalty.alias("penalty"), F.round(clamp(plain), 6).alias("result"), (~plain.between(0, 1)).alias("clamped"))


def _term_counts(df: DataFrame, group: str, term: str, member: str) -> DataFrame:
    cnt = df.groupBy(group, term).agg(F.countDistinct(member).alias("cnt"))
    size = df.groupBy(group).agg(F.countDistinct(member).alias("size"))
    spread = cnt.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    return cnt.join(size, group).join(spread, term).join(F.broadcast(size.agg(F.count(F.lit(1)).alias("groups"))))


def distinctive_backed(df: DataFrame, group: str, term: str, member: str, n: int) -> DataFrame:
    """Like `distinctive`, but terms that two members share, or the only member has, come first."""
    s = _term_counts(df, group, term, member).select(group, term, ((F.col("cnt") >= 2) | (F.col("size") == 1)).alias("backed"), F.round(F.col("cnt") / F.col("size") * F.log(1 + F.col("groups") / F.col("df")), 9).alias("score"))
    return top(s, [group], [F.desc("backed"), F.desc("score"), F.asc(term)], n)


def distinctive_squared(df: DataFrame, group: str, term: str, member: str, n: int) -> DataFrame:
    """Terms by squared count times ln(1 + groups / groups with the term)."""
    s = _term_counts(df, group, term, member).select(group, term, F.round(F.col("cnt") * F.col("cnt") * F.log(1 + F.col("groups") / F.col("df")), 9).alias("score"))
    return top(s, [group], [F.desc("score"), F.asc(term)], n)


def pivoted(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each value of a column, side by side."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def cap_statistics(pairs: DataFrame, k: int) -> DataFrame:
    """One row: pairs that qualify, that the k best of either side keep, that fall out, and the median k-th score."""
    both = pairs.select(F.col("a").alias("own"), F.col("b").alias("other"), "a", "b", "score").unionByName(pairs.select(F.col("b").alias("own"), F.col("a").alias("other"), "a", "b", "score"))
    kept = top(both, ["own"], [F.desc("score"), F.desc("other")], k)
    counts = kept.agg(F.countDistinct("a", "b").alias("kept"), F.percentile(F.when(F.col("rank") == k, F.col("score")), 0.5).alias("median_last"))
    return pairs.agg(F.count(F.lit(1)).alias("qualifying")).join(F.broadcast(counts)).select("qualifying", "kept", (F.col("qualifying") - F.col("kept")).alias("dropped"), "median_last")
