"""Ontology closure, information content, lineages and profile similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp
from ..shared import dealt, staged
from .merge import symmetric_top, top
from .packed import dealt_two_sided, numbered, packs, term_ups, two_sided
from .topk import MARGIN, SHORT, bounded_top, dealt_top, either_side, list_sizes


def ancestors(is_a: DataFrame, most_depth: int = 100) -> DataFrame:
    """(term, ancestor) pairs, the term itself left out; cycles end.  One join a level of depth.

    Each level is written once, so the plan of a level does not hold those before it.
    """
    known = new = staged(is_a.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).where("term <> ancestor").distinct(), "closure")
    edge = is_a.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    for _ in range(most_depth):
        step = new.join(edge, "ancestor").select("term", F.col("next").alias("ancestor")).where("term <> ancestor").distinct()
        new = staged(step.join(known, ["term", "ancestor"], "left_anti"), "closure")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise ValueError("the hierarchy is deeper than allowed")


def descendant_counts(closure: DataFrame, cap: int) -> DataFrame:
    return closure.groupBy(F.col("ancestor").alias("term")).agg(F.least(F.countDistinct("term"), F.lit(cap)).alias("n"))


def information_content(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(term, n, ic): ic = max(0, -ln(n / N)), n profiles annotated to the term or below it."""
    # A row brings its term's ancestors to the task of its profile, where they are made distinct.
    ups = closure.groupBy("term").agg(F.collect_list("ancestor").alias("ups"))
    met = dealt(annotations.select("profile", "term").join(ups, "term", "left"), annotations.count(), "profile")
    each = F.concat(F.array("term"), F.coalesce("ups", F.array().cast("array<string>")))
    n = met.select("profile", F.explode(each).alias("term")).distinct().groupBy("term").agg(F.count("profile").alias("n"))
    total = annotations.agg(F.countDistinct("profile").alias("total"))
    return n.join(F.broadcast(total)).select("term", "n", F.greatest(F.lit(0.0), -F.log(F.col("n") / F.col("total"))).alias("ic"))


def primary_parent(is_a: DataFrame, closure: DataFrame) -> DataFrame:
    """Of each term the parent with most descendants, ties to the least id."""
    counts = closure.groupBy(F.col("ancestor").alias("parent")).agg(F.countDistinct("term").alias("n"))
    return top(is_a.join(counts, "parent"), ["child"], [F.desc("n"), F.asc("parent")], 1).select("child", "parent")


def lineage(primary: DataFrame, root: str, most_depth: int = 32) -> DataFrame:
    """(term, lineage): primary parents from the term up to the root, joined by '>'."""
    path = primary.select(F.col("child").alias("term"), F.array("child", "parent").alias("path"), F.col("parent").alias("at"))
    step = primary.select(F.col("child").alias("at"), F.col("parent").alias("next"))
    for _ in range(most_depth):
        if path.where(F.col("at") != root).isEmpty():
            break
        up = path.join(step, "at", "left").where((F.col("at") == root) | (F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))))
        path = staged(up.select("term", F.when(F.col("at") == root, F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"), F.when(F.col("at") == root, F.col("at")).otherwise(F.col("next")).alias("at")), "lineage")
    return path.where(F.col("at") == root).select("term", F.array_join("path", ">").alias("lineage"))


def frequency_weight(frequency: Column) -> Column:
    return clamp(F.coalesce(frequency, F.lit(0.5)))


def weighted(annotations: DataFrame, ic: DataFrame) -> DataFrame:
    """(profile, term, w, ic): best known frequency as weight; terms that say nothing go."""
    best = annotations.groupBy("profile", "term").agg(frequency_weight(F.max("frequency")).alias("w"))
    return best.join(ic.select("term", "ic"), "term").where("w > 0 and ic > 0")


def similarity(profiles: DataFrame, ic: DataFrame, closure: DataFrame, pairs: DataFrame, dealt_pairs: bool = False) -> DataFrame:
    """(a, b, similarity): the mean of both one-sided similarities; `dealt_pairs`: many pairs a profile, which share its pack."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("profile")).distinct()
    own = staged(packs(weighted(profiles.join(asked, "profile", "left_semi"), ic), term_ups(numbered(ic), closure)), "packs")
    judged = dealt_two_sided(own, pairs) if dealt_pairs else two_sided(own, own, pairs)
    return judged.select("a", "b", clamp((F.col("s") + F.col("t")) / 2).alias("similarity"))


def expanded(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(profile, term): the terms of each profile and all above them."""
    own = annotations.select("profile", "term")
    return own.unionByName(own.join(closure, "term").select("profile", F.col("ancestor").alias("term"))).distinct()


def cosine_top(profiles: DataFrame, ic: DataFrame, closure: DataFrame, k: int, least_ic: float) -> DataFrame:
    """(a, b, cosine): the k nearest of each profile by cosine of the IC weights of all terms it holds, kept by either side.

    Common terms are looked up only where they can change a profile's k best (see topk).
    """
    v = expanded(profiles, closure).join(ic.where(F.col("ic") >= least_ic), "term").select("profile", "term", "ic")
    norm = v.groupBy("profile").agg(F.sqrt(F.sum(F.col("ic") * F.col("ic"))).alias("norm"))
    u = staged(v.join(norm, "profile").select("profile", "term", F.floor(F.col("ic") * 4).cast("int").alias("level"), (F.col("ic") / F.col("norm")).alias("x"), "ic", "norm"), "vectors")
    pairs, rows = list_sizes(u.where(F.col("profile").isNotNull()))
    if 0 < pairs <= SHORT * rows and least_ic > 0:
        return either_side(dealt_top(u, k, pairs)).withColumnRenamed("score", "cosine")
    return bounded_top(u.select("profile", "term", "level", "x"), k).withColumnRenamed("score", "cosine")


def specific_terms(annotations: DataFrame, ic: DataFrame, least: float = 2.0) -> DataFrame:
    return annotations.select("profile", "term").distinct().join(ic.where(F.col("ic") >= least).select("term", "ic"), "term")


def similar(profiles: DataFrame, ic: DataFrame, closure: DataFrame, pairs: DataFrame, threshold: float, least_shared: int = 2, k: int = 8) -> DataFrame:
    """Inferred links of profiles: similar enough, enough specific terms in common, among the k best of either side."""
    sims = staged(similarity(profiles, ic, closure, pairs, True).withColumn("score", F.round("similarity", 6)).where(F.col("score") >= threshold), "similar")
    spec = staged(specific_terms(profiles, ic).groupBy("profile").agg(F.collect_list("term").alias("terms")), "specific")
    one, two = (spec.select(F.col("profile").alias(p), F.col("terms").alias(f"{p}_terms")) for p in "ab")
    shared = F.size(F.array_intersect("a_terms", "b_terms")).cast("long").alias("shared")
    able = staged(sims.join(one, "a").join(two, "b").select("a", "b", "score", shared).where(F.col("shared") >= least_shared), "similar")
    kept = symmetric_top(able, k)
    s = F.col("score")
    return kept.join(able.select("a", "b", "shared"), ["a", "b"]).select("a", "b", s.alias("similarity"), "shared", F.round(F.least(0.30 + 0.55 * s, F.lit(0.75)), 8).alias("score"), F.round(0.9 * s, 8).alias("cluster_score"))


def calibration(profiles: DataFrame, ic: DataFrame, closure: DataFrame, n_pairs: int, design: float, least_terms: int = 3) -> DataFrame:
    """One row: median, p95 and p99 of the similarity of unrelated pairs, and the threshold to use.

    The pairs are neighbours in the order of the profiles' digests: 2 * n_pairs profiles, a stated bound.
    """
    pool = dealt(profiles.select("profile", "term"), profiles.count(), "profile").groupBy("profile").agg(F.countDistinct("term").alias("n")).where(F.col("n") >= least_terms)
    some = pool.select("profile", F.md5(F.col("profile").cast("string")).alias("h")).orderBy("h").limit(2 * n_pairs)
    ranked = some.withColumn("r", F.row_number().over(Window.orderBy("h")) - 1)  # a bounded table
    ab = ranked.groupBy(F.floor(F.col("r") / 2)).agg(F.min("profile").alias("a"), F.max("profile").alias("b")).where("a < b").select("a", "b")
    s = similarity(profiles, ic, closure, staged(ab, "calibration")).select(F.round("similarity", 6).alias("s"))
    p = lambda q: F.round(F.percentile("s", q), 4)
    return s.agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.greatest(F.lit(design), p(0.95)).alias("threshold"))


def rank_profiles(queries: DataFrame, profiles: DataFrame, excluded: DataFrame, ic: DataFrame, closure: DataFrame, n: int, specific: float = 2.0, rare: int = 256) -> DataFrame:
    """The n best profiles of each query: similarity less the share of its information that contradicts them.

    queries (query, term, present boolean); excluded (profile, term): terms a profile is known not to have.
    A query term is shared with a profile's term that equals it or lies below it, or above it if that term
    is specific.  Absent terms that a profile holds, and present ones that it excludes, count against it.

    First judged are the profiles that share a term or ancestor of at most `rare` profiles with a query.  The
    others agree with it on wide terms only, which bounds what each side can reach; those whose bound is not
    under the n-th best so far, or all if there are not n, are judged too.  `rare` has no part in the result.
    """
    ic = staged(ic, "ic")
    up = staged(closure.select("term", "ancestor").unionByName(ic.select("term", F.col("term").alias("ancestor"))), "up")
    q = staged(queries.distinct().join(ic.select("term", "ic"), "term"), "queries")
    present = q.where("present").select("query", "term", "ic")
    own = staged(profiles.groupBy("profile", "term").agg(frequency_weight(F.max("frequency")).alias("w")), "own")
    ups = staged(term_ups(numbered(ic), closure), "ups")
    left = staged(packs(present.select(F.col("query").alias("profile"), "term", F.lit(1.0).alias("w")), ups), "packs")
    right = staged(packs(own, ups), "packs")

    def judged(pairs: DataFrame) -> DataFrame:
        """(query, profile, score, n_shared, n_same, n_broader) of the pairs (a, b) that share a term."""
        sim = staged(two_sided(left, right, pairs, specific).where("n_shared > 0").select(F.col("a").alias("query"), F.col("b").alias("profile"), clamp((F.col("s") + F.col("t")) / 2).alias("sim"), "n_shared", "n_same", "n_broader"), "shared")
        met = sim.select("query", "profile")
        held = own.join(up, "term").groupBy("profile", F.col("ancestor").alias("term")).agg(F.max("w").alias("w")).join(q.where("not present").select("term").distinct(), "term", "left_semi")
        against = met.join(q.where("not present").select("query", "term", "ic"), "query").join(held, ["profile", "term"]).select("query", "profile", (F.col("ic") * F.col("w")).alias("x"))
        above = present.select("query", F.col("term").alias("asked"), "ic").join(up, F.col("asked") == F.col("term")).select("query", "asked", "ic", F.col("ancestor").alias("term"))
        ruled_out = met.join(excluded.distinct(), "profile").join(above, ["query", "term"]).select("query", "profile", "asked", "ic").distinct().select("query", "profile", F.col("ic").alias("x"))
        lost = against.unionByName(ruled_out).groupBy("query", "profile").agg(F.sum("x").alias("against"))
        joined = sim.join(lost, ["query", "profile"], "left").join(q.groupBy("query").agg(F.sum("ic").alias("total")), "query")
        share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.coalesce("against", F.lit(0.0)), F.col("total")), F.lit(0.0)))
        return joined.select("query", "profile", F.round(F.col("sim") * (1 - share), 6).alias("score"), "n_shared", "n_same", "n_broader")

    few = up.join(ic.where(F.col("n") <= rare).select(F.col("term").alias("ancestor")), "ancestor")
    near = lambda d, key, name: d.select(F.col(key).alias(name), "term").join(few, "term").select(name, "ancestor").distinct()
    met = staged(near(present, "query", "a").join(near(own, "profile", "b"), "ancestor").select("a", "b").distinct(), "met")
    best = staged(top(judged(met), ["query"], [F.desc("score"), F.asc("profile")], n), "best")

    wide = up.join(ic.where(F.col("n") > rare).select(F.col("term").alias("ancestor"), F.col("ic").alias("most")), "ancestor").groupBy("term").agg(F.max("most").alias("most"))
    worth = ic.select("term", F.col("ic").alias("worth")).join(wide, "term", "left")
    reach = lambda d, key: d.join(worth, "term").groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.least("worth", F.coalesce("most", F.lit(0.0)))), F.sum(F.col("w") * F.col("worth"))), F.lit(0.0)).alias("reach"))
    most = staged(reach(own, "profile"), "reach")
    floor = best.where(F.col("rank") == n).select("query", F.col("score").alias("floor"))
    need = F.coalesce(2 * (F.col("floor") - MARGIN) - F.col("reach"), F.lit(-1.0))  # what a profile must reach; anything, if there is no n-th
    needs = reach(present.withColumn("w", F.lit(1.0)), "query").join(floor, "query", "left").select("query", need.alias("need"))
    left_open = staged(needs.join(F.broadcast(most.agg(F.max("reach").alias("most")))).where("most >= need").select("query", "need"), "open")
    if not left_open.isEmpty():
        asked = present.join(left_open, "query").select("query", "need", "term")
        below = asked.join(up, asked["term"] == up["ancestor"]).select("query", "need", up["term"])
        broader = asked.join(closure, "term").select("query", "need", F.col("ancestor").alias("term")).join(ic.where(F.col("ic") >= specific), "term", "left_semi")
        able = most.join(F.broadcast(left_open.agg(F.min("need").alias("least")))).where("reach >= least").select("profile", "reach")
        there = staged(own.join(able, "profile").select("profile", "term", "reach"), "able")
        by_term = below.unionByName(broader).join(there.select("term").distinct(), "term", "left_semi").distinct()
        pairs = by_term.join(there, "term").where("reach >= need").select(F.col("query").alias("a"), F.col("profile").alias("b")).distinct()
        rest = judged(staged(pairs.join(met, ["a", "b"], "left_anti"), "met"))
        best = top(best.drop("rank").unionByName(rest), ["query"], [F.desc("score"), F.asc("profile")], n)
    return best.select("query", "profile", "score", "n_shared", "n_same", "n_broader", "rank")


def ranked_terms(annotations: DataFrame, ic: DataFrame, n: int) -> DataFrame:
    """The n weightiest terms of each profile: information times frequency, which counts a tenth at least."""
    w = F.round(F.col("ic") * F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce("frequency", F.lit(0.5)))), 6)
    s = annotations.join(ic.select("term", "ic"), "term").select("profile", "term", w.alias("weight"))
    return top(s, ["profile"], [F.desc("weight"), F.asc("term")], n)
