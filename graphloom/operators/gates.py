"""Checks of a finished graph against what is known of it: names, golden facts, counterexamples, coverage, inferred edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INFERRED_CAP, SUPPORTED


def folded(name: Column) -> Column:
    return F.lower(F.trim(name))


def resolver(nodes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, id): what a lower-cased name means; ids before labels before synonyms, then the least id.

    nodes (id, label), synonyms (node_id, synonym); empty and null names mean nothing.
    """
    by = lambda df, name, key, rank: df.select(folded(F.col(name)).alias("name"), F.col(key).alias("id"), F.lit(rank).alias("rank"))
    every = by(nodes, "id", "id", 0).unionByName(by(nodes, "label", "id", 1)).unionByName(by(synonyms, "synonym", "node_id", 2)).where("name <> '' AND id IS NOT NULL")
    return every.groupBy("name").agg(F.min(F.struct("rank", "id")).alias("r")).select("name", F.col("r.id").alias("id"))


def resolved(df: DataFrame, names: DataFrame, column: str, to: str) -> DataFrame:
    """df with the id that `column` means (null if none)."""
    key = names.select(F.col("name").alias("_name"), F.col("id").alias(to))
    return df.join(key, folded(F.col(column)) == F.col("_name"), "left").drop("_name")


def golden(facts: DataFrame, names: DataFrame, edges: DataFrame, least: float = SUPPORTED) -> DataFrame:
    """(a, relation, b, status): ok, weak, missing, or unknown name; facts (a, relation, b) by name, in either direction.

    edges (source_id, relation, target_id, confidence).
    """
    f = resolved(resolved(facts.distinct(), names, "a", "a_id"), names, "b", "b_id")
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    best = edges.groupBy(low.alias("low"), high.alias("high"), "relation").agg(F.max("confidence").alias("confidence"))
    f = f.withColumns({"low": F.least("a_id", "b_id"), "high": F.greatest("a_id", "b_id")})
    status = F.when(F.col("a_id").isNull() | F.col("b_id").isNull(), "unknown name").when(F.col("confidence").isNull(), "missing").when(F.col("confidence") < least, "weak").otherwise("ok")
    return f.join(best, ["low", "high", "relation"], "left").select("a", "relation", "b", status.alias("status"))


def counterexamples(pairs: DataFrame, names: DataFrame, clusters: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, status) of pairs known to differ: they must lie in different clusters (node, cluster) and be linked (a, b)."""
    p = resolved(resolved(pairs.distinct(), names, "a", "a_id"), names, "b", "b_id")
    c = lambda x: clusters.select(F.col("node").alias(f"{x}_id"), F.col("cluster").alias(f"{x}_cluster"))
    linked = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct().withColumn("linked", F.lit(True))
    j = p.join(c("a"), "a_id", "left").join(c("b"), "b_id", "left").withColumns({"low": F.least("a_id", "b_id"), "high": F.greatest("a_id", "b_id")}).join(linked, ["low", "high"], "left")
    status = F.when(F.col("a_id").isNull() | F.col("b_id").isNull(), "unknown name").when(F.col("a_cluster").isNull() | F.col("b_cluster").isNull(), "no cluster").when(F.col("a_cluster") == F.col("b_cluster"), "same cluster").when(F.col("linked").isNull(), "not linked").otherwise("ok")
    return j.select("a", "b", status.alias("status"))


def core_coverage(core: DataFrame, edges: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """One row: n of the core (id), how many have an edge of each kind, and how many of all kinds.

    kinds: name and relations; an edge counts for both of its ends.
    """
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"), "relation")
    has = ends.groupBy("id").agg(*(F.max(F.col("relation").isin(r).cast("int")).alias(k) for k, r in kinds.items()))
    j = core.select("id").distinct().join(has, "id", "left").fillna(0, list(kinds))
    every = F.lit(1)
    for k in kinds:
        every = every * F.col(k)
    return j.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds), F.coalesce(F.sum(every), F.lit(0)).alias("all_kinds"))


def inferred_faults(edges: DataFrame, weak: list[str], longest: int = 400) -> DataFrame:
    """(id, fault) of inferred edges (id, relation, origin, confidence, features JSON): one row a broken rule.

    An inferred edge has a method and a basis among its features, an explanation of one line of at most `longest` signs, a
    confidence up to the cap, and, if its relation is weak by kind, less than a supported one.
    """
    e = edges.where("origin = 'inferred'")
    of = lambda name: F.get_json_object("features", f"$.{name}")
    rules = {
        "no features": F.coalesce(F.col("features"), F.lit("")) == "",
        "no method or basis": of("method").isNull() | of("basis").isNull(),
        "no explanation": F.coalesce(of("explanation"), F.lit("")) == "",
        "explanation too long": F.length(of("explanation")) > longest,
        "explanation of several lines": F.contains(of("explanation"), F.lit("\n")),
        "confidence over the cap": F.col("confidence") > INFERRED_CAP,
        "weak relation too confident": F.col("relation").isin(weak) & (F.col("confidence") >= SUPPORTED),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return e.select("id", F.explode(found).alias("fault"))
