"""Coarse-to-fine groups above clusters, and names of clusters that tell them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import staged
from .merge import top


def with_self(closure: DataFrame) -> DataFrame:
    """(term, ancestor) in which each term of the closure also stands above itself."""
    both = closure.select(F.explode(F.array("term", "ancestor")).alias("term")).distinct()
    return closure.select("term", "ancestor").unionByName(both.select("term", F.col("term").alias("ancestor")))


def voted_systems(members: DataFrame, annotations: DataFrame, up: DataFrame, systems: DataFrame) -> DataFrame:
    """(cluster, system): the system that most members have a term at or below, ties to the least id."""
    has = members.join(annotations.select("id", "term").distinct(), "id").join(up, "term").join(systems.select(F.col("system").alias("ancestor")), "ancestor", "left_semi")
    votes = has.groupBy("cluster", F.col("ancestor").alias("system")).agg(F.count_distinct("id").alias("n"))
    return top(votes, ["cluster"], [F.desc("n"), F.asc("system")], 1).select("cluster", "system")


def lineages(members: DataFrame, annotations: DataFrame, ranked: DataFrame, ic: DataFrame, is_a: DataFrame, closure: DataFrame, root: str, least_ic: float = 2.0, most_depth: int = 64) -> DataFrame:
    """(cluster, lineage): terms from the organ system down to the anchor; a cluster without any annotated member has an empty one.

    members (cluster, id), annotations (id, term), ranked (cluster, term, rank): its terms, most distinctive first.  The
    system is a child of the root, chosen by votes of members; the anchor is the first ranked term that is specific
    enough and lies below it.  From the anchor the path climbs by the parent that most anchors of all clusters lie
    at or below (then the least id) among those that lead to the system.  Every climb is a join for all clusters.
    """
    up = staged(with_self(closure), "up")
    systems = is_a.where(F.col("parent") == root).select(F.col("child").alias("system")).distinct()
    chosen = staged(voted_systems(members, annotations, up, systems), "systems")
    proper = up.where("term <> ancestor")
    able = ranked.join(ic.where(F.col("ic") >= least_ic).select("term"), "term").join(chosen, "cluster").join(proper.select("term", F.col("ancestor").alias("system")), ["term", "system"], "left_semi")
    anchors = top(able.drop("rank").join(ranked, ["cluster", "term"]).withColumnRenamed("rank", "place"), ["cluster"], [F.asc("place"), F.asc("term")], 1).select("cluster", "system", F.col("term").alias("anchor"))
    anchors = staged(anchors, "anchors")
    shared = staged(anchors.join(up.select(F.col("term").alias("anchor"), "ancestor"), "anchor").groupBy("ancestor").agg(F.count(F.lit(1)).alias("n")), "shared")
    at = chosen.join(anchors.select("cluster", "anchor"), "cluster", "left").select("cluster", "system", F.coalesce("anchor", "system").alias("at"), F.array(F.coalesce("anchor", "system")).alias("path"))
    parents = is_a.select(F.col("child").alias("at"), F.col("parent").alias("next")).distinct().join(shared.select(F.col("ancestor").alias("next"), "n"), "next", "left").fillna(0, ["n"])
    done = []
    for _ in range(most_depth):
        at = staged(at, "climb")
        done.append(at.where(F.col("at") == F.col("system")))
        rest = at.where(F.col("at") != F.col("system"))
        if rest.isEmpty():
            break
        leads = up.select(F.col("term").alias("next"), F.col("ancestor").alias("system"))
        step = top(rest.join(parents, "at").join(leads, ["next", "system"], "left_semi").where(~F.array_contains("path", F.col("next"))), ["cluster"], [F.desc("n"), F.asc("next")], 1)
        at = step.select("cluster", "system", F.col("next").alias("at"), F.concat(F.array("next"), F.col("path")).alias("path"))
    else:
        raise ValueError("the hierarchy is deeper than allowed")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    every = members.select("cluster").distinct()
    return every.join(found.select("cluster", F.col("path").alias("lineage")), "cluster", "left").select("cluster", F.coalesce("lineage", F.array().cast("array<string>")).alias("lineage"))


def fan_out(found: DataFrame, root: str = "") -> DataFrame:
    """(term, children): how many different terms stand right below each term of the lineages; the root above all systems is ''."""
    whole = F.concat(F.array(F.lit(root)), F.col("lineage"))
    pairs = found.where(F.size("lineage") > 0).select(F.explode(F.arrays_zip(whole.alias("a"), F.col("lineage").alias("b"))).alias("p")).select("p.a", "p.b").where("b IS NOT NULL")
    return pairs.groupBy(F.col("a").alias("term")).agg(F.count_distinct("b").alias("children"))


SEPARATOR = " · "


def cluster_names(clusters: DataFrame) -> DataFrame:
    """(cluster, name) of clusters (cluster, n, own, term, gene): labels of the only member, the most distinctive term and the top gene.

    One member gives its own label; else term and gene, either of them missing.  Names that are equal but for case
    get their term appended, and the cluster's id where that does not tell them apart.
    """
    many = F.concat(F.col("n").cast("string"), F.lit(" related conditions"))
    named = F.when(F.col("n") == 1, F.coalesce("own", F.col("cluster").cast("string"))).when(F.col("term").isNull() & F.col("gene").isNull(), many).when(F.col("term").isNull(), F.concat("gene", F.lit(" disorders"))).otherwise(F.concat_ws(SEPARATOR, "term", "gene"))
    first = staged(clusters.select("cluster", "term", named.alias("name")), "names")
    # How often a name occurs is summed before it is joined: a very common name is no large group.
    again = lambda df: df.join(df.groupBy(F.lower("name").alias("folded")).agg(F.count(F.lit(1)).alias("times")), F.lower("name") == F.col("folded"))
    second = staged(again(first).select("cluster", F.when((F.col("times") > 1) & F.col("term").isNotNull(), F.concat_ws(SEPARATOR, "name", "term")).otherwise(F.col("name")).alias("name")), "names")
    return again(second).select("cluster", F.when(F.col("times") > 1, F.concat("name", F.lit(" (cluster "), F.col("cluster").cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name"))
