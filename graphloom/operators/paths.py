"""The k cheapest simple paths of given node pairs, by bounds from both ends.

Costs are -ln(confidence) of each edge, and inside a path a penalty on generic nodes that grows with
their degree; generic nodes that are hubs may only be ends.  First the cheapest way from every node near a
target is found by rounds from the targets (walks, so a lower bound of paths).  Then paths grow from the
sources, a hop a round, and meet that table, so a node from which the target is out of reach in the
hops left is dropped when it is entered.  A first pass keeps only the most promising partial paths of each
pair and gives an upper bound of the k-th cost; the second keeps all whose cost and remaining lower
bound are within it, so its result is exact.  Every step is staged in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SUPPORTED
from ..shared import staged
from .graph import edge_cost, hub_penalty
from .merge import top


def steps(edges: DataFrame, least: float, generic: DataFrame, hub_degree: DataFrame | None) -> DataFrame:
    """(at, to, edge, c, confidence, observed, penalty, closed): the cheapest active edge of each node pair, both ways.

    edges (id, source_id, target_id, confidence, origin, status, n_evidence); ties go to more evidence, then
    the lesser id.  generic (node, degree): nodes that cost a penalty; of them those of hub_degree
    (one row, threshold) or more are closed.
    """
    live = edges.where((F.col("status") == "active") & (F.col("source_id") != F.col("target_id")) & (F.col("confidence") > 0) & (F.col("confidence") >= least))
    one = live.select(F.least("source_id", "target_id").alias("at"), F.greatest("source_id", "target_id").alias("to"), F.struct(edge_cost(F.col("confidence")).alias("c"), (-F.col("n_evidence")).alias("e"), "id", "confidence", (F.col("origin") == "observed").alias("observed")).alias("s"))
    best = one.groupBy("at", "to").agg(F.min("s").alias("s"))
    best = best.select("at", "to", "s").unionByName(best.select(F.col("to").alias("at"), F.col("at").alias("to"), "s"))
    closed = F.lit(False) if hub_degree is None else F.col("degree") >= F.col("threshold")
    g = generic if hub_degree is None else generic.join(F.broadcast(hub_degree))
    g = g.select(F.col("node").alias("to"), hub_penalty(F.col("degree")).alias("penalty"), closed.alias("closed"))
    j = best.join(g, "to", "left")
    return staged(j.select("at", "to", F.col("s.id").alias("edge"), F.col("s.c").alias("c"), F.col("s.confidence").alias("confidence"), F.col("s.observed").alias("observed"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"), F.coalesce("closed", F.lit(False)).alias("closed")), "steps")


def remaining(step: DataFrame, targets: DataFrame, hops: int) -> list[DataFrame]:
    """For 1 to `hops` hops: (target, at, left), the cheapest walk from a node to the target, the node's own penalty left out."""
    back = step.select(F.col("to").alias("mid"), "at", "c", "penalty", "closed")
    near = back.join(targets.select(F.col("target").alias("mid")).distinct(), "mid").select(F.col("mid").alias("target"), "at", F.col("c").alias("left"))
    out = [staged(near, "remaining")]
    for _ in range(hops - 1):
        more = out[-1].withColumnRenamed("at", "mid").join(back.where(~F.col("closed")), "mid").where(F.col("at") != F.col("target"))
        walk = more.select("target", "at", (F.col("c") + F.col("penalty") + F.col("left")).alias("left"))
        out.append(staged(out[-1].unionByName(walk).groupBy("target", "at").agg(F.min("left").alias("left")), "remaining"))
    return out


def grown(step: DataFrame, pairs: DataFrame, left: list[DataFrame], hops: int, within: DataFrame | None, beam: int | None) -> DataFrame:
    """Complete simple paths: (source, target, nodes, edges, cost, least, all_observed, total).

    within (source, target, most): partial paths whose cost and least rest exceed it go; beam: only so many go on.
    """
    at = pairs.select("source", "target", F.col("source").alias("at"), F.array("source").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.lit(0.0).alias("cost"), F.lit(1.0).alias("least"), F.lit(True).alias("all_observed"), F.lit(0.0).alias("total"))
    found = []
    for h in range(1, hops + 1):
        end = F.col("to") == F.col("target")
        j = at.join(step, "at").where(~F.array_contains("nodes", F.col("to"))).select(
            "source",
            "target",
            F.col("to").alias("at"),
            F.concat("nodes", F.array("to")).alias("nodes"),
            F.concat("edges", F.array("edge")).alias("edges"),
            (F.col("cost") + F.col("c") + F.when(end, 0.0).otherwise(F.col("penalty"))).alias("cost"),
            F.least("least", "confidence").alias("least"),
            (F.col("all_observed") & F.col("observed")).alias("all_observed"),
            (F.col("total") + F.col("c")).alias("total"),
            "closed",
            end.alias("end"),
        )
        done, open_ = j.where("end"), j.where("not end and not closed")
        if within is not None:
            done = done.join(within, ["source", "target"]).where(F.col("cost") <= F.col("most")).drop("most")
        found.append(staged(done.drop("end", "closed", "at"), "found"))
        if h == hops:
            break
        open_ = open_.join(left[hops - h - 1], ["target", "at"])
        if within is not None:
            open_ = open_.join(within, ["source", "target"]).where(F.col("cost") + F.col("left") <= F.col("most")).drop("most")
        if beam is not None:
            open_ = top(open_, ["source", "target"], [F.asc(F.round(F.col("cost") + F.col("left"), 9)), F.asc(F.array_join("nodes", ">"))], beam).drop("rank")
        at = staged(open_.drop("left", "end", "closed"), "open")
    return reduce(DataFrame.unionByName, found)


def k_cheapest(edges: DataFrame, pairs: DataFrame, hops: int, k: int, generic: DataFrame, hub_degree: DataFrame | None = None, least: float = SUPPORTED) -> DataFrame:
    """(source, target, rank, weight, total_cost, min_confidence, all_observed, hops, nodes, path_id) of at most `hops` edges.

    pairs (source, target); equal ends give no path, as do ends without edges.  weight holds the penalties,
    total_cost does not.  Ties in weight (9 places) go by the nodes' ids.
    """
    pairs = staged(pairs.where("source <> target").select("source", "target").distinct(), "pairs")
    step = steps(edges, least, generic, hub_degree)
    left = remaining(step, pairs, max(1, hops - 1))
    weight = F.round("cost", 9)
    order = [weight.asc(), F.asc(F.array_join("nodes", ">"))]
    first = top(grown(step, pairs, left, hops, None, 4 * k), ["source", "target"], order, k)
    most = first.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("most"))
    bound = staged(pairs.join(most, ["source", "target"], "left").select("source", "target", F.when(F.col("n") == k, F.col("most") + 1e-8).otherwise(F.lit(float("inf"))).alias("most")), "bounds")
    ranked = top(grown(step, pairs, left, hops, bound, None), ["source", "target"], order, k)
    name = F.concat(F.lit("p_"), F.substring(F.sha1(F.array_join("edges", ">")), 1, 16))
    return ranked.select("source", "target", "rank", weight.alias("weight"), F.round("total", 6).alias("total_cost"), F.col("least").alias("min_confidence"), "all_observed", F.size("edges").alias("hops"), F.array_join("nodes", ">").alias("nodes"), name.alias("path_id"))


def coverage(pairs: DataFrame, found: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source, target, status, source_type, n): evidence on the edges around both ends of each pair, every known type told.

    found: paths of the pairs; edges (id, source_id, target_id); evidence (edge_id, source_type, n).
    """
    pairs = pairs.where("source <> target").select("source", "target").distinct()
    around = edges.select(F.explode(F.array("source_id", "target_id")).alias("node"), F.col("id").alias("edge_id")).distinct()
    ends = pairs.select("source", "target", F.explode(F.array("source", "target")).alias("node"))
    # Summed by node first, so that a hub asked for by many pairs is read once; an edge between the ends counts once.
    per_node = around.join(evidence, "edge_id").groupBy("node", "source_type").agg(F.sum("n").alias("n"))
    between = pairs.join(edges.select(F.col("id").alias("edge_id"), F.explode(F.array(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target")), F.struct(F.col("target_id").alias("source"), F.col("source_id").alias("target")))).alias("p")).select("edge_id", "p.*"), ["source", "target"]).join(evidence, "edge_id").groupBy("source", "target", "source_type").agg((-F.sum("n")).alias("n"))
    counted = ends.join(per_node, "node").select("source", "target", "source_type", "n").unionByName(between).groupBy("source", "target", "source_type").agg(F.sum("n").alias("n"))
    known = evidence.select("source_type").distinct()
    every = pairs.join(F.broadcast(known)).join(counted, ["source", "target", "source_type"], "left")
    ok = found.select("source", "target", F.lit("ok").alias("ok")).distinct()
    return every.join(ok, ["source", "target"], "left").select("source", "target", F.coalesce("ok", F.lit("no_supported_route")).alias("status"), "source_type", F.coalesce("n", F.lit(0)).alias("n"))
