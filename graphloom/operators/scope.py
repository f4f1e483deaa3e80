"""Growing a scope of ids from seeds: hop by hop, the best offers first, under caps and a check of coherence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import staged


def pathway_offers(genes: DataFrame, members: DataFrame, most_own: int, score: float = 0.5) -> DataFrame:
    """(source, target, score, reason): ids that share a pathway by different genes; ids of more than most_own genes neither ask nor answer.

    genes (id, gene), members (pathway, gene).
    """
    few = genes.groupBy("id").agg(F.count_distinct("gene").alias("own")).where(F.col("own") <= most_own).select("id")
    of = genes.join(few, "id", "left_semi").distinct().join(members.distinct(), "gene")
    one, two = (of.select(F.col("id").alias(x), F.col("gene").alias(f"g_{x}"), "pathway") for x in ("source", "target"))
    return one.join(two, "pathway").where("g_source <> g_target AND source <> target").select("source", "target", F.lit(score).alias("score"), F.concat(F.lit("pathway "), "pathway").alias("reason")).distinct()


def gene_offers(genes: DataFrame, most_own: int, score: float = 1.0) -> DataFrame:
    """(source, target, score, reason): ids that share a gene; ids of more than most_own genes do not ask."""
    few = genes.groupBy("id").agg(F.count_distinct("gene").alias("own")).where(F.col("own") <= most_own).select(F.col("id").alias("source"))
    one = genes.select(F.col("id").alias("source"), "gene").distinct().join(few, "source", "left_semi")
    return one.join(genes.select(F.col("id").alias("target"), "gene").distinct(), "gene").where("source <> target").select("source", "target", F.lit(score).alias("score"), F.concat(F.lit("gene "), "gene").alias("reason"))


def coherent(found: DataFrame, core: DataFrame, similar: DataFrame, annotated: DataFrame, least: float, trusted: str) -> DataFrame:
    """Candidates (id, score, reason) that resemble a core id at least so much; unannotated ones stay for a trusted reason alone.

    similar (a, b, score) in either order, missing pairs count as 0; without an annotated core nothing is compared.
    """
    known = annotated.select("id").distinct()
    asked = core.join(known, "id", "left_semi").select(F.col("id").alias("other"))
    ways = similar.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col("score").alias("s")).unionByName(similar.select(F.col("b").alias("id"), F.col("a").alias("other"), F.col("score").alias("s")))
    best = found.select("id").join(ways, "id").join(asked, "other", "left_semi").groupBy("id").agg(F.max("s").alias("best"))
    j = found.join(known.withColumn("known", F.lit(True)), "id", "left").join(best, "id", "left").join(F.broadcast(asked.agg((F.count(F.lit(1)) > 0).alias("any_core"))))
    keeps = F.when(F.col("known"), ~F.col("any_core") | (F.coalesce("best", F.lit(0.0)) >= least)).otherwise(F.startswith("reason", F.lit(trusted)))
    return j.where(keeps).select("id", "score", "reason")


def expand(seeds: DataFrame, offers: DataFrame, eligible: DataFrame | None, caps: list[int], most: int, hops: int = 2, coherence: dict | None = None) -> DataFrame:
    """(id, hop, score, reason): seeds at hop 0, then at each hop the candidates of best score, ties to the lesser id.

    offers (source, target, score, reason); of several offers of an id the best score counts, then the least
    reason.  caps: how many may join at hop 1, 2, ...; the last holds for the rest; most: how many in all, where
    growth stops.  eligible (id): who may join beside seeds; coherence: arguments of `coherent`.  The rows that
    join at a hop are at most its cap, so choosing them is no large sort.
    """
    offers = staged(offers, "offers")
    scope = staged(seeds.select("id").where("id IS NOT NULL").distinct().select("id", F.lit(0).alias("hop"), F.lit(1.0).alias("score"), F.lit("seed").alias("reason")), "scope")
    front, size = scope, scope.count()
    for hop in range(1, hops + 1):
        room = min(caps[min(hop, len(caps)) - 1], most - size)
        if room <= 0:
            break
        met = offers.join(front.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"), F.struct((-F.col("score")).alias("s"), "reason").alias("o"))
        best = met.groupBy("id").agg(F.min("o").alias("o")).select("id", (-F.col("o.s")).alias("score"), F.col("o.reason").alias("reason")).join(scope, "id", "left_anti")
        if eligible is not None:
            best = best.join(eligible.select("id"), "id", "left_semi")
        if coherence is not None:
            best = coherent(best, scope.where("hop = 0").select("id"), **coherence)
        front = staged(best.orderBy(F.desc("score"), "id").limit(room).select("id", F.lit(hop).alias("hop"), "score", "reason"), "front")
        joined = front.count()
        if not joined:
            break
        scope, size = scope.unionByName(front), size + joined
    return scope
