"""Clusters of a signed graph: Leiden rounds on a pulling and a pushing layer, then a repair that parts forbidden pairs.

The quality of a partition is the modularity of the positive layer less that of the negative one.  A
level has three steps: nodes move between communities while that raises the quality; each community
is refined into connected parts, built from single nodes by the same moves inside it; the parts become
the nodes of the next level, which starts from the communities.  Levels end when no part has two nodes.

All steps are joins and sums by community and node; no community is held by one task.  In a round every
node finds its best move from the sums of the round before.  Half of the nodes, dealt by hash, move at
once; if that does not raise the quality, only moves that share no community with a better one are made,
whose gains add up.  So quality never falls and the rounds end.  Ties go to the least label: results do
not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import staged

EPS = 1e-7


def both_ways(links: DataFrame) -> DataFrame:
    """(node, other, p, n) of links (a, b, positive, negative) in both directions, one row a pair; loops go."""
    one = links.where("a <> b").select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("other"), F.col("positive").alias("p"), F.col("negative").alias("n")).groupBy("node", "other").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"), "p", "n"))


class Layers:
    """Links and weights of one level, and the constants of the quality."""

    def __init__(self, links: DataFrame, nodes: DataFrame, totals: tuple[float, float], resolution: float):
        self.links, self.nodes, self.totals, self.resolution = links, nodes, totals, resolution

    @classmethod
    def first(cls, links: DataFrame, nodes: DataFrame, resolution: float) -> Layers:
        """nodes: (node); the weights are a node's summed links."""
        links = staged(links, "links")
        k = links.groupBy("node").agg(F.sum("p").alias("kp"), F.sum("n").alias("kn"))
        nodes = staged(nodes.select("node").distinct().join(k, "node", "left").fillna(0.0, ["kp", "kn"]).withColumns({"sp": F.lit(0.0), "sn": F.lit(0.0)}), "nodes")
        t = nodes.agg(F.sum("kp"), F.sum("kn")).first()
        return cls(links, nodes, (t[0] or 1.0, t[1] or 1.0), resolution)

    def pull(self, p: Column, n: Column, kp: Column, kn: Column, others_p: Column, others_n: Column) -> Column:
        """What a node adds to the quality of a community (half of it): ties within, less what chance would give."""
        g = self.resolution
        return (p - g * kp * others_p / self.totals[0]) - (n - g * kn * others_n / self.totals[1])

    def quality(self, state: DataFrame) -> float:
        inner = self.links.join(state.select("node", "c"), "node").join(state.select(F.col("node").alias("other"), F.col("c").alias("d")), "other").where("c = d")
        sums = self.nodes.join(state, "node").groupBy("c").agg(F.sum("kp").alias("kp"), F.sum("kn").alias("kn"), F.sum(F.col("sp") - F.col("sn")).alias("own"))
        g = self.resolution
        rest = sums.select((F.col("own") - g * F.col("kp") * F.col("kp") / self.totals[0] + g * F.col("kn") * F.col("kn") / self.totals[1]).alias("x"))
        return inner.select((F.col("p") - F.col("n")).alias("x")).unionByName(rest).agg(F.sum("x")).first()[0] or 0.0

    def proposals(self, state: DataFrame, leave: bool) -> DataFrame:
        """(node, c, to, gain): each node's best move, if it raises the quality.

        state: (node, c, home): only nodes of one home may share a community; leave: nodes may also go alone,
        else only nodes that are alone move.
        """
        s = self.nodes.join(state, "node")
        sums = s.groupBy("c").agg(F.sum("kp").alias("all_p"), F.sum("kn").alias("all_n"), F.count(F.lit(1)).alias("size"))
        there = state.select(F.col("node").alias("other"), F.col("c").alias("to"), F.col("home").alias("their_home"))
        ties = self.links.join(state.select("node", "home"), "node").join(there, "other").where("home = their_home").groupBy("node", "to").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        own = state.select("node", F.col("c").alias("to"), F.lit(0.0).alias("p"), F.lit(0.0).alias("n"))
        every = ties.unionByName(own).groupBy("node", "to").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        j = every.join(s, "node").join(sums.withColumnRenamed("c", "to"), "to")
        same = (F.col("to") == F.col("c")).cast("double")
        j = j.withColumn("value", F.round(self.pull(F.col("p"), F.col("n"), F.col("kp"), F.col("kn"), F.col("all_p") - same * F.col("kp"), F.col("all_n") - same * F.col("kn")), 9))
        is_own = F.col("to") == F.col("c")
        best = j.groupBy("node", "c").agg(F.max(F.when(is_own, F.col("value"))).alias("stay"), F.max(F.when(is_own, F.col("size"))).alias("size"), F.min(F.when(~is_own, F.struct((-F.col("value")).alias("v"), F.col("to").alias("to")))).alias("go"))
        value, to = -F.col("go.v"), F.col("go.to")
        if leave:
            out = (F.col("size") > 1) & (F.coalesce(value, F.lit(-1.0)) < 0)
            value, to = F.when(out, 0.0).otherwise(value), F.when(out, -F.col("node") - 1).otherwise(to)
        else:
            best = best.where("size = 1")
        return best.select("node", "c", to.alias("to"), (value - F.col("stay")).alias("gain")).where(F.col("gain") > EPS)


def renamed(state: DataFrame) -> DataFrame:
    """Communities called by their least node."""
    least = state.groupBy("c").agg(F.min("node").alias("least"))
    return state.join(least, "c").select("node", F.col("least").alias("c"), "home")


def apart(moves: DataFrame) -> DataFrame:
    """Moves that share no community with a better one (ties to the lesser node)."""
    at = moves.select(F.explode(F.array("c", "to")).alias("at"), F.struct((-F.col("gain")).alias("g"), "node").alias("key"))
    best = at.groupBy("at").agg(F.min("key").alias("key")).select("at", F.col("key.node").alias("winner"))
    one, two = (best.select(F.col("at").alias(x), F.col("winner").alias(f"w_{x}")) for x in ("c", "to"))
    return moves.join(one, "c").join(two, "to").where("node = w_c and node = w_to").select("node", "c", "to", "gain")


def settled(layers: Layers, state: DataFrame, leave: bool, most_rounds: int, salt: str) -> DataFrame:
    """Rounds of moves until none raises the quality, or most_rounds."""
    quality = None
    for i in range(most_rounds):
        moves = staged(layers.proposals(state, leave), "moves")
        if moves.isEmpty():
            break
        quality = layers.quality(state) if quality is None else quality
        # Alone nodes that join a node which itself moves could part from it; by turns they do not.
        turn = F.crc32(F.concat_ws(":", F.lit(f"{salt}{i}"), F.col("node").cast("string"))) % 2 == 0
        for chosen in (moves.where(turn), apart(moves)):
            new = staged(renamed(state.join(chosen.select("node", "to"), "node", "left").select("node", F.coalesce("to", "c").alias("c"), "home")), "state")
            after = layers.quality(new)
            if after > quality + EPS:
                state, quality = new, after
                break
        else:
            break  # gains below what rounding can tell
    return state


def leiden(links: DataFrame, nodes: DataFrame, resolution: float = 1.0, most_levels: int = 10, most_rounds: int = 40) -> DataFrame:
    """(node, cluster): communities of (a, b, positive, negative) links over all nodes, called by their least node (long).

    Null or missing weights count as nothing; nodes without links stay alone.  most_levels and most_rounds
    only bound a run that keeps finding tiny gains.
    """
    links = links.select("a", "b", F.coalesce("positive", F.lit(0.0)).alias("positive"), F.coalesce("negative", F.lit(0.0)).alias("negative"))
    level = Layers.first(both_ways(links), nodes, resolution)
    inside = level.nodes.select(F.col("node").alias("vertex"), "node")
    state = level.nodes.select("node", F.col("node").alias("c"), F.lit(0).cast("long").alias("home"))
    for depth in range(most_levels):
        state = settled(level, state, True, most_rounds, f"move{depth}:")
        alone = staged(state.select("node", F.col("node").alias("c"), F.col("c").alias("home")), "alone")
        parts = settled(level, alone, False, most_rounds, f"refine{depth}:")
        merged = parts.where("node <> c").limit(1).count()
        if not merged:
            break
        up = staged(parts.select("node", F.col("c").alias("part"), "home"), "parts")
        inside = staged(inside.join(up, "node").select("vertex", F.col("part").alias("node")), "inside")
        j = level.links.join(up.select("node", F.col("part").alias("x")), "node").join(up.select(F.col("node").alias("other"), F.col("part").alias("y")), "other").groupBy("x", "y").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        j = staged(j, "links")
        loops = j.where("x = y").select(F.col("x").alias("node"), F.col("p").alias("lp"), F.col("n").alias("ln"))
        grown = level.nodes.join(up, "node").groupBy(F.col("part").alias("node")).agg(*(F.sum(c).alias(c) for c in ("kp", "kn", "sp", "sn")))
        grown = grown.join(loops, "node", "left").select("node", "kp", "kn", (F.col("sp") + F.coalesce("lp", F.lit(0.0))).alias("sp"), (F.col("sn") + F.coalesce("ln", F.lit(0.0))).alias("sn"))
        level = Layers(j.where("x <> y").select(F.col("x").alias("node"), F.col("y").alias("other"), "p", "n"), staged(grown, "nodes"), level.totals, resolution)
        state = staged(renamed(up.groupBy(F.col("part").alias("node")).agg(F.min("home").alias("c")).withColumn("home", F.lit(0).cast("long"))), "state")
    found = inside.join(state, "node").select(F.col("vertex").alias("node"), "c")
    least = found.groupBy("c").agg(F.min("node").alias("cluster"))
    return staged(found.join(least, "c").select("node", "cluster"), "clusters")


def parted(links: DataFrame, clusters: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, cluster) in which no pair with a negative link shares a cluster.

    Of each such pair the node with fewer positive neighbours (then the larger) moves to the cluster it is
    most tied to among those that hold none of its negative neighbours, or goes alone.  In a round all
    movers go but those with a better-tied negative neighbour that goes to the same cluster; every move
    parts at least one pair and joins none, so the rounds end.
    """
    e = staged(both_ways(links), "signed")
    against = e.where("n > 0").select("node", "other")
    ties = e.where("p > 0 and n <= 0").select("node", "other", "p")
    degree = ties.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    state = clusters.select("node", F.col("cluster").alias("c"))
    their = lambda: state.select(F.col("node").alias("other"), F.col("c").alias("d"))
    for _ in range(most_rounds):
        bad = against.where("node < other").join(state, "node").join(their(), "other").where("c = d").select("node", "other")
        size = lambda x: degree.select(F.col("node").alias(x), F.col("deg").alias(f"deg_{x}"))
        mover = bad.join(size("node"), "node", "left").join(size("other"), "other", "left").select(F.when(F.coalesce("deg_other", F.lit(0)) <= F.coalesce("deg_node", F.lit(0)), F.col("other")).otherwise(F.col("node")).alias("node")).distinct()
        mover = staged(mover, "movers")
        if mover.isEmpty():
            return state.select("node", F.col("c").alias("cluster"))
        banned = mover.join(against, "node").join(their(), "other").select("node", "d").distinct()
        able = mover.join(ties, "node").join(their(), "other").groupBy("node", "d").agg(F.round(F.sum("p"), 9).alias("w")).join(banned, ["node", "d"], "left_anti")
        best = able.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("v"), "d")).alias("b")).select("node", F.col("b.d").alias("to"), (-F.col("b.v")).alias("w"))
        goes = staged(mover.join(best, "node", "left"), "goes")
        rival = goes.select(F.col("node").alias("other"), F.col("to").alias("their_to"), F.col("w").alias("their_w"))
        beaten = goes.join(against, "node").join(rival, "other").where((F.col("to") == F.col("their_to")) & ((F.col("their_w") > F.col("w")) | ((F.col("their_w") == F.col("w")) & (F.col("other") < F.col("node"))))).select("node").distinct()
        moves = goes.join(beaten, "node", "left_anti").select("node", F.coalesce("to", -F.col("node") - 1).alias("to"))
        new = state.join(moves, "node", "left").select("node", F.coalesce("to", "c").alias("c"))
        least = new.groupBy("c").agg(F.min("node").alias("least"))
        state = staged(new.join(least, "c").select("node", F.col("least").alias("c")), "parted")
    raise RuntimeError("forbidden pairs were not parted")


def signed_clusters(links: DataFrame, nodes: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, cluster, size): Leiden communities without a forbidden pair; links (a, b, positive, negative) with long ends."""
    found = parted(links, leiden(links, nodes, resolution))
    size = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return found.join(size, "cluster").select("node", "cluster", "size")
