"""A browsing tree from parent links: cycles lifted, chains spliced, wide leaf sets split, counts and order.

Input (id, parent, label, leaf): a node whose parent is null or unknown is a top.  Everything is joins by
id: pointers double each round to find cycles and the ends of chains, levels go down for depths and up for
sums, and numbers among siblings come from sorted ranges, so no parent's children are held by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import placed, staged


def folded(label: Column) -> Column:
    return F.lower(label)


def cycle_tops(nodes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id): of every cycle of parent links its least node."""
    up = nodes.where(F.col("parent").isNotNull()).join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi")
    at = staged(up.select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("least")), "pointers")
    n = at.count()
    for i in range(most_rounds):
        if (1 << i) > n:
            break
        step = at.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("least").alias("their"))
        # Nodes whose way ends at a top drop out; the others keep going round.
        at = staged(at.join(step, "to").select("id", F.col("next").alias("to"), F.least("least", "their").alias("least")), "pointers")
        if at.isEmpty():
            break
    return at.where("id = least").select("id").join(at.select(F.col("to").alias("id")).distinct(), "id", "left_semi")


def lifted(nodes: DataFrame) -> DataFrame:
    """Parents that exist and form no cycle: the least node of each cycle becomes a top."""
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    tops = cycle_tops(nodes).withColumn("top", F.lit(True))
    parent = F.when(F.col("known") & F.col("top").isNull(), F.col("parent"))
    return staged(nodes.join(ids, "parent", "left").join(tops, "id", "left").select("id", parent.alias("parent"), "label", "leaf"), "lifted")


def spliced(nodes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Groups below the top whose only child is a group go; the child hangs under the nearest group that stays."""
    only = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.count_if("leaf").alias("leaves")).where("n = 1 and leaves = 0").select(F.col("parent").alias("id"))
    gone = staged(nodes.where(F.col("parent").isNotNull()).join(only, "id", "left_semi").select(F.col("id").alias("gone"), F.col("parent").alias("above")), "chains")
    for _ in range(most_rounds):
        step = gone.select(F.col("gone").alias("above"), F.col("above").alias("next"))
        longer = gone.join(step, "above", "left")
        if longer.where(F.col("next").isNotNull()).isEmpty():
            break
        gone = staged(longer.select("gone", F.coalesce("next", "above").alias("above")), "chains")
    kept = nodes.join(gone.select(F.col("gone").alias("id")), "id", "left_anti")
    return kept.join(gone.withColumnRenamed("gone", "parent"), "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"), "label", "leaf")


def split(nodes: DataFrame, most: int) -> DataFrame:
    """Where a group has more than `most` leaves they go under alphabetical ranges of even size (columns of nodes and `ordered`)."""
    leaves = placed(nodes.where("leaf and parent is not null"), ["parent"], [folded(F.col("label")), F.col("id")])
    n = leaves.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    chunk = F.floor(F.col("place") / F.ceil(F.col("n") / F.ceil(F.col("n") / most))).cast("int")
    wide = staged(leaves.join(n, "parent").withColumn("chunk", chunk).withColumn("range", F.concat("parent", F.lit("/r"), F.col("chunk") + 1)), "wide")
    head = lambda c: F.initcap(F.coalesce(F.nullif(F.substring(F.trim(c), 1, 2), F.lit("")), F.lit("?")))
    ends = wide.groupBy("range", "parent").agg(F.min_by("label", "place").alias("first"), F.max_by("label", "place").alias("last"))
    ranges = ends.select(F.col("range").alias("id"), "parent", F.concat(head(F.col("first")), F.lit("–"), head(F.col("last"))).alias("label"), F.lit(False).alias("leaf"))
    moved = wide.select("id", F.col("range").alias("new"))
    return nodes.join(moved, "id", "left").select("id", F.coalesce("new", "parent").alias("parent"), "label", "leaf").unionByName(ranges)


def levels(nodes: DataFrame, most_depth: int = 200) -> list[DataFrame]:
    """The nodes by depth, tops first: (id, parent, label, leaf, depth)."""
    out = [staged(nodes.where(F.col("parent").isNull()).withColumn("depth", F.lit(0)), "level")]
    while len(out) <= most_depth:
        above = out[-1].select(F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"))
        below = staged(nodes.join(above, "parent").select("id", "parent", "label", "leaf", "depth"), "level")
        if below.isEmpty():
            return out
        out.append(below)
    raise ValueError("the tree is deeper than allowed")


def counted(by_depth: list[DataFrame]) -> DataFrame:
    """All levels with `count`, the leaves at or below each node, summed a level at a time from below."""
    out, below = [], None
    for level in reversed(by_depth):
        own = F.when(F.col("leaf"), 1).otherwise(0).cast("long")
        if below is None:
            now = level.withColumn("count", own)
        else:
            sums = below.groupBy(F.col("parent").alias("id")).agg(F.sum("count").alias("below"))
            now = level.join(sums, "id", "left").withColumn("count", own + F.coalesce("below", F.lit(0))).drop("below")
        below = staged(now, "counted")
        out.append(below)
    return reduce(DataFrame.unionByName, out)


def build(nodes: DataFrame, most_leaves: int = 30) -> DataFrame:
    """(id, parent, label, leaf, depth, count, place): the finished tree.

    place numbers siblings from 0: groups with children first, by count falling, then the others, each by folded label
    and id.  Ids must be unique; null labels count as empty.  An empty table gives an empty tree.
    """
    nodes = nodes.select("id", "parent", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    shaped = staged(split(staged(spliced(lifted(staged(nodes, "nodes"))), "spliced"), most_leaves), "shaped")
    sums = counted(levels(shaped))
    has = shaped.select(F.col("parent").alias("id")).where("id is not null").distinct().withColumn("branch", F.lit(True))
    rows = sums.join(has, "id", "left").withColumn("rest", F.when(F.col("branch"), -F.col("count")).otherwise(1))
    out = placed(rows, ["parent"], [F.col("rest"), folded(F.col("label")), F.col("id")])
    return out.select("id", "parent", "label", "leaf", "depth", "count", F.col("place").cast("long").alias("place"))
