"""Cross references: unambiguous ids, filling and propagation, names and symbols by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import top


def unambiguous(pairs: DataFrame) -> DataFrame:
    """(ext, id): external ids that exactly one id claims; a hot external id is counted before it moves."""
    return pairs.groupBy("ext").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").select("ext", "id")


def cross_reference(exact: DataFrame, fill: DataFrame, live: DataFrame) -> DataFrame:
    """(ext, id): unambiguous exact pairs, and from `fill` those that nobody claims with one live target."""
    known = unambiguous(exact)
    alive = fill.join(live.select("id").distinct(), "id", "left_semi").join(exact.select("ext").distinct(), "ext", "left_anti")
    return known.unionByName(unambiguous(alive))


def propagated(first: DataFrame, links: DataFrame, owned: DataFrame) -> DataFrame:
    """(ext, id): ids passed on over (ext, other) links, unless another id owns the other already."""
    onward = first.join(links, "ext").select(F.col("other").alias("ext"), "id").distinct()
    taken = onward.join(owned.select("ext", F.col("id").alias("owner")), "ext").where("owner <> id").select("ext", "id").distinct()
    return first.unionByName(onward.join(taken, ["ext", "id"], "left_anti")).distinct()


def resolved(names: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(name, id): of several ids for a name the one of lowest `priority`, then the first in order."""
    return top(names, key, [F.asc("priority"), *map(F.asc, order)], 1).drop("rank", "priority")
