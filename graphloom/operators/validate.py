"""Data-quality checks: each returns the rows that break it; a report counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling(rows: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    return rows.join(targets.select(F.col(target_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """One row for each occurrence of a key beyond its first."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.explode(F.sequence(F.lit(2), F.col("n"))).alias("occurrence"))


def domain(rows: DataFrame, column: str, allowed: list) -> DataFrame:
    return rows.where(~F.col(column).isin(allowed))


def broken_lineage(lineages: DataFrame, is_a: DataFrame, root: str) -> DataFrame:
    """Lineages (term, path array) that are empty, do not end at the root, or hold a step that is no is_a edge."""
    steps = lineages.select("term", F.explode(F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("child"), F.slice("path", 2, F.size("path")).alias("parent"))).alias("s")).select("term", "s.child", "s.parent")
    bad = steps.join(is_a, ["child", "parent"], "left_anti").select("term")
    ends = lineages.where((F.size("path") == 0) | (F.try_element_at("path", F.lit(-1)) != root)).select("term")
    return bad.unionByName(ends).distinct()


def report(checks: dict[str, DataFrame]) -> DataFrame:
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in checks.items()]
    return reduce(DataFrame.unionByName, counts)
