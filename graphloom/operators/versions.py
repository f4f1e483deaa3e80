"""Differences of two versions of a table, and recomputing only what they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, fields): keys added, gone or changed, and the names of the fields that differ.

    Keys must be unique in each version and not null.  Rows are compared by a digest first, so that only changed
    ones are compared by field; nulls equal each other.
    """
    mark = lambda df, side: df.select(F.col(key).alias(key), F.struct(*columns).alias(side), F.xxhash64(*columns).alias(f"{side}_hash")).where(F.col(key).isNotNull())
    j = mark(old, "was").join(mark(new, "now"), key, "full")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")), F.lit(c)) for c in columns)))
    kind = F.when(F.col("was_hash").isNull(), "added").when(F.col("now_hash").isNull(), "gone").when(F.col("was_hash") != F.col("now_hash"), "changed")
    fields = F.when(F.col("change") == "changed", differs).otherwise(F.array().cast("array<string>"))
    return j.withColumn("change", kind).where(F.col("change").isNotNull()).select(key, "change", fields.alias("fields"))


def refreshed(result: DataFrame, source: DataFrame, touched: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A result by key brought up to date: rows of untouched keys stay, those of touched keys are computed from source.

    touched (key, change); compute must give rows of a key from source rows of that key alone.
    """
    keys = touched.select(key).distinct()
    stays = result.join(keys, key, "left_anti")
    again = compute(source.join(keys, key, "left_semi"))
    return stays.select(*result.columns).unionByName(again.select(*result.columns))
