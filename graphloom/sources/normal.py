"""Parsed records as contract tables (nodes, synonyms, assertions), restricted to a scope of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.contract import coerced


def within(df: DataFrame, column: str, scope: DataFrame | None) -> DataFrame:
    """Rows whose column is in scope (id); no scope keeps all."""
    return df if scope is None else df.join(scope.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def terms(parsed: DataFrame, kind: str, source: str, scope: DataFrame | None = None) -> dict[str, DataFrame]:
    """Ontology terms (see sources.files): live ones as nodes of a type, with synonyms and cross references, and is_a claims.

    A claim needs both ends live and in scope; broken and obsolete records go.
    """
    live = within(parsed.where("NOT bad AND NOT obsolete AND id IS NOT NULL"), "id", scope)
    attrs = F.to_json(F.struct(F.array_sort("xrefs").alias("xrefs")))
    nodes = live.select("id", F.lit(kind).alias("type"), F.col("name").alias("label"), F.col("definition").alias("description"), attrs.alias("attrs"))
    synonyms = live.select(F.col("id").alias("node_id"), F.explode("synonyms").alias("synonym"), F.lit(source).alias("source")).where(F.lower("synonym") != F.lower(F.lit("")))
    up = live.select(F.col("id").alias("source_id"), F.explode("parents").alias("target_id"))
    claims = up.join(live.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(
        "source_id", "target_id", F.lit("is_a").alias("relation"), F.lit("observed").alias("origin"), F.lit("curated_db").alias("tier"), F.lit(source).alias("source_type"), F.col("source_id").alias("source_ref"), F.lit("supports").alias("polarity")
    )
    return {"nodes": coerced(nodes, "nodes"), "synonyms": coerced(synonyms, "synonyms"), "assertions": coerced(claims, "assertions")}


def annotations(parsed: DataFrame, prefix: str, source: str, aspect: str = "P", scope: DataFrame | None = None) -> DataFrame:
    """Claims that gene products take part in terms of one aspect, one a reference; negated ones contradict."""
    rows = within(parsed.where((~F.col("bad")) & (F.col("aspect") == aspect)).withColumn("source_id", F.concat(F.lit(prefix), "object_id")), "source_id", scope)
    each = rows.select("*", F.explode_outer("references").alias("source_ref"))
    tier = F.when(F.col("evidence") == "IEA", "computed").otherwise("curated_db")
    return coerced(each.select("source_id", F.col("term").alias("target_id"), F.lit("participates_in").alias("relation"), F.when(F.col("evidence") == "IEA", "inferred").otherwise("observed").alias("origin"), tier.alias("tier"), F.lit(source).alias("source_type"), "source_ref", F.when(F.col("negated"), "contradicts").otherwise("supports").alias("polarity"), F.col("date").alias("retrieved_at")), "assertions")
