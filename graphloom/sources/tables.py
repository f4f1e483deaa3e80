"""The driver's tables as contract tables: nodes, assertions, ontology, profiles, intervals.

Parts stand for diseases, suppliers for genes, brands and types for ontology terms, customers for
profiles and authors, orders for works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import dealt


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def assertions(lineitem: DataFrame) -> DataFrame:
    """One claim a line: the part is caused by the supplier."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return lineitem.select(
        F.concat(F.lit("PART:"), "l_partkey").alias("source_id"),
        F.lit("caused_by_variant_in").alias("relation"),
        F.concat(F.lit("SUPP:"), "l_suppkey").alias("target_id"),
        F.when(status == "O", "inferred").otherwise("observed").alias("origin"),
        F.when(flag == "N", "curated_db").when(flag == "A", "review").otherwise("peer_reviewed").alias("tier"),
        status.alias("source_type"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_ref"),
        F.when(flag == "R", "contradicts").otherwise("supports").alias("polarity"),
        F.when(status == "O", F.col("l_discount") * 10).alias("weight"),
    )


def nodes(part: DataFrame, supplier: DataFrame) -> DataFrame:
    a = part.select(F.concat(F.lit("PART:"), "p_partkey").alias("id"), F.lit("disease").alias("type"), F.col("p_name").alias("label"))
    return a.unionByName(supplier.select(F.concat(F.lit("SUPP:"), "s_suppkey").alias("id"), F.lit("gene").alias("type"), F.col("s_name").alias("label")))


def is_a(part: DataFrame) -> DataFrame:
    """(child, parent): part under brand and type, both under ROOT."""
    brand, kind = F.concat(F.lit("BRAND:"), "p_brand"), F.concat(F.lit("TYPE:"), "p_type")
    term = F.concat(F.lit("PART:"), "p_partkey")
    up = part.select(term.alias("child"), F.explode(F.array(brand, kind)).alias("parent"))
    tops = part.select(F.explode(F.array(brand, kind)).alias("child")).distinct().withColumn("parent", F.lit("ROOT"))
    return up.unionByName(tops)


def profiles(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """(profile, term, frequency): customers and the parts they bought, with shares of their lines."""
    bought = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).where("o_custkey IS NOT NULL").select(F.col("o_custkey").alias("profile"), "l_partkey")
    # Lines are dealt by profile once, which serves both counts.
    counted = dealt(bought, lineitem.count(), "profile").groupBy("profile", F.concat(F.lit("PART:"), "l_partkey").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("profile", "term", (F.col("n") / F.sum("n").over(Window.partitionBy("profile"))).alias("frequency"))
