"""Registered queries of the file readers: the driver's tables written in public formats and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources import files as R
from ..sources import normal as N
from ..sources import tables as T
from .catalog import query


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _obo(spark, d) -> str:
    """The parts as stanzas: brand and type as parents, names as quoted synonyms, every seventh obsolete."""
    p = T.read(spark, d, "part")
    line = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    c = F.col
    text = F.concat_ws("\n", F.lit("[Term]"), line("id: PART:", c("p_partkey")), line("name: ", c("p_name")), line('def: "size ', c("p_size"), '" [x]'), line('synonym: "', c("p_name"), ' \\"', c("p_size"), '\\"" EXACT []'), line("xref: OMIM:", c("p_partkey"), " {note}"), line("is_a: BRAND:", c("p_brand"), " ! brand"), line("is_a: TYPE:", F.regexp_replace("p_type", " ", "_")), F.when(c("p_partkey") % 7 == 0, F.lit("is_obsolete: true")), F.lit(""))
    tops = p.select(F.explode(F.array(line("BRAND:", c("p_brand")), line("TYPE:", F.regexp_replace("p_type", " ", "_")))).alias("id")).distinct()
    path = _path(spark, "obo")
    p.select(text.alias("value")).unionByName(tops.select(line("[Term]\nid: ", c("id"), "\nname: ", c("id"), "\n").alias("value"))).write.text(path)
    return path


SQL_TERMS = "t AS (SELECT 'PART:' || p_partkey AS id, p_name AS name, 'BRAND:' || p_brand AS b, 'TYPE:' || replace(p_type, ' ', '_') AS y, p_partkey % 7 = 0 AS obsolete, p_size, p_partkey FROM part)"


@query("WITH " + SQL_TERMS + " SELECT id, name, 'size ' || p_size AS definition, b || ',' || y AS parents, name || ' \"' || p_size || '\"' AS synonyms, 'OMIM:' || p_partkey AS xrefs, obsolete FROM t UNION ALL SELECT DISTINCT unnest([b, y]), unnest([b, y]), NULL, '', '', '', false FROM t")
def obo_terms(spark, d):
    df = R.obo(spark, _obo(spark, d))
    return df.select("id", "name", "definition", *(F.array_join(c, ",").alias(c) for c in ("parents", "synonyms", "xrefs")), "obsolete")


@query("WITH " + SQL_TERMS + ", live AS (SELECT id, b, y FROM t WHERE NOT obsolete) SELECT 'assertions' AS \"table\", 2 * count(*) AS rows FROM live UNION ALL SELECT 'nodes', (SELECT count(*) FROM live) + (SELECT count(DISTINCT v) FROM (SELECT unnest([b, y]) AS v FROM t)) UNION ALL SELECT 'synonyms', count(*) FROM live")
def normalized_terms(spark, d):
    tables = N.terms(R.obo(spark, _obo(spark, d)), "disease", "ontology")
    count = lambda name: tables[name].agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
    return count("assertions").unionByName(count("nodes")).unionByName(count("synonyms"))


@query("SELECT 'SUPP:' || l_suppkey AS source_id, 'PART:' || l_partkey AS target_id, CASE WHEN l_linestatus = 'O' THEN 'inferred' ELSE 'observed' END AS origin, CASE WHEN l_linestatus = 'O' THEN 'computed' ELSE 'curated_db' END AS tier, 'PMID:' || l_orderkey AS source_ref, CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'supports' END AS polarity, strftime(l_shipdate, '%Y%m%d') AS retrieved_at FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL")
def normalized_annotations(spark, d):
    """Lines as GAF rows; the third line of an order has another aspect, R lines are negated."""
    c, lit = F.col, F.lit
    fields = {"db": lit("DB"), "object_id": c("l_suppkey"), "symbol": lit("S"), "qualifier": F.when(c("l_returnflag") == "R", "NOT|involved_in").otherwise("involved_in"), "term": F.concat(lit("PART:"), "l_partkey"), "reference": F.concat(lit("PMID:"), "l_orderkey"), "evidence": F.when(c("l_linestatus") == "O", "IEA").otherwise("IDA"), "with_from": lit(""), "aspect": F.when(c("l_linenumber") == 3, "F").otherwise("P"), "name": lit("n"), "synonyms": lit("a|b"), "type": lit("protein"), "taxon": lit("taxon:1"), "date": F.date_format("l_shipdate", "yyyyMMdd"), "assigned_by": lit("X"), "extension": lit(""), "form": lit("")}
    path = _path(spark, "gaf")
    T.read(spark, d, "lineitem").select(F.concat_ws("\t", *(fields[x].cast("string") for x in R.GAF)).alias("value")).write.text(path)
    spark.range(1).select(lit("!gaf-version: 2.2").alias("value")).write.mode("append").text(path)
    claims = N.annotations(R.gaf(spark, path), "SUPP:", "annotation")
    return claims.select("source_id", "target_id", "origin", "tier", "source_ref", "polarity", "retrieved_at")


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name, count(*) AS nations FROM supplier CROSS JOIN nation WHERE n_nationkey >= s_nationkey GROUP BY ALL")
def xml_records(spark, d):
    """Suppliers as nested XML elements with a list of nations, read by element."""
    s, n = T.read(spark, d, "supplier"), F.broadcast(T.read(spark, d, "nation"))  # 25 nations
    nested = s.join(n, F.col("n_nationkey") >= F.col("s_nationkey")).groupBy("s_suppkey", "s_name").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("name"))).alias("nation"))
    path = _path(spark, "xml")
    nested.select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.struct("nation").alias("nations")).write.format("xml").option("rowTag", "supplier").option("rootTag", "suppliers").save(path)
    df = R.xml(spark, path, "supplier", "_id string, name string, nations struct<nation:array<struct<_id:string,name:string>>>")
    return df.where("NOT bad").select(F.col("_id").alias("id"), "name", F.size("nations.nation").alias("nations").cast("long").alias("nations"))


@query("SELECT n_name AS name, r_name AS region, 'a' || n_nationkey || ',b' AS tags FROM nation JOIN region ON n_regionkey = r_regionkey")
def delimited_records(spark, d):
    """Nations as a tab-separated table with comments, a header after a hash, and a multi-valued field."""
    rows = T.read(spark, d, "nation").join(T.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = _path(spark, "tsv")
    rows.select(F.concat_ws("\t", "n_name", "r_name", F.concat(F.lit("a"), "n_nationkey", F.lit("| b |"))).alias("value")).write.text(path)
    spark.createDataFrame([("##made by hand",), ("#name\tregion\ttags",), ("",), ("-----",)], "value string").coalesce(1).write.mode("append").text(path)
    df = R.delimited(spark, path, ["name", "region", "tags"], comment="##", skip="^-+$", header=True)
    return df.where("NOT bad").select("name", "region", F.array_join(R.several(F.col("tags")), ",").alias("tags"))
