"""Registered queries of the checks of a finished graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..shared import staged
from ..sources import tables as T
from .catalog import SQL_EDGES, _edges, query

SQL_NAMES = ", nd AS (SELECT 'PART:' || p_partkey AS id, p_name AS label, p_brand || ' ' || p_size AS syn FROM part UNION ALL SELECT 'SUPP:' || s_suppkey, s_name, NULL FROM supplier), nmx AS (SELECT lower(id) AS name, 0 AS rank, id FROM nd UNION ALL SELECT lower(label), 1, id FROM nd UNION ALL SELECT lower(syn), 2, id FROM nd WHERE syn IS NOT NULL), names AS (SELECT name, min((rank, id))[2] AS id FROM nmx GROUP BY name)"


def _names(spark, d):
    part, supplier = T.read(spark, d, "part"), T.read(spark, d, "supplier")
    synonyms = part.select(F.concat(F.lit("PART:"), "p_partkey").alias("node_id"), F.concat_ws(" ", "p_brand", "p_size").alias("synonym"))
    return G.resolver(T.nodes(part, supplier).select("id", "label"), synonyms)


@query("WITH " + SQL_NAMES[2:] + " SELECT name, id FROM names")
def name_resolver(spark, d):
    return _names(spark, d)


@query(SQL_EDGES + SQL_NAMES + ", f AS (SELECT DISTINCT CASE WHEN l_partkey % 40 = 0 THEN 'nobody' ELSE 'part:' || l_partkey END AS a, 'caused_by_variant_in' AS relation, upper(s_name) AS b FROM lineitem JOIN supplier ON s_suppkey = CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_suppkey END WHERE l_partkey % 20 = 0) SELECT a, f.relation, b, CASE WHEN x.id IS NULL OR y.id IS NULL THEN 'unknown name' WHEN confidence IS NULL THEN 'missing' WHEN confidence < 0.6 THEN 'weak' ELSE 'ok' END AS status FROM f LEFT JOIN names x ON x.name = lower(a) LEFT JOIN names y ON y.name = lower(b) LEFT JOIN edges ON source_id = x.id AND target_id = y.id")
def golden_facts(spark, d):
    """Claims of parts whose id is divisible by 20 as facts; some of unknown names, some that no line bears out."""
    lines, s = T.read(spark, d, "lineitem").where("l_partkey % 20 = 0"), T.read(spark, d, "supplier")
    key = F.when(F.col("l_partkey") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("l_suppkey"))
    facts = lines.withColumn("k", key).join(s, F.col("k") == F.col("s_suppkey")).select(F.when(F.col("l_partkey") % 40 == 0, "nobody").otherwise(F.concat(F.lit("part:"), "l_partkey")).alias("a"), F.lit("caused_by_variant_in").alias("relation"), F.upper("s_name").alias("b"))
    return G.golden(facts, _names(spark, d), _edges(spark, d))


@query("WITH p AS (SELECT s_suppkey AS k, 'supp:' || s_suppkey AS a, CASE WHEN s_suppkey % 10 = 0 THEN 'nobody' ELSE 'SUPP:' || (s_suppkey + 1) END AS b FROM supplier), c AS (SELECT 'SUPP:' || s_suppkey AS node, s_nationkey % 5 AS cluster FROM supplier WHERE s_suppkey % 7 <> 0), j AS (SELECT a, b, k, x.cluster AS xc, y.cluster AS yc, b <> 'nobody' AND k + 1 <= (SELECT max(s_suppkey) FROM supplier) AS known FROM p LEFT JOIN c x ON x.node = upper(a) LEFT JOIN c y ON y.node = b) SELECT a, b, CASE WHEN NOT known THEN 'unknown name' WHEN xc IS NULL OR yc IS NULL THEN 'no cluster' WHEN xc = yc THEN 'same cluster' WHEN k % 3 <> 0 THEN 'not linked' ELSE 'ok' END AS status FROM j")
def counterexample_pairs(spark, d):
    """Neighbouring suppliers as pairs known to differ, nations modulo five as clusters."""
    s = T.read(spark, d, "supplier")
    name = lambda k: F.concat(F.lit("SUPP:"), k)
    key = F.col("s_suppkey")
    pairs = s.select(F.lower(name(key)).alias("a"), F.when(key % 10 == 0, "nobody").otherwise(name(key + 1)).alias("b"))
    clusters = s.where("s_suppkey % 7 <> 0").select(name(key).alias("node"), (F.col("s_nationkey") % 5).alias("cluster"))
    links = s.where("s_suppkey % 3 = 0").select(name(key + 1).alias("a"), name(key).alias("b"))
    return G.counterexamples(pairs, _names(spark, d), clusters, links)


@query("WITH l AS (SELECT l_partkey, bool_or(l_returnflag = 'R') AS symptoms, bool_or(l_linestatus = 'O') AS genes FROM lineitem GROUP BY 1) SELECT count(*) AS n, coalesce(sum(genes::INT), 0)::BIGINT AS genes, coalesce(sum(symptoms::INT), 0)::BIGINT AS symptoms, coalesce(sum((genes AND symptoms)::INT), 0)::BIGINT AS all_kinds FROM part LEFT JOIN l ON l_partkey = p_partkey")
def core_coverage(spark, d):
    """Parts with an open line (gene) and with a returned one (symptom)."""
    lines = T.read(spark, d, "lineitem")
    kind = F.explode(F.array_compact(F.array(F.when(F.col("l_linestatus") == "O", "acts_via"), F.when(F.col("l_returnflag") == "R", "has_phenotype"))))
    edges = lines.select(F.concat(F.lit("PART:"), "l_partkey").alias("source_id"), F.concat(F.lit("SUPP:"), "l_suppkey").alias("target_id"), kind.alias("relation"))
    core = T.read(spark, d, "part").select(F.concat(F.lit("PART:"), "p_partkey").alias("id"))
    return G.core_coverage(core, edges, {"genes": ["acts_via"], "symptoms": ["has_phenotype"]})


@query("WITH e AS (SELECT event_id AS id, event_id % 4 AS m, value / 100 AS confidence, event_id % 3 = 0 AS weak FROM events WHERE event_type <> 'view'), f AS (SELECT id, unnest([CASE WHEN m = 0 THEN 'no features' END, CASE WHEN m IN (0, 1) THEN 'no method or basis' END, CASE WHEN m = 0 THEN 'no explanation' END, CASE WHEN m = 2 THEN 'explanation too long' END, CASE WHEN m = 3 THEN 'explanation of several lines' END, CASE WHEN confidence > 0.79 THEN 'confidence over the cap' END, CASE WHEN weak AND confidence >= 0.6 THEN 'weak relation too confident' END]) AS fault FROM e) SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1")
def inferred_edge_faults(spark, d):
    """Events as inferred edges: their values as confidence, features broken in turn."""
    e = T.read(spark, d, "events")
    m = F.col("event_id") % 4
    features = F.when(m == 1, F.to_json(F.struct(F.lit("x").alias("explanation")))).when(m == 2, F.to_json(F.struct(F.lit("m").alias("method"), F.lit("b").alias("basis"), F.repeat(F.lit("y"), 401).alias("explanation")))).when(m == 3, F.to_json(F.struct(F.lit("m").alias("method"), F.lit("b").alias("basis"), F.lit("a\nb").alias("explanation"))))
    edges = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "near_on_chromosome").otherwise("shared_gene").alias("relation"), F.when(F.col("event_type") == "view", "observed").otherwise("inferred").alias("origin"), (F.col("value") / 100).alias("confidence"), features.alias("features"))
    return G.inferred_faults(staged(edges, "edges"), ["near_on_chromosome"]).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
