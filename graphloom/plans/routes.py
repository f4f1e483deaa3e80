"""Registered queries of trusted paths and their coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import merge as M
from ..operators import paths as P
from ..shared import staged
from ..sources import tables as T
from .catalog import SQL_ASSERTIONS, SQL_EDGES, _assertions, query

SQL_PAIRS = ", asks AS (SELECT 'PART:' || p_partkey AS source, 'SUPP:' || ((p_partkey // 20) % (SELECT count(*) FROM supplier) + 1) AS target FROM part WHERE p_partkey % 20 = 0)"
SQL_STEPS = (
    SQL_EDGES
    + SQL_PAIRS
    + """, inc AS (SELECT source_id AS node, id FROM edges UNION ALL SELECT target_id, id FROM edges), dg AS (SELECT node, count(*) AS degree FROM inc WHERE node LIKE 'PART:%' GROUP BY 1), th AS (SELECT greatest(10, degree) AS threshold FROM dg QUALIFY row_number() OVER (ORDER BY degree) = (SELECT least(floor(count(*) * 0.95), count(*) - 1) + 1 FROM dg)), gen AS (SELECT node, 0.4::DOUBLE * ln(greatest(degree, 1)) AS pen, degree >= threshold AS closed FROM dg, th),
su AS (SELECT *, origin = 'observed' AS obs FROM edges WHERE status = 'active' AND confidence >= 0.6)"""
)
#: The graph has two kinds of nodes, so paths of at most three edges have one or three.
SQL_PATHS = (
    SQL_STEPS
    + """, p AS (SELECT source, target, [source, target] AS ns, [id] AS es, -ln(confidence) AS total, 0.0::DOUBLE AS pen, confidence AS least_, obs FROM asks JOIN su ON su.source_id = source AND su.target_id = target
UNION ALL SELECT a.source, a.target, [a.source, x.target_id, y.source_id, a.target], [x.id, y.id, z.id], -ln(x.confidence) - ln(y.confidence) - ln(z.confidence), g.pen, least(x.confidence, y.confidence, z.confidence), x.obs AND y.obs AND z.obs
FROM asks a JOIN su z ON z.target_id = a.target AND z.source_id <> a.source JOIN su x ON x.source_id = a.source AND x.target_id <> a.target JOIN su y ON y.source_id = z.source_id AND y.target_id = x.target_id JOIN gen g ON g.node = y.source_id AND NOT g.closed),
rk AS (SELECT source, target, row_number() OVER (PARTITION BY source, target ORDER BY round(total + pen, 9), array_to_string(ns, '>'))::INT AS rank, round(total + pen, 9) AS weight, round(total, 6) AS total_cost, least_ AS min_confidence, obs AS all_observed, len(es)::INT AS hops, array_to_string(ns, '>') AS nodes, 'p_' || substr(sha1(array_to_string(es, '>')), 1, 16) AS path_id FROM p QUALIFY rank <= 3)"""
)


def _asks(spark, d):
    """Every part whose id is divisible by 20 asks for one supplier."""
    n = T.read(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    part = T.read(spark, d, "part").where("p_partkey % 20 = 0").join(F.broadcast(n))
    return part.select(F.concat(F.lit("PART:"), "p_partkey").alias("source"), F.concat(F.lit("SUPP:"), F.expr("(p_partkey div 20) % n + 1")).alias("target"))


def _paths(spark, d):
    edges = staged(M.edges(_assertions(spark, d)), "edges")
    parts = staged(G.degrees(edges).where(F.col("node").startswith("PART:")), "degrees")
    return edges, P.k_cheapest(edges, _asks(spark, d), 3, 3, parts, G.hub_threshold(parts))


@query(SQL_PATHS + " SELECT * FROM rk")
def k_paths(spark, d):
    return _paths(spark, d)[1]


@query(
    SQL_PATHS.replace("WITH ", "WITH " + SQL_ASSERTIONS.replace("a AS (", "ev0 AS (", 1) + ", ", 1)
    + ", ev AS (SELECT 'e_' || substr(sha1(source_id || '|' || relation || '|' || target_id), 1, 12) AS edge_id, source_type, count(*) AS n FROM ev0 GROUP BY ALL), seen AS (SELECT DISTINCT asks.source, asks.target, i.id FROM asks JOIN inc i ON i.node = asks.source OR i.node = asks.target), ct AS (SELECT source, target, source_type, sum(n) AS n FROM seen JOIN ev ON ev.edge_id = seen.id GROUP BY ALL) SELECT source, target, CASE WHEN (source, target) IN (SELECT (source, target) FROM rk) THEN 'ok' ELSE 'no_supported_route' END AS status, source_type, coalesce(n, 0)::BIGINT AS n FROM asks CROSS JOIN (SELECT DISTINCT source_type FROM ev) LEFT JOIN ct USING (source, target, source_type)"
)
def path_coverage(spark, d):
    edges, found = _paths(spark, d)
    evidence = M.evidence_counts(_assertions(spark, d)).groupBy("edge_id", "source_type").agg(F.sum("n").alias("n"))
    return P.coverage(_asks(spark, d), found, edges, evidence)
