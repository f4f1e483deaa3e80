"""Registered queries of snapshots and version differences; each writes its versions to the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import versions as V
from ..shared import shared_dir, staged
from ..sinks import contract as W
from ..sources import tables as T
from .catalog import SQL_ASSERTIONS, _assertions, query


def _root(spark) -> str:
    return f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"


def _publish(spark, root, version, tables, checks):
    W.validate(tables, checks, root)
    W.publish(tables, root, version)


@query("WITH " + SQL_ASSERTIONS + ", n AS (SELECT 'PART:' || p_partkey AS id, 'disease' AS type, p_name AS label FROM part UNION ALL SELECT 'SUPP:' || s_suppkey, 'gene', s_name FROM supplier) SELECT 'assertions' AS \"table\", count(*) AS rows, count(DISTINCT source_id) AS keys FROM (SELECT DISTINCT source_id, target_id, relation, origin, tier, source_type, source_ref, sup FROM a) UNION ALL SELECT 'nodes', count(DISTINCT id), count(DISTINCT id) FROM n")
def published_tables(spark, d):
    nodes = staged(W.coerced(T.nodes(T.read(spark, d, "part"), T.read(spark, d, "supplier")), "nodes"), "nodes")
    claims = staged(W.coerced(_assertions(spark, d), "assertions"), "assertions")
    tables, root = {"nodes": nodes, "assertions": claims}, _root(spark)
    ends = claims.select(F.explode(F.array("source_id", "target_id")).alias("id")).join(nodes, "id", "left_anti")
    _publish(spark, root, "v1", tables, {"ends exist": ends})
    back = W.load(spark, root)
    rows = lambda name, key: back[name].agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"))
    return rows("assertions", "source_id").unionByName(rows("nodes", "id"))


SQL_VERSIONS = "v1 AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 3), v2 AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 4)"


def _versions(spark, d):
    """Two published versions of the orders: some gone, some added, some with another status or without priority."""
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    new = o.where("k % 10 <> 4").withColumns({"status": F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("status")), "priority": F.when(F.col("k") % 11 != 0, F.col("priority"))})
    root = _root(spark)
    for version, df in (("v1", o.where("k % 10 <> 3")), ("v2", new)):
        tables = {"orders": staged(df, "orders")}
        _publish(spark, root, version, tables, {"unique": tables["orders"].groupBy("k").count().where("count > 1")})
    return W.load(spark, root, "v1")["orders"], W.load(spark, root)["orders"]


@query("WITH " + SQL_VERSIONS + " SELECT k, CASE WHEN v1.price IS NULL THEN 'added' WHEN v2.price IS NULL THEN 'gone' ELSE 'changed' END AS change, CASE WHEN v1.price IS NULL OR v2.price IS NULL THEN '' ELSE concat_ws(',', CASE WHEN v1.status <> v2.status THEN 'status' END, CASE WHEN v1.priority IS DISTINCT FROM v2.priority THEN 'priority' END) END AS fields FROM v1 FULL JOIN v2 USING (k) WHERE v1.status IS DISTINCT FROM v2.status OR v1.priority IS DISTINCT FROM v2.priority OR v1.price IS DISTINCT FROM v2.price")
def version_changes(spark, d):
    old, new = _versions(spark, d)
    return V.changes(old, new, "k", ["status", "priority", "price"]).select("k", "change", F.array_join("fields", ",").alias("fields"))


@query("WITH " + SQL_VERSIONS + " SELECT l_orderkey AS k, status, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM v2 JOIN lineitem ON l_orderkey = k GROUP BY ALL")
def refreshed_totals(spark, d):
    """Totals of the first version, of which only keys with another status, new or gone are computed again."""
    old, new = _versions(spark, d)
    lines = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice")
    total = lambda df: df.groupBy("k", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    first = staged(total(lines.join(old, "k")), "totals")
    touched = V.changes(old, new, "k", ["status"])
    return V.refreshed(first, lines.join(new, "k"), touched, "k", total)
