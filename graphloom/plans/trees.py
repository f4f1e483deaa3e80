"""Registered queries of the browsing tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree as R
from ..sources import tables as T
from .catalog import query

SQL_TREE = """WITH RECURSIVE l AS (SELECT 'C' || c_custkey AS id, c_name AS label, c_nationkey AS n, 'CUST' AS kind, c_mktsegment AS band FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, s_nationkey, 'SUPP', CASE WHEN s_acctbal < 0 THEN 'low' WHEN s_acctbal < 5000 THEN 'mid' ELSE 'high' END FROM supplier),
q AS (SELECT id, label, 'R' || n_regionkey AS g1, r_name AS b1, 'R' || n_regionkey || '/N' || n AS g2, n_name AS b2, kind, band FROM l JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (SELECT 'T' AS id, NULL AS parent, 'All' AS label, false AS leaf UNION ALL SELECT DISTINCT g1, 'T', b1, false FROM q UNION ALL SELECT DISTINCT g2, g1, b2, false FROM q UNION ALL SELECT DISTINCT g2 || '/' || kind, g2, kind, false FROM q UNION ALL SELECT DISTINCT g2 || '/' || kind || '/' || band, g2 || '/' || kind, band, false FROM q UNION ALL SELECT id, g2 || '/' || kind || '/' || band, label, true FROM q),
one AS (SELECT parent AS id FROM raw WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) = 1 AND count(*) FILTER (WHERE leaf) = 0), gone AS (SELECT id, parent FROM raw WHERE parent IS NOT NULL AND id IN (SELECT id FROM one)),
climb AS (SELECT id, parent AS above FROM raw UNION ALL SELECT c.id, g.parent FROM climb c JOIN gone g ON g.id = c.above), cut AS (SELECT r.id, c.above AS parent, label, leaf FROM raw r JOIN climb c USING (id) WHERE r.id NOT IN (SELECT id FROM gone) AND (c.above IS NULL OR c.above NOT IN (SELECT id FROM gone))),
pl AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY lower(label), id) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM cut WHERE leaf), wd AS (SELECT *, parent || '/r' || ((i // ceil(n / ceil(n / 30.0))::BIGINT) + 1)::BIGINT AS rng FROM pl WHERE n > 30),
hd AS (SELECT rng, parent, arg_min(label, i) AS a, arg_max(label, i) AS z FROM wd GROUP BY ALL), fin AS (SELECT id, coalesce(rng, cut.parent) AS parent, label, leaf FROM cut LEFT JOIN (SELECT id, rng FROM wd) USING (id) UNION ALL SELECT rng, parent, upper(a[1]) || lower(a[2]) || '–' || upper(z[1]) || lower(z[2]), false FROM hd),
up AS (SELECT id, id AS anc, 0 AS d FROM fin UNION ALL SELECT u.id, f.parent, d + 1 FROM up u JOIN fin f ON f.id = u.anc WHERE f.parent IS NOT NULL), dp AS (SELECT id, max(d)::INT AS depth FROM up GROUP BY 1), ct AS (SELECT anc AS id, count(*) FILTER (WHERE f.leaf) AS count FROM up JOIN fin f ON f.id = up.id GROUP BY 1)"""


def _tree(spark, d):
    """Customers and suppliers under region, nation, kind, and market segment or band of balance."""
    c, s = T.read(spark, d, "customer"), T.read(spark, d, "supplier")
    band = F.when(F.col("s_acctbal") < 0, "low").when(F.col("s_acctbal") < 5000, "mid").otherwise("high")
    leaves = c.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("n"), F.lit("CUST").alias("kind"), F.col("c_mktsegment").alias("band"))
    leaves = leaves.unionByName(s.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("n"), F.lit("SUPP").alias("kind"), band.alias("band")))
    g1 = F.concat(F.lit("R"), "n_regionkey")
    g2 = F.concat(g1, F.lit("/N"), "n")
    g3 = F.concat_ws("/", g2, "kind")
    g4 = F.concat_ws("/", g3, "band")
    q = leaves.join(T.read(spark, d, "nation"), F.col("n") == F.col("n_nationkey")).join(T.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda i, p, b, leaf=False: F.struct(i.alias("id"), p.alias("parent"), b.alias("label"), F.lit(leaf).alias("leaf"))
    top = row(F.lit("T"), F.lit(None).cast("string"), F.lit("All"))
    return q.select(F.explode(F.array(top, row(g1, F.lit("T"), F.col("r_name")), row(g2, g1, F.col("n_name")), row(g3, g2, F.col("kind")), row(g4, g3, F.col("band")), row(F.col("id"), g4, F.col("label"), True))).alias("r")).select("r.*").distinct()


@query(SQL_TREE + " SELECT id, parent, label, leaf, depth, count, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN id IN (SELECT parent FROM fin) THEN -count ELSE 1 END, lower(label), id) - 1 AS place FROM fin JOIN dp USING (id) JOIN ct USING (id)")
def tree_rows(spark, d):
    return R.build(_tree(spark, d))


@query(SQL_TREE + ", k AS (SELECT parent AS id, count(*) AS children FROM fin WHERE parent IS NOT NULL GROUP BY 1) SELECT depth, count(*) AS groups, max(children) AS widest, sum(children)::BIGINT AS children FROM k JOIN dp USING (id) GROUP BY 1")
def tree_fanout(spark, d):
    """Children of groups by depth, after splicing."""
    t = R.build(_tree(spark, d))
    k = t.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return t.join(k, "id").groupBy("depth").agg(F.count(F.lit(1)).alias("groups"), F.max("children").alias("widest"), F.sum("children").alias("children"))
