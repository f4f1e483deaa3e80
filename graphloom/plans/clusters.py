"""Registered queries of signed clustering, lineages and names of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as L
from ..operators import inference as I
from ..operators import lineages as N
from ..operators import merge as M
from ..shared import staged
from ..sources import tables as T
from .catalog import SQL_PROFILES, _mechanisms, _profiles, query


def _signed_links(spark, d):
    """Parts that share a supplier pull by agreeing (1.0) or unknown (0.5) mechanisms and push by differing ones."""
    same = I.same_gene(_mechanisms(spark, d), None)  # suppliers of any number of parts
    kind = F.when(F.col("same"), "same").when(~F.col("same"), "different").otherwise("unknown")
    links = same.select("a", "b", kind.alias("relation"), F.col("weight").alias("score"))
    return I.layer_weights(links, {"same": 1.0, "unknown": 0.5}, "different")


@query()
def leiden_clusters(spark, d):
    """Checked against plain rules in tests/test_clusters.py; SQL has no such rounds."""
    return L.signed_clusters(_signed_links(spark, d), T.read(spark, d, "part").select(F.col("p_partkey").alias("node")))


SQL_LINEAGE = (
    "WITH RECURSIVE "
    + SQL_PROFILES
    + """, mb AS (SELECT c_nationkey AS cluster, c_custkey AS id FROM customer), an AS (SELECT mb.cluster, pr.profile AS id, pr.term FROM pr JOIN mb ON mb.id = pr.profile), vt AS (SELECT an.cluster, tc.up AS system, count(DISTINCT an.id) AS n FROM an JOIN tc ON tc.term = an.term WHERE tc.up IN (SELECT child FROM isa WHERE parent = 'ROOT') GROUP BY ALL), sy AS (SELECT cluster, system FROM vt QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, system) = 1),
dc AS (SELECT cluster, term, count(DISTINCT id) AS cnt FROM an GROUP BY ALL), dz AS (SELECT cluster, count(DISTINCT id) AS size FROM an GROUP BY 1), df AS (SELECT term, count(*) AS df FROM dc GROUP BY 1), rk AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(cnt / size * ln(1 + (SELECT count(*) FROM dz) / df), 9) DESC, term) AS rank FROM dc JOIN dz USING (cluster) JOIN df USING (term)),
ah AS (SELECT rk.cluster, system, rk.term AS anchor FROM rk JOIN sy USING (cluster) JOIN ic ON ic.term = rk.term AND ic.ic >= 2 JOIN cl ON cl.term = rk.term AND cl.ancestor = sy.system WHERE rk.rank <= 50 QUALIFY row_number() OVER (PARTITION BY rk.cluster ORDER BY rk.rank) = 1),
ln AS (SELECT cluster, CASE WHEN anchor IS NULL THEN system ELSE system || '>' || anchor END AS lineage FROM sy LEFT JOIN ah USING (cluster, system))"""
)


def _lineages(spark, d):
    """Nations as clusters of their customers, which are annotated with the parts they bought."""
    p, closure, ic = _profiles(spark, d)
    p = p.select(F.col("profile").alias("id"), "term")
    members = T.read(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("id"))
    ranked = M.distinctive(p.join(members, "id"), "cluster", "term", "id", 50).select("cluster", "term", "rank")
    return members, N.lineages(members, p, ranked, ic, T.is_a(T.read(spark, d, "part")), closure, "ROOT")


@query(SQL_LINEAGE + " SELECT m.cluster, coalesce(lineage, '') AS lineage FROM (SELECT DISTINCT cluster FROM mb) m LEFT JOIN ln USING (cluster)")
def cluster_lineage(spark, d):
    return _lineages(spark, d)[1].select("cluster", F.array_join("lineage", ">").alias("lineage"))


@query(SQL_LINEAGE + ", st AS (SELECT DISTINCT '' AS a, split_part(lineage, '>', 1) AS b FROM ln UNION SELECT split_part(lineage, '>', 1), split_part(lineage, '>', 2) FROM ln WHERE lineage LIKE '%>%') SELECT a AS term, count(DISTINCT b) AS children FROM st GROUP BY 1")
def lineage_fanout(spark, d):
    """Children of each term in the lineages, for the rule on roots."""
    return N.fan_out(_lineages(spark, d)[1])


@query("WITH c AS (SELECT s_nationkey AS cluster, count(*) AS n, min(s_name) AS own, CASE WHEN s_nationkey % 3 = 0 THEN 'Term' END AS term, CASE WHEN s_nationkey % 2 = 0 THEN 'gene' || (s_nationkey % 4) END AS gene FROM supplier GROUP BY s_nationkey), a AS (SELECT *, CASE WHEN n = 1 THEN own WHEN term IS NULL AND gene IS NULL THEN n || ' related conditions' WHEN term IS NULL THEN gene || ' disorders' ELSE concat_ws(' · ', term, gene) END AS name FROM c), b AS (SELECT cluster, CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 AND term IS NOT NULL THEN name || ' · ' || term ELSE name END AS name FROM a) SELECT cluster, CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN name || ' (cluster ' || cluster || ')' ELSE name END AS name FROM b")
def cluster_labels(spark, d):
    """Nations of suppliers, some with a term, some with a gene, named apart."""
    k = F.col("s_nationkey")
    c = T.read(spark, d, "supplier").groupBy(k.alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.min("s_name").alias("own"))
    k = F.col("cluster")
    return N.cluster_names(c.withColumns({"term": F.when(k % 3 == 0, "Term"), "gene": F.when(k % 2 == 0, F.concat(F.lit("gene"), k % 4))}))
