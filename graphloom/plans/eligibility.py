"""Registered queries of what a graph takes in: links of sources, qualification, genes, pathways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eligible as L
from ..operators import ontology as O
from ..sources import tables as T
from .catalog import query

SQL_ROWS = """s AS (SELECT l_linenumber % 4 AS m, l_partkey AS p, l_suppkey AS g, l_returnflag AS flag, l_linestatus AS status FROM lineitem),
rw AS (SELECT CASE m WHEN 0 THEN 'ontology' WHEN 1 THEN 'validity' WHEN 2 THEN 'registry' ELSE 'phenotypes' END AS source, p AS pk, CASE m WHEN 2 THEN p_size >= 10 WHEN 3 THEN p_size < 40 ELSE true END AS mapped, g, m < 2 OR (m = 3 AND g % 2 = 0) AS direct, s_acctbal >= 0 AS approved, CASE m WHEN 0 THEN flag WHEN 1 THEN 'v' || status WHEN 2 THEN 'ORPHA:' || p ELSE 'OMIM:' || p END AS ref, CASE WHEN m <> 1 OR flag = 'N' THEN 'supports' WHEN flag = 'R' THEN 'contradicts' END AS polarity FROM s JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = g)"""


def _links(spark, d):
    """Lines as rows of four sources by their number; the last two know parts by references, genes by id or name."""
    part, supplier = T.read(spark, d, "part"), T.read(spark, d, "supplier")
    m = F.col("l_linenumber") % 4
    lines = T.read(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    by_number = lambda *v: F.when(m == 0, v[0]).when(m == 1, v[1]).when(m == 2, v[2]).otherwise(v[3])
    own, orpha, omim = (F.concat(F.lit(p), "l_partkey") for p in ("PART:", "ORPHA:", "OMIM:"))
    direct = (m < 2) | ((m == 3) & (F.col("l_suppkey") % 2 == 0))
    rows = lines.select(
        by_number("ontology", "validity", "registry", "phenotypes").alias("source"),
        by_number(own, own, orpha, omim).alias("raw"),
        F.when(direct, F.col("l_suppkey")).alias("gene"),
        F.when(~direct, F.col("s_name")).alias("symbol"),
        by_number(F.col("l_returnflag"), F.concat(F.lit("v"), "l_linestatus"), orpha, omim).alias("ref"),
        F.when((m != 1) | (F.col("l_returnflag") == "N"), "supports").when(F.col("l_returnflag") == "R", "contradicts").alias("polarity"),
        F.lit(None).cast("string").alias("detail"),
    )
    key = F.col("p_partkey")
    refs = F.array_compact(F.array(F.concat(F.lit("PART:"), key), F.when(F.col("p_size") >= 10, F.concat(F.lit("ORPHA:"), key)), F.when(F.col("p_size") < 40, F.concat(F.lit("OMIM:"), key))))
    ids = part.select(F.explode(refs).alias("raw"), key.alias("id"))
    genes = supplier.where("s_acctbal >= 0").select(F.col("s_name").alias("symbol"), F.col("s_suppkey").alias("gene"))
    return L.resolved(rows, ids, genes)


@query("WITH " + SQL_ROWS + " SELECT DISTINCT pk AS id, g AS gene, source, ref, min(polarity) AS polarity FROM rw WHERE mapped AND (direct OR approved) AND polarity IS NOT NULL GROUP BY ALL")
def gene_disease_links(spark, d):
    return L.links(_links(spark, d)).drop("detail")


@query("WITH " + SQL_ROWS + " SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE NOT (mapped AND (direct OR approved))) AS n_unmapped FROM rw WHERE polarity IS NOT NULL GROUP BY 1")
def unlinked_rows(spark, d):
    return L.unlinked(_links(spark, d))


@query("WITH v AS (SELECT l_suppkey AS gene, unnest(list_distinct([l_partkey, l_partkey // 2])) AS id, l_orderkey || '-' || l_linenumber AS variant FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT DISTINCT * FROM v WHERE id IN (SELECT p_partkey FROM part WHERE p_size >= 10)) SELECT id, gene, count(*) AS n, array_to_string(list_sort(list(variant))[1:5], ',') AS firsts FROM r GROUP BY id, gene HAVING count(*) >= 2")
def variant_backed_links(spark, d):
    """Returned lines as variants of their supplier, seen in their part and in the part of half its number."""
    lines = T.read(spark, d, "lineitem").where("l_returnflag = 'R'")
    variants = lines.select(F.col("l_suppkey").alias("gene"), F.array(F.col("l_partkey"), F.expr("l_partkey div 2")).alias("ids"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("variant"))
    within = T.read(spark, d, "part").where("p_size >= 10").select(F.col("p_partkey").alias("id"))
    return L.variant_links(variants, within).withColumn("firsts", F.array_join("firsts", ","))


SQL_BELOW = """RECURSIVE up AS (SELECT p_partkey AS id, p_partkey // 7 AS anc FROM part WHERE p_partkey > 0 UNION ALL SELECT id, anc // 7 FROM up WHERE anc > 0), bl AS (SELECT anc AS id, count(*) AS n FROM up GROUP BY 1)"""
SQL_VERDICTS = (
    "WITH "
    + SQL_BELOW
    + """, sg AS (SELECT l_partkey AS id, l_suppkey AS gene, CASE WHEN l_linenumber % 4 = 2 THEN 'ORPHA:' ELSE 'OMIM:' END AS k FROM lineitem WHERE l_linenumber % 4 IN (2, 3) AND l_quantity > 40), ap AS (SELECT s_suppkey AS gene FROM supplier WHERE s_acctbal >= 2000), ks AS (SELECT id, k FROM sg UNION ALL SELECT p_partkey, 'OTHER:' FROM part WHERE p_partkey % 3 = 0),
kd AS (SELECT id, bool_or(k = 'ORPHA:') AS orpha, bool_or(k = 'OMIM:') AS omim FROM ks GROUP BY 1), gn AS (SELECT id, count(DISTINCT gene) AS n FROM sg JOIN ap USING (gene) GROUP BY 1), phr AS (SELECT DISTINCT l_partkey AS id, l_suppkey % 50 AS term FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30), phn AS (SELECT id, count(*) AS n FROM phr GROUP BY 1),
vd AS (SELECT p_partkey AS id, CASE WHEN omim AND orpha THEN 'omim_and_orpha' WHEN omim THEN 'omim_only' ELSE 'orpha_only' END AS kind, coalesce(gn.n, 0) AS n_genes, coalesce(phn.n, 0) AS n_phenotypes, CASE WHEN gn.n IS NULL THEN 'no approved gene' WHEN phn.n IS NULL THEN 'no phenotype' WHEN p_name LIKE '%hot%' THEN 'label is no disease' WHEN bl.n > 30 THEN 'too many descendants' WHEN NOT (orpha OR p_partkey % 5 = 0) AND p_name LIKE '%bolt%' THEN 'label needs a registry' WHEN NOT (p_size > 45 OR orpha OR p_partkey % 5 = 0 OR omim) THEN 'not rare' END AS reason FROM part JOIN kd ON kd.id = p_partkey LEFT JOIN gn ON gn.id = p_partkey LEFT JOIN phn ON phn.id = p_partkey LEFT JOIN bl ON bl.id = p_partkey WHERE p_partkey % 11 <> 0)"""
)


def _terms(spark, d):
    """Parts as terms, each under the part of a seventh of its number; every eleventh is withdrawn."""
    key = F.col("p_partkey")
    return T.read(spark, d, "part").select(key.alias("id"), F.col("p_name").alias("label"), (F.col("p_size") > 45).alias("rare"), F.when(key % 5 == 0, F.array(F.concat(F.lit("ORPHA:"), key))).alias("matches"), (key % 11 == 0).alias("deprecated"))


def _below(spark, d):
    p = T.read(spark, d, "part").where("p_partkey > 0")
    return O.descendant_counts(O.ancestors(p.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 7").alias("parent"))), 1 << 30)


def _inputs(spark, d):
    lines = T.read(spark, d, "lineitem")
    key = F.concat(F.when(F.col("l_linenumber") % 4 == 2, "ORPHA:").otherwise("OMIM:"), "l_partkey")
    source_genes = lines.where("l_linenumber % 4 IN (2, 3) AND l_quantity > 40").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("gene"), key.alias("key"))
    source_keys = T.read(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("OTHER:"), "p_partkey").alias("key"))
    phenotypes = lines.where("l_returnflag = 'R' AND l_quantity > 30").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 50).alias("term"))
    approved = T.read(spark, d, "supplier").where("s_acctbal >= 2000").select(F.col("s_suppkey").alias("gene"))
    return source_genes, source_keys, phenotypes, approved


def _verdicts(spark, d):
    source_genes, source_keys, phenotypes, approved = _inputs(spark, d)
    return L.qualify(_terms(spark, d), _below(spark, d), source_genes, source_keys, phenotypes, approved, 30, ("hot",), ("bolt",))


@query(SQL_VERDICTS + " SELECT * FROM vd")
def qualified_terms(spark, d):
    return _verdicts(spark, d)


@query(
    SQL_VERDICTS
    + """, kp AS (SELECT id FROM vd WHERE reason IS NULL), pg AS (SELECT gene, count(DISTINCT id) AS n FROM sg JOIN ap USING (gene) JOIN kp USING (id) GROUP BY 1)
SELECT 'in' AS section, kind AS name, count(*) AS n, NULL AS firsts FROM vd WHERE reason IS NULL GROUP BY ALL UNION ALL SELECT 'out', reason, count(*), array_to_string(list_sort(list(id::VARCHAR))[1:5], ',') FROM vd WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT 'total', 'genes', count(*), NULL FROM pg UNION ALL SELECT 'total', 'most ids of a gene', coalesce(max(n), 0), NULL FROM pg UNION ALL SELECT 'total', 'phenotypes', count(DISTINCT term), NULL FROM phr JOIN kp USING (id) UNION ALL SELECT 'total', 'links of withdrawn genes', count(*), NULL FROM sg WHERE gene NOT IN (SELECT gene FROM ap)"""
)
def qualification_summary(spark, d):
    source_genes, _, phenotypes, approved = _inputs(spark, d)
    return L.qualified_report(_verdicts(spark, d), source_genes, phenotypes, approved).withColumn("firsts", F.array_join("firsts", ","))


@query("WITH " + SQL_BELOW + " SELECT p_partkey AS id, p_partkey % 100 = 0 AS seed FROM part LEFT JOIN bl ON id = p_partkey WHERE p_partkey % 11 <> 0 AND (p_partkey % 100 = 0 OR (coalesce(n, 0) <= 30 AND (p_size > 45 OR p_partkey % 5 = 0)))")
def eligible_terms(spark, d):
    seeds = T.read(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"))
    return L.eligible(_terms(spark, d), _below(spark, d), seeds)


SQL_CHOSEN = """pr AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS gene FROM lineitem WHERE l_quantity > 40 AND l_partkey % 2 = 0), fw AS (SELECT id FROM pr GROUP BY 1 HAVING count(*) <= 8), ct AS (SELECT gene, count(*) AS n FROM pr JOIN fw USING (id) GROUP BY 1), sd AS (SELECT s_suppkey AS gene FROM supplier WHERE s_suppkey % 50 = 0), ch AS (SELECT gene, true AS seed, coalesce(n, 0) AS n FROM sd LEFT JOIN ct USING (gene) UNION ALL SELECT * FROM (SELECT gene, false, n FROM ct WHERE gene NOT IN (SELECT gene FROM sd) ORDER BY n DESC, gene LIMIT greatest(0, 60 - (SELECT count(*) FROM sd))))"""


def _chosen(spark, d):
    """Parts of even number as ids; lines of more than 40 pieces as links; suppliers divisible by 50 as seeds."""
    pairs = T.read(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("gene"))
    ids = T.read(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"))
    seeds = T.read(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("gene"))
    return L.select_genes(ids, seeds, pairs, 8, 60)


@query("WITH " + SQL_CHOSEN + " SELECT * FROM ch")
def selected_genes(spark, d):
    return _chosen(spark, d)


SQL_FOCUS = "ad AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 20 = 0), al AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS gene FROM lineitem WHERE l_quantity > 40), ql AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS gene FROM lineitem WHERE l_quantity >= 50), fo AS (SELECT gene FROM ql JOIN ad USING (id) UNION SELECT gene FROM al WHERE id IN (SELECT id FROM ad) AND id NOT IN (SELECT id FROM ql) AND id IN (SELECT id FROM al GROUP BY 1 HAVING count(*) <= 8))"


def _focus(spark, d):
    lines = T.read(spark, d, "lineitem")
    pairs = lambda least: lines.where(least).select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("gene"))
    added = T.read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"))
    return L.focus_genes(added, pairs("l_quantity >= 50"), pairs("l_quantity > 40"))


@query("WITH " + SQL_FOCUS + " SELECT gene FROM fo")
def focus_list_genes(spark, d):
    return _focus(spark, d)


@query("WITH " + SQL_CHOSEN + ", fo AS (SELECT gene FROM ch WHERE seed), mb AS (SELECT DISTINCT l_partkey AS pathway, l_suppkey AS gene FROM lineitem WHERE l_quantity > 30), sz AS (SELECT pathway, count(*) AS n_genes, count(*) FILTER (WHERE gene IN (SELECT gene FROM ch)) AS n_in FROM mb GROUP BY 1), kp AS (SELECT pathway, gene, n_genes, gene IN (SELECT gene FROM fo) AS f FROM mb JOIN sz USING (pathway) WHERE gene IN (SELECT gene FROM ch) AND ((gene IN (SELECT gene FROM fo) AND n_genes <= 12) OR (n_genes <= 10 AND n_in >= 2))) SELECT pathway, gene, n_genes, CASE WHEN bool_or(f) OVER (PARTITION BY pathway) THEN 'focus' ELSE 'core' END AS tier FROM kp")
def scoped_memberships(spark, d):
    """Parts as pathways of the suppliers of their lines; selected genes as scope, their seeds as focus."""
    members = T.read(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("pathway"), F.col("l_suppkey").alias("gene"))
    chosen = _chosen(spark, d)
    return L.scoped_pathways(members, chosen, chosen.where("seed"), 12, 10)
