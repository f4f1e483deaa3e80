"""Registered queries of the engine on the driver's tables, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from ..operators import inference as I
from ..operators import merge as M
from ..operators import ontology as O
from ..operators import search as S
from ..shared import staged
from ..sources import tables as T
from ..streaming import events as E

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql is its independent form."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _assertions(spark, d):
    return T.assertions(T.read(spark, d, "lineitem"))


def _edges(spark, d):
    return M.edges(_assertions(spark, d))


SQL_ASSERTIONS = """a AS (SELECT 'PART:' || l_partkey AS source_id, 'SUPP:' || l_suppkey AS target_id, 'caused_by_variant_in' AS relation, CASE WHEN l_linestatus = 'O' THEN 'inferred' ELSE 'observed' END AS origin, CASE l_returnflag WHEN 'N' THEN 'curated_db' WHEN 'A' THEN 'review' ELSE 'peer_reviewed' END AS tier, l_linestatus AS source_type, l_orderkey || '-' || l_linenumber AS source_ref, l_returnflag <> 'R' AS sup, CASE WHEN l_linestatus = 'O' THEN l_discount * 10 END AS weight FROM lineitem)"""
SQL_EDGES = (
    "WITH "
    + SQL_ASSERTIONS
    + """, t AS (SELECT *, CASE tier WHEN 'curated_db' THEN 0.9::DOUBLE WHEN 'review' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS tw FROM a), e AS (SELECT source_id, relation, target_id, tier, source_type, source_ref, sup, max(CASE WHEN origin = 'inferred' THEN greatest(0, least(tw, weight)) ELSE tw END) AS w, min(CASE origin WHEN 'observed' THEN 1 ELSE 2 END) AS rk FROM t GROUP BY ALL), g AS (SELECT source_id, relation, target_id, round(greatest(0, least(1, 1 - coalesce(product(1 - w) FILTER (WHERE sup), 1) - 0.1::DOUBLE * count(*) FILTER (WHERE NOT sup))), 6) AS raw, min(rk) AS rk, count(*) AS n_evidence, count(*) FILTER (WHERE NOT sup) AS n_contradicting FROM e GROUP BY ALL), edges AS (SELECT 'e_' || substr(sha1(source_id || '|' || relation || '|' || target_id), 1, 12) AS id, source_id, relation, target_id, 'dna' AS family, CASE WHEN rk = 2 THEN least(raw, 0.79::DOUBLE) ELSE raw END AS confidence, CASE rk WHEN 1 THEN 'observed' ELSE 'inferred' END AS origin, 'active' AS status, n_evidence, n_contradicting FROM g)"""
)


@query(SQL_EDGES + " SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM edges")
def edge_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query("WITH " + SQL_ASSERTIONS + " SELECT 'e_' || substr(sha1(source_id || '|' || relation || '|' || target_id), 1, 12) AS edge_id, source_type, CASE WHEN sup THEN 'supports' ELSE 'contradicts' END AS polarity, count(*) AS n, string_agg(DISTINCT source_ref, ',' ORDER BY source_ref) AS refs FROM a GROUP BY ALL")
def evidence_breakdown(spark, d):
    return M.evidence_counts(_assertions(spark, d))


@query(SQL_EDGES + " SELECT family, relation, origin, count(*) AS n, min(confidence) AS low, max(confidence) AS high FROM edges GROUP BY ALL")
def edges_by_relation(spark, d):
    return _edges(spark, d).groupBy("family", "relation", "origin").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))


@query("WITH w AS (SELECT DISTINCT o_custkey AS person, o_orderkey AS work FROM orders), t AS (SELECT DISTINCT l_orderkey AS work, p_brand AS topic FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT person, count(DISTINCT work) AS n_works FROM w GROUP BY 1), y AS (SELECT person, count(DISTINCT topic) AS n_topics FROM w JOIN t USING (work) GROUP BY 1) SELECT person, n_works, coalesce(n_topics, 0) AS n_topics FROM x LEFT JOIN y USING (person) WHERE n_works >= 12 OR n_topics >= 25")
def prune_people(spark, d):
    work = T.read(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("work"))
    topics = T.read(spark, d, "lineitem").join(T.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("work"), F.col("p_brand").alias("topic")).distinct()
    return M.prune_people(work, topics, 12, 25)


@query("SELECT 'CUST:' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_nodes(spark, d):
    c, o = T.read(spark, d, "customer"), T.read(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.concat(F.lit("CUST:"), "c_custkey").alias("id"))


@query("SELECT user_id, 'k=' || max((props->>'k')::INT) AS features FROM events WHERE props->>'k' IS NOT NULL GROUP BY 1")
def feature_merge(spark, d):
    return M.max_features(T.read(spark, d, "events"), "user_id", "props")


@query("SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type <> '') AS event_type, arg_min(props, event_id) FILTER (WHERE props <> '') AS props FROM events GROUP BY 1")
def node_merge(spark, d):
    return M.first_non_empty(T.read(spark, d, "events"), "user_id", ["event_type", "props"], "event_id")


@query("SELECT l_partkey, max(l_discount * 10) AS best, count(DISTINCT l_orderkey || '-' || l_suppkey) AS k, round(1 - pow(1 - least(0.79::DOUBLE, max(l_discount * 10)), 1.0::DOUBLE / count(DISTINCT l_orderkey || '-' || l_suppkey)), 6) AS share FROM lineitem GROUP BY 1")
def finalize_scores(spark, d):
    return M.score_shares(T.read(spark, d, "lineitem").withColumn("score", F.col("l_discount") * 10), ["l_partkey"], ["l_orderkey", "l_suppkey"], "score")


@query("SELECT o_custkey, sum(('0x' || substr(md5(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority), 1, 8))::BIGINT)::BIGINT AS digest, count(*) AS n FROM orders GROUP BY 1")
def content_hash_rows(spark, d):
    return M.content_hash(T.read(spark, d, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'N') AS flagged, round(count(*) FILTER (WHERE l_returnflag <> 'N')::DOUBLE / count(*), 3) AS share FROM lineitem GROUP BY 1")
def conditional_counts(spark, d):
    flagged = F.count_if(F.col("l_returnflag") != "N")
    return T.read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), flagged.alias("flagged"), F.round(flagged / F.count(F.lit(1)), 3).alias("share"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, round(100.0::DOUBLE * avg((o_totalprice < 100000)::INT), 2) AS below FROM orders GROUP BY 1")
def quantiles(spark, d):
    o = T.read(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    q = M.exact_quantiles(o, "o_orderpriority", "o_totalprice", "o_orderkey", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    below = o.groupBy("o_orderpriority").agg(F.round(100 * F.avg((F.col("o_totalprice") < 100000).cast("int")), 2).alias("below"))
    return q.join(below, "o_orderpriority")


@query("WITH v AS (SELECT o_custkey, p_brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT o_custkey, p_brand, n FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_brand) = 1")
def majority_vote(spark, d):
    o = T.read(spark, d, "lineitem").join(T.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return M.majority(o, "o_custkey", "p_brand").select("o_custkey", "p_brand", "n")


@query("WITH b AS (SELECT DISTINCT s_nationkey, s_suppkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey), c AS (SELECT s_nationkey, p_brand, count(DISTINCT s_suppkey) AS cnt FROM b GROUP BY ALL), z AS (SELECT s_nationkey, count(DISTINCT s_suppkey) AS size FROM b GROUP BY 1), f AS (SELECT p_brand, count(*) AS df FROM c GROUP BY 1), s AS (SELECT s_nationkey, p_brand, round(cnt / size * ln(1 + (SELECT count(*) FROM z) / df), 9) AS score FROM c JOIN z USING (s_nationkey) JOIN f USING (p_brand)) SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, p_brand)::INT AS rank FROM s QUALIFY rank <= 3")
def distinctive_terms(spark, d):
    b = T.read(spark, d, "lineitem").join(T.read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(T.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return M.distinctive(b, "s_nationkey", "p_brand", "s_suppkey", 3)


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, round(sum(o_totalprice), 2) AS total, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years FROM orders GROUP BY 1")
def yearly_merge(spark, d):
    years = F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",")
    return T.read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.round(F.sum("o_totalprice"), 2).alias("total"), years.alias("years"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_returnflag, lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber)::INT AS rank FROM lineitem QUALIFY rank <= 25")
def variants_topn(spark, d):
    order = [F.desc("l_quantity"), F.desc("l_extendedprice"), F.asc("l_returnflag"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.asc("l_linenumber")]
    return M.top(T.read(spark, d, "lineitem"), ["l_suppkey"], order, 25).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("WITH o AS (SELECT *, o_orderdate >= TIMESTAMP '1997-01-01' AS newer FROM orders), x AS (SELECT c_nationkey, o_orderkey, o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY c_nationkey ORDER BY list_position(['F', 'O', 'P'], o_orderstatus), o_orderdate DESC NULLS LAST, o_orderkey)::INT AS rank FROM o JOIN customer ON o_custkey = c_custkey WHERE newer) SELECT c_nationkey, o_orderkey, o_orderstatus, rank FROM x WHERE rank <= 20")
def change_feed(spark, d):
    o = T.read(spark, d, "orders").where(F.col("o_orderdate") >= F.to_timestamp(F.lit("1997-01-01")))
    j = o.join(T.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    order = [F.array_position(F.array(*map(F.lit, "FOP")), F.col("o_orderstatus")), F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")]
    return M.top(j, ["c_nationkey"], order, 20).select("c_nationkey", "o_orderkey", "o_orderstatus", "rank")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_row(spark, d):
    return M.latest(T.read(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH v AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS version, max(o_orderdate) AS m FROM orders GROUP BY 1), k AS (SELECT version FROM v QUALIFY row_number() OVER (ORDER BY m DESC) <= 10) SELECT version::INT AS version, count(*) AS n FROM orders JOIN k ON year(o_orderdate) * 100 + month(o_orderdate) = version GROUP BY 1")
def kept_versions(spark, d):
    o = T.read(spark, d, "orders").withColumn("version", F.year("o_orderdate") * 100 + F.month("o_orderdate"))
    last = o.groupBy("version").agg(F.max("o_orderdate").alias("m")).orderBy(F.desc("m")).limit(10)
    return o.join(F.broadcast(last), "version").groupBy("version").agg(F.count(F.lit(1)).alias("n"))


SQL_ISA = "isa AS (SELECT 'PART:' || p_partkey AS child, unnest(['BRAND:' || p_brand, 'TYPE:' || p_type]) AS parent FROM part UNION ALL SELECT DISTINCT unnest(['BRAND:' || p_brand, 'TYPE:' || p_type]), 'ROOT' FROM part), cl AS (SELECT child AS term, parent AS ancestor FROM isa UNION SELECT c.term, i.parent FROM cl c JOIN isa i ON c.ancestor = i.child)"


@query("WITH RECURSIVE " + SQL_ISA + " SELECT DISTINCT term, ancestor FROM cl")
def term_closure(spark, d):
    return O.ancestors(T.is_a(T.read(spark, d, "part")))


@query("WITH RECURSIVE " + SQL_ISA + " SELECT ancestor AS term, least(count(DISTINCT term), 500) AS n FROM cl GROUP BY 1")
def descendant_counts(spark, d):
    return O.descendant_counts(O.ancestors(T.is_a(T.read(spark, d, "part"))), 500)


def _profiles(spark, d):
    p = staged(T.profiles(T.read(spark, d, "lineitem"), T.read(spark, d, "orders")), "profiles")
    closure = O.ancestors(T.is_a(T.read(spark, d, "part")))
    return p, closure, O.information_content(p, closure)


SQL_PROFILES = SQL_ISA + """, tc AS (SELECT DISTINCT child AS term, child AS up FROM isa UNION SELECT DISTINCT term, ancestor FROM cl), c AS (SELECT o_custkey AS profile, 'PART:' || l_partkey AS term, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), pr AS (SELECT profile, term, n / sum(n) OVER (PARTITION BY profile)::DOUBLE AS frequency FROM c), pu AS (SELECT DISTINCT profile, up AS term FROM pr JOIN tc USING (term)), ic AS (SELECT term, count(*) AS n, greatest(0::DOUBLE, -ln(count(*) / (SELECT count(DISTINCT profile) FROM pr)::DOUBLE)) AS ic FROM pu GROUP BY 1)"""


@query("WITH RECURSIVE " + SQL_PROFILES + " SELECT term, n, round(ic, 9) AS ic FROM ic")
def term_ic(spark, d):
    return _profiles(spark, d)[2].select("term", "n", F.round("ic", 9).alias("ic"))


@query("WITH RECURSIVE " + SQL_ISA + ", n AS (SELECT ancestor AS parent, count(DISTINCT term) AS n FROM cl GROUP BY 1), p AS (SELECT child, parent FROM isa JOIN n USING (parent) QUALIFY row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) = 1) SELECT a.child AS term, a.child || '>' || a.parent || CASE WHEN a.parent = 'ROOT' THEN '' ELSE '>ROOT' END AS lineage FROM p a")
def lineage(spark, d):
    isa = T.is_a(T.read(spark, d, "part"))
    return O.lineage(O.primary_parent(isa, O.ancestors(isa)), "ROOT")


SQL_COSINE = SQL_PROFILES + ", v AS (SELECT profile, term, ic FROM pu JOIN ic USING (term) WHERE ic >= 0.5), u AS (SELECT profile, term, ic / sqrt(sum(ic * ic) OVER (PARTITION BY profile)) AS x FROM v), cs AS (SELECT p.profile AS a, q.profile AS b, round(sum(p.x * q.x), 6) AS score FROM u p JOIN u q ON p.term = q.term AND p.profile < q.profile GROUP BY ALL), co AS (SELECT a AS own, b AS other, * FROM cs UNION ALL SELECT b, a, * FROM cs), ck AS (SELECT a, b, score FROM co QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, other) <= 25), cand AS (SELECT DISTINCT a, b, score AS cosine FROM ck)"
SQL_BMA = ", w AS (SELECT profile, term, greatest(0, least(1, frequency)) AS w, ic FROM pr JOIN ic USING (term) WHERE ic > 0 AND frequency > 0), both_ AS (SELECT a, b FROM cand UNION SELECT b, a FROM cand), mi AS (SELECT a, b, x.term, any_value(w) AS w, any_value(x.ic) AS ic, max(i2.ic) AS mica FROM both_ JOIN w x ON x.profile = a JOIN tc ON tc.term = x.term JOIN pu y ON y.profile = b AND y.term = tc.up JOIN ic i2 ON i2.term = tc.up GROUP BY a, b, x.term), num AS (SELECT a, b, sum(w * least(ic, mica)) AS num FROM mi GROUP BY ALL), den AS (SELECT profile AS a, sum(w * ic) AS den FROM w GROUP BY 1), si AS (SELECT a, b, CASE WHEN den > 0 THEN coalesce(num, 0) / den ELSE 0 END AS s FROM both_ LEFT JOIN num USING (a, b) LEFT JOIN den USING (a)), bma AS (SELECT c.a, c.b, round(greatest(0, least(1, (x.s + y.s) / 2)), 6) AS similarity FROM (SELECT DISTINCT a, b FROM cand) c JOIN si x ON x.a = c.a AND x.b = c.b JOIN si y ON y.a = c.b AND y.b = c.a)"


@query("WITH RECURSIVE " + SQL_COSINE + " SELECT a, b, cosine FROM cand")
def cosine_topk(spark, d):
    p, closure, ic = _profiles(spark, d)
    return O.cosine_top(p, ic, closure, 25, 0.5)


def _candidates(spark, d):
    p, closure, ic = _profiles(spark, d)
    ic = staged(ic, "ic")
    return p, closure, ic, staged(O.cosine_top(p, ic, closure, 25, 0.5).select("a", "b"), "candidates")


@query("WITH RECURSIVE " + SQL_COSINE + SQL_BMA + " SELECT * FROM bma")
def bma_similarity(spark, d):
    p, closure, ic, pairs = _candidates(spark, d)
    return O.similarity(p, ic, closure, pairs, True).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("WITH RECURSIVE " + SQL_COSINE + SQL_BMA + ", sp AS (SELECT profile, term FROM pr JOIN ic USING (term) WHERE ic >= 2), sh AS (SELECT a, b, count(*) AS shared FROM bma JOIN sp x ON x.profile = a JOIN sp y ON y.profile = b AND y.term = x.term GROUP BY ALL), ab AS (SELECT * FROM bma JOIN sh USING (a, b) WHERE similarity >= 0.1 AND shared >= 2), o2 AS (SELECT a AS own, b AS other, * FROM ab UNION ALL SELECT b, a, * FROM ab), kp AS (SELECT DISTINCT a, b, similarity, shared FROM (SELECT * FROM o2 QUALIFY row_number() OVER (PARTITION BY own ORDER BY similarity DESC, other DESC) <= 8)) SELECT *, round(least(0.30::DOUBLE + 0.55::DOUBLE * similarity, 0.75::DOUBLE), 8) AS score, round(0.9::DOUBLE * similarity, 8) AS cluster_score FROM kp")
def similar_symptoms(spark, d):
    p, closure, ic, pairs = _candidates(spark, d)
    return O.similar(p, ic, closure, pairs, 0.1)


@query("WITH RECURSIVE " + SQL_PROFILES + ", pl AS (SELECT profile, md5(profile::VARCHAR) AS h FROM pr GROUP BY 1 HAVING count(*) >= 3 ORDER BY h LIMIT 1000), rk AS (SELECT profile, (row_number() OVER (ORDER BY h) - 1) // 2 AS g FROM pl), cand AS (SELECT min(profile) AS a, max(profile) AS b FROM rk GROUP BY g HAVING a < b)" + SQL_BMA + " SELECT count(*) AS n, round(quantile_cont(similarity, 0.5), 4) AS median, round(quantile_cont(similarity, 0.95), 4) AS p95, round(quantile_cont(similarity, 0.99), 4) AS p99, greatest(0.45::DOUBLE, round(quantile_cont(similarity, 0.95), 4)) AS threshold FROM bma")
def similarity_calibration(spark, d):
    p, closure, ic = _profiles(spark, d)
    return O.calibration(p, staged(ic, "ic"), closure, 500, 0.45)


def _symptom_queries(spark, d):
    """Every customer whose id is divisible by 20 asks: parts and types it bought, and brands it says it has not."""
    lines = T.read(spark, d, "lineitem").join(T.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    part, number = F.concat(F.lit("PART:"), "l_partkey"), F.col("l_linenumber")
    term = F.when(number == 1, part).when(number == 2, F.concat(F.lit("TYPE:"), "p_type")).when(number == 3, F.concat(F.lit("PART:"), ((F.col("l_partkey") * 7) % 50 + 1)))
    q = lines.where("o_custkey % 20 = 0 and l_linenumber <= 3").select(F.col("o_custkey").alias("query"), term.alias("term"), (number < 3).alias("present"))
    return q, lines.where("l_linenumber = 7").select(F.col("o_custkey").alias("profile"), part.alias("term"))


@query(
    "WITH RECURSIVE "
    + SQL_PROFILES
    + ", ln AS (SELECT o_custkey AS c, l_linenumber AS k, l_partkey AS p, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), q AS (SELECT DISTINCT c AS query, CASE k WHEN 1 THEN 'PART:' || p WHEN 2 THEN 'TYPE:' || p_type ELSE 'PART:' || ((p * 7) % 50 + 1) END AS term, k < 3 AS present FROM ln WHERE c % 20 = 0 AND k <= 3), ex AS (SELECT DISTINCT c AS profile, 'PART:' || p AS term FROM ln WHERE k = 7), w AS (SELECT profile, term, greatest(0, least(1, frequency)) AS w, ic FROM pr JOIN ic USING (term) WHERE ic > 0 AND frequency > 0), qi AS (SELECT query, q.term, ic FROM q JOIN ic USING (term) WHERE present), mt AS (SELECT query, profile, qi.term, pr.term AS own, pr.term = qi.term AS same, false AS broader FROM qi JOIN tc ON tc.up = qi.term JOIN pr ON pr.term = tc.term UNION ALL SELECT query, profile, qi.term, pr.term, false, true FROM qi JOIN tc ON tc.term = qi.term AND tc.up <> tc.term JOIN ic ON ic.term = tc.up AND ic.ic >= 2 JOIN pr ON pr.term = tc.up), sh AS (SELECT query, profile, count(*) AS n_shared, count(*) FILTER (WHERE same) AS n_same, count(*) FILTER (WHERE broader) AS n_broader FROM mt GROUP BY ALL), qu AS (SELECT DISTINCT query, tc.up AS term FROM qi JOIN tc USING (term) WHERE qi.ic > 0), m1 AS (SELECT sh.query, sh.profile, qi.term, any_value(qi.ic) AS ic, max(i.ic) AS mica FROM sh JOIN qi ON qi.query = sh.query AND qi.ic > 0 JOIN tc ON tc.term = qi.term JOIN ic i ON i.term = tc.up JOIN (SELECT DISTINCT w.profile, tc.up FROM w JOIN tc USING (term)) y ON y.profile = sh.profile AND y.up = tc.up GROUP BY ALL), d1 AS (SELECT query, sum(ic) AS den FROM qi WHERE ic > 0 GROUP BY 1), s1 AS (SELECT query, profile, sum(least(ic, mica)) / any_value(den) AS s FROM m1 JOIN d1 USING (query) GROUP BY ALL), m2 AS (SELECT sh.query, sh.profile, w.term, any_value(w.w) AS w, any_value(w.ic) AS ic, max(i.ic) AS mica FROM sh JOIN w ON w.profile = sh.profile JOIN tc ON tc.term = w.term JOIN ic i ON i.term = tc.up JOIN qu ON qu.query = sh.query AND qu.term = tc.up GROUP BY ALL), d2 AS (SELECT profile, sum(w * ic) AS den FROM w GROUP BY 1), s2 AS (SELECT query, profile, sum(w * least(ic, mica)) / any_value(den) AS s FROM m2 JOIN d2 USING (profile) GROUP BY ALL), hd AS (SELECT profile, up AS term, max(greatest(0, least(1, frequency))) AS w FROM pr JOIN tc USING (term) GROUP BY ALL), ag AS (SELECT query, profile, ic * w AS x FROM q JOIN ic USING (term) JOIN hd USING (term) WHERE NOT present UNION ALL SELECT query, profile, ic FROM (SELECT DISTINCT query, ex.profile, qi.term, qi.ic FROM qi JOIN tc ON tc.term = qi.term JOIN ex ON ex.term = tc.up)), lo AS (SELECT query, profile, sum(x) AS against FROM ag GROUP BY ALL), tt AS (SELECT query, sum(ic) AS total FROM q JOIN ic USING (term) GROUP BY 1), sc AS (SELECT sh.*, round(greatest(0, least(1, (coalesce(s1.s, 0) + coalesce(s2.s, 0)) / 2)) * (1 - least(1, CASE WHEN total > 0 THEN coalesce(against, 0) / total ELSE 0 END)), 6) AS score FROM sh LEFT JOIN s1 USING (query, profile) LEFT JOIN s2 USING (query, profile) LEFT JOIN lo USING (query, profile) JOIN tt USING (query)) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, profile)::INT AS rank FROM sc QUALIFY rank <= 10"
)
def symptom_ranking(spark, d):
    p, closure, ic = _profiles(spark, d)
    q, excluded = _symptom_queries(spark, d)
    return O.rank_profiles(q, p, excluded, staged(ic, "ic"), closure, 10)


SQL_MECH = "m AS (SELECT l_suppkey AS gene, l_partkey AS disease, count(*) AS n, round(count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE / count(*), 3) AS share FROM lineitem GROUP BY ALL), mt AS (SELECT gene, disease, n, share, CASE WHEN share >= 0.4 THEN 'loss_of_function' WHEN n >= 2 AND share <= 0.05 THEN 'non_lof' END AS mechanism, round(0.45::DOUBLE + 0.4::DOUBLE * least(1, log10(n + 1) / 2), 6) AS weight FROM m WHERE n >= 2)"


def _mechanisms(spark, d):
    claims = T.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("disease"), (F.col("l_returnflag") == "A").alias("truncating"))
    return I.mechanisms(claims, least=2, non_lof_n=2)


@query("WITH " + SQL_MECH + " SELECT * FROM mt WHERE mechanism IS NOT NULL")
def mechanism_table(spark, d):
    return _mechanisms(spark, d)


@query("WITH " + SQL_MECH + ", k AS (SELECT * FROM mt WHERE mechanism IS NOT NULL QUALIFY count(*) OVER (PARTITION BY gene) BETWEEN 2 AND 60) SELECT x.disease AS a, y.disease AS b, gene, x.mechanism = y.mechanism AS same, least(x.weight, y.weight) AS weight FROM k x JOIN k y USING (gene) WHERE x.disease < y.disease")
def same_gene_links(spark, d):
    return I.same_gene(_mechanisms(spark, d), 60)


SQL_GENES = "ge AS (SELECT l_partkey AS disease, l_orderkey AS gene, round(max(0.5::DOUBLE + l_discount * 4), 6) AS confidence FROM lineitem GROUP BY ALL)"


def _genes(spark, d):
    """Parts as diseases and orders as genes: a gene has as many diseases as an order has parts."""
    return T.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("disease"), F.col("l_orderkey").alias("gene")).agg(F.round(F.max(0.5 + F.col("l_discount") * 4), 6).alias("confidence"))


@query("WITH " + SQL_GENES + ", rt AS (SELECT DISTINCT l_orderkey AS gene, l_partkey AS disease FROM lineitem WHERE l_returnflag = 'R'), cv AS (SELECT DISTINCT x.disease AS a, y.disease AS b FROM rt x JOIN rt y USING (gene) WHERE x.disease < y.disease), k AS (SELECT * FROM ge QUALIFY count(*) OVER (PARTITION BY gene) BETWEEN 2 AND 25) SELECT x.disease AS a, y.disease AS b, gene, round(0.85::DOUBLE * least(x.confidence, y.confidence), 6) AS score FROM k x JOIN k y USING (gene) ANTI JOIN cv ON cv.a = x.disease AND cv.b = y.disease WHERE x.disease < y.disease QUALIFY row_number() OVER (PARTITION BY x.disease, y.disease ORDER BY score DESC, gene) = 1")
def shared_gene(spark, d):
    """Pairs that returned orders already link are covered by another relation."""
    returned = T.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("gene"), F.col("l_partkey").alias("disease"))
    return I.shared_gene(_genes(spark, d), I.pairs_in_group(returned, "gene", "disease", 25).select("a", "b").distinct(), 25)


@query("WITH mem AS (SELECT o_custkey AS pathway, o_orderkey AS gene FROM orders), ps AS (SELECT DISTINCT l_partkey * 100000 + l_suppkey AS disease, l_orderkey AS gene FROM lineitem), f AS (SELECT * FROM ps QUALIFY count(*) OVER (PARTITION BY disease) <= 8), z AS (SELECT *, count(*) OVER (PARTITION BY pathway) AS n FROM mem), o AS (SELECT DISTINCT disease, pathway, n FROM z JOIN f USING (gene) WHERE n <= 60), sm AS (SELECT DISTINCT i.disease AS a, j.disease AS b FROM f i JOIN f j USING (gene) WHERE i.disease < j.disease), p AS (SELECT x.disease AS a, y.disease AS b, pathway, 0.72::DOUBLE / (1 + log10(x.n)) AS w FROM o x JOIN o y USING (pathway) ANTI JOIN sm ON sm.a = x.disease AND sm.b = y.disease WHERE x.disease < y.disease), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY w DESC, pathway) AS r FROM p), g AS (SELECT a, b, count(*) AS n, round(1 - product(CASE WHEN r <= 5 THEN 1 - w ELSE 1 END), 6) AS rank_score, round(1 - product(CASE WHEN r <= 3 THEN 1 - w ELSE 1 END), 6) AS score FROM r GROUP BY ALL) SELECT * FROM g")
def shared_pathway(spark, d):
    """Customers as pathways of their orders; a part from one supplier is a disease; every pair is returned."""
    members = T.read(spark, d, "orders").select(F.col("o_custkey").alias("pathway"), F.col("o_orderkey").alias("gene"))
    return I.shared_pathway(members, T.read(spark, d, "lineitem").select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("disease"), F.col("l_orderkey").alias("gene")), 60)


SQL_IV = "iv AS (SELECT p_brand AS chromosome, p_partkey AS id, (floor(p_retailprice * 100))::BIGINT AS s, (floor(p_retailprice * 100))::BIGINT + p_size AS e FROM part), nr AS (SELECT x.id, y.id AS other, greatest(0, y.s - x.e, x.s - y.e) AS gap FROM iv x JOIN iv y USING (chromosome) WHERE x.id <> y.id AND greatest(0, y.s - x.e, x.s - y.e) <= 2000), nk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, other)::INT AS rank FROM nr QUALIFY rank <= 3)"


def _intervals(spark, d):
    start = F.floor(F.col("p_retailprice") * 100)
    return T.read(spark, d, "part").select(F.col("p_brand").alias("chromosome"), F.col("p_partkey").alias("id"), start.alias("start"), (start + F.col("p_size")).alias("end"))


@query("WITH " + SQL_IV + " SELECT id, other, gap, rank FROM nk")
def nearest_k(spark, d):
    return I.nearest(_intervals(spark, d), 2000, 3)


def _wide(spark, d):
    i = _intervals(spark, d)
    return i.select("chromosome", "id", F.greatest(F.lit(0), F.col("start") - 1500).alias("start"), (F.col("end") + 1500).alias("end"))


SQL_OV = SQL_IV + ", wd AS (SELECT chromosome, id, greatest(0, s - 1500) AS s, e + 1500 AS e FROM iv), ov AS (SELECT i.id AS a, w.id AS b, least(i.e, w.e) - greatest(i.s, w.s) + 1 AS bases FROM iv i JOIN wd w USING (chromosome) WHERE least(i.e, w.e) - greatest(i.s, w.s) + 1 > 0)"


@query("WITH " + SQL_OV + " SELECT * FROM ov")
def interval_overlaps(spark, d):
    return I.overlaps(_intervals(spark, d), _wide(spark, d), 5000)


@query("WITH " + SQL_OV + ", p AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, gap FROM nk), n AS (SELECT p.a, p.b, count(DISTINCT x.b) AS n FROM p JOIN ov x ON x.a = p.a JOIN ov y ON y.a = p.b AND y.b = x.b GROUP BY ALL) SELECT p.a, p.b, gap, coalesce(n, 0) AS n, CASE WHEN n >= 2 THEN 0.45::DOUBLE ELSE 0.2::DOUBLE END AS score FROM p LEFT JOIN n USING (a, b)")
def near_links(spark, d):
    i = _intervals(spark, d)
    return I.near_links(I.nearest(i, 2000, 3), i, _wide(spark, d))


@query("WITH w AS (SELECT DISTINCT l_orderkey AS person, l_suppkey AS topic FROM lineitem), k AS (SELECT * FROM w QUALIFY count(*) OVER (PARTITION BY person) BETWEEN 2 AND 15), s AS (SELECT x.topic AS a, y.topic AS b, count(DISTINCT person) AS score FROM k x JOIN k y USING (person) WHERE x.topic < y.topic GROUP BY ALL), o AS (SELECT a AS own, b AS other, * FROM s UNION ALL SELECT b, a, * FROM s), t AS (SELECT a, b, score FROM o QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, other DESC) <= 6) SELECT DISTINCT a, b, score AS n, 0.4::DOUBLE AS score FROM t")
def shared_worker(spark, d):
    w = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("person"), F.col("l_suppkey").alias("topic"))
    return I.shared_workers(w, 15, 6)


@query("WITH l AS (SELECT l_partkey AS a, l_suppkey AS b, CASE l_returnflag WHEN 'A' THEN 'same' WHEN 'N' THEN 'unknown' ELSE 'different' END AS relation, max(l_tax * 10) AS score FROM lineitem GROUP BY ALL) SELECT a, b, round(CASE WHEN max(score) FILTER (WHERE relation = 'different') IS NULL THEN sum(CASE relation WHEN 'same' THEN 1.0::DOUBLE WHEN 'unknown' THEN 0.5::DOUBLE ELSE 0 END * score) ELSE 0 END, 6) AS positive, round(coalesce(2 * max(score) FILTER (WHERE relation = 'different'), 0), 6) AS negative FROM l GROUP BY ALL")
def cluster_layers(spark, d):
    r = F.col("l_returnflag")
    links = T.read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(r == "A", "same").when(r == "N", "unknown").otherwise("different").alias("relation"), (F.col("l_tax") * 10).alias("score"))
    return I.layer_weights(links, {"same": 1.0, "unknown": 0.5}, "different")


SQL_INC = SQL_EDGES + ", inc AS (SELECT source_id AS node, target_id AS other, id AS edge_id, relation, confidence FROM edges UNION ALL SELECT target_id, source_id, id, relation, confidence FROM edges)"


@query(SQL_INC + ", dg AS (SELECT node, count(*) AS degree FROM inc GROUP BY 1) SELECT node, degree, degree >= greatest(10, (SELECT degree FROM dg QUALIFY row_number() OVER (ORDER BY degree) = (SELECT least(floor(count(*) * 0.95), count(*) - 1) + 1 FROM dg))) AS hub FROM dg")
def degree_hubs(spark, d):
    deg = G.degrees(_edges(spark, d))
    return deg.join(F.broadcast(G.hub_threshold(deg))).select("node", "degree", (F.col("degree") >= F.col("threshold")).alias("hub"))


@query(SQL_INC + ", o AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY node, other ORDER BY confidence DESC, edge_id) = 1) SELECT node, other, edge_id, confidence, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, edge_id)::INT AS rank FROM o QUALIFY rank <= 20")
def neighbor_cap(spark, d):
    return G.neighbours(_edges(spark, d), 20)


#: Every part whose id is divisible by 20 asks.
SQL_START = SQL_INC + ", st0 AS (SELECT 'PART:' || p_partkey AS node FROM part WHERE p_partkey % 20 = 0), h1 AS (SELECT DISTINCT other AS node FROM inc WHERE node IN (SELECT node FROM st0) AND other NOT IN (SELECT node FROM st0)), h2 AS (SELECT DISTINCT other AS node FROM inc WHERE node IN (SELECT node FROM h1) AND other NOT IN (SELECT node FROM st0) AND other NOT IN (SELECT node FROM h1))"


def _start(spark, d):
    return T.read(spark, d, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("PART:"), "p_partkey").alias("node"))


@query(SQL_START + " SELECT node, 0 AS hop FROM st0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def reach(spark, d):
    return G.reached(_edges(spark, d), _start(spark, d), 2)


@query(SQL_START + ", n AS (SELECT node FROM st0 UNION SELECT node FROM h1) SELECT id, source_id, target_id, confidence FROM edges WHERE source_id IN (SELECT node FROM n) AND target_id IN (SELECT node FROM n)")
def subgraph_d1(spark, d):
    return G.subgraph(_edges(spark, d), _start(spark, d), 1).select("id", "source_id", "target_id", "confidence")


@query(SQL_START + ", n AS (SELECT node FROM st0 UNION SELECT node FROM h1 UNION SELECT node FROM h2) SELECT id, source_id, target_id, confidence FROM edges WHERE source_id IN (SELECT node FROM n) AND target_id IN (SELECT node FROM n)")
def subgraph_d2(spark, d):
    return G.subgraph(_edges(spark, d), _start(spark, d), 2).select("id", "source_id", "target_id", "confidence")


@query(SQL_START + ", w AS (SELECT x.node AS source, y.other AS e, least(x.confidence, y.confidence) AS least_ FROM inc x JOIN inc y ON y.node = x.other WHERE x.node IN (SELECT node FROM st0) AND y.other LIKE 'PART:%' AND y.other <> x.node), s AS (SELECT source, e, count(*) AS n_walks, max(least_) AS best FROM w GROUP BY ALL) SELECT source, e AS \"end\", n_walks, best, row_number() OVER (PARTITION BY source ORDER BY n_walks DESC, best DESC, e)::INT AS rank FROM s QUALIFY rank <= 10")
def chain_summary(spark, d):
    r = "caused_by_variant_in"
    return G.chain_ends(_edges(spark, d), [(r, "SUPP:"), (r, "PART:")], _start(spark, d), 10)


SQL_RANK = SQL_INC + ", pw AS (SELECT node, other, greatest(max(confidence), 0.05::DOUBLE) AS w FROM inc GROUP BY ALL), st AS (SELECT node, other, w / sum(w) OVER (PARTITION BY node) AS p FROM pw), nn AS (SELECT count(DISTINCT node) AS n FROM pw), r0 AS MATERIALIZED (SELECT DISTINCT node, 1.0::DOUBLE / (SELECT n FROM nn) AS r FROM pw)" + "".join(f", r{i} AS MATERIALIZED (SELECT other AS node, 0.15::DOUBLE / (SELECT n FROM nn) + 0.85::DOUBLE * sum(r * p) AS r FROM st JOIN r{i - 1} USING (node) GROUP BY 1)" for i in range(1, 21))


@query(SQL_RANK + " SELECT node, round(r / (SELECT max(r) FROM r20), 6) AS rank FROM r20")
def pagerank(spark, d):
    return G.pagerank(_edges(spark, d), 20)


@query(SQL_INC + ", l0 AS (SELECT DISTINCT node, node AS label FROM inc)" + "".join(f", l{i} AS MATERIALIZED (SELECT inc.node, label, round(sum(confidence), 6) AS w FROM inc JOIN l{i - 1} l ON l.node = inc.other GROUP BY inc.node, label QUALIFY row_number() OVER (PARTITION BY inc.node ORDER BY round(sum(confidence), 6) DESC, label) = 1)" for i in range(1, 4)) + " SELECT node, label FROM l3")
def label_propagation(spark, d):
    return G.label_propagation(_edges(spark, d), 3)


@query("SELECT 'SUPP:' || s_suppkey AS id, round(sqrt(('0x' || substr(sha1('SUPP:' || s_suppkey), 5, 4))::INT / 65536.0::DOUBLE) * cos(('0x' || substr(sha1('SUPP:' || s_suppkey), 1, 4))::INT / 65536.0::DOUBLE * 2 * pi()), 6) AS x, round(sqrt(('0x' || substr(sha1('SUPP:' || s_suppkey), 5, 4))::INT / 65536.0::DOUBLE) * sin(('0x' || substr(sha1('SUPP:' || s_suppkey), 1, 4))::INT / 65536.0::DOUBLE * 2 * pi()), 6) AS y FROM supplier")
def hash_placement(spark, d):
    return G.hash_placement(T.read(spark, d, "supplier").select(F.concat(F.lit("SUPP:"), "s_suppkey").alias("id")))


@query("WITH k AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, floor(i / ceil(n / ceil(n / 30)))::INT AS chunk FROM k")
def tree_chunks(spark, d):
    return G.even_chunks(T.read(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey")


SQL_FOLD = "trim(regexp_replace(lower(translate({0}, '" + C.ACCENTED + "', '" + C.PLAIN + "')), '[^a-z0-9]+', ' ', 'g'))"
SQL_TRI = "list_distinct(list_transform(range(1, length('  ' || {0} || ' ') - 1), lambda i: substr('  ' || {0} || ' ', i, 3)))"


def _index(spark, d):
    p, s = T.read(spark, d, "part"), T.read(spark, d, "supplier")
    names = p.select(F.concat(F.lit("PART:"), "p_partkey").alias("id"), F.col("p_name").alias("text"), F.lit("name").alias("kind"))
    return names.unionByName(s.select(F.concat(F.lit("SUPP:"), "s_suppkey").alias("id"), F.col("s_name").alias("text"), F.lit("name").alias("kind"))).unionByName(p.select(F.concat(F.lit("PART:"), "p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("text"), F.lit("synonym").alias("kind")))


def _queries(spark, d):
    """Every part whose id is divisible by 20 asks: its name, a supplier's id and a longer question around each name."""
    p = T.read(spark, d, "part").where("p_partkey % 20 = 0")
    return p.select(F.explode(F.array("p_name", F.concat(F.lit("supp:"), "p_partkey"), F.concat(F.lit("what of "), "p_name", F.lit(" today")))).alias("query")).distinct()


SQL_SEARCH = "ix AS (SELECT 'PART:' || p_partkey AS id, p_name AS text, 2.5::DOUBLE AS s FROM part UNION ALL SELECT 'SUPP:' || s_suppkey, s_name, 2.5::DOUBLE FROM supplier UNION ALL SELECT 'PART:' || p_partkey, p_brand || ' ' || p_type, 2.2::DOUBLE FROM part), q AS (SELECT DISTINCT unnest([p_name, 'supp:' || p_partkey, 'what of ' || p_name || ' today']) AS query FROM part WHERE p_partkey % 20 = 0), fx AS (SELECT id, s, " + SQL_FOLD.format("text") + " AS f FROM ix), fq AS (SELECT query, " + SQL_FOLD.format("query") + " AS f FROM q), ex AS (SELECT query, id, max(sc) AS score FROM (SELECT query, id, 3.0::DOUBLE AS sc FROM q JOIN ix ON lower(query) = lower(id) UNION ALL SELECT query, id, s FROM fq JOIN fx USING (f)) GROUP BY ALL)"
SQL_PHRASE = SQL_SEARCH + ", w AS (SELECT query, string_split(f, ' ') AS w FROM fq), g AS (SELECT query, len(w) AS n, k, array_to_string(w[i:i + k - 1], ' ') AS f FROM w, range(1, 7) a(k), range(1, 60) b(i) WHERE k <= len(w) - 1 AND i + k - 1 <= len(w)), ph AS (SELECT query, id, round(max(1.2::DOUBLE + 0.5::DOUBLE * k / n), 6) AS score FROM g JOIN fx USING (f) WHERE length(f) >= 4 GROUP BY ALL)"


@query("WITH " + SQL_SEARCH + " SELECT * FROM ex")
def exact_search(spark, d):
    return S.exact(_index(spark, d), _queries(spark, d))


@query("WITH " + SQL_PHRASE + " SELECT * FROM ph")
def phrase_search(spark, d):
    return S.phrases(_index(spark, d), _queries(spark, d))


SQL_TRIG = SQL_PHRASE + ", ti AS (SELECT DISTINCT id, f, " + SQL_TRI.format("f") + " AS t FROM fx), tq AS (SELECT query, " + SQL_TRI.format("f") + " AS t FROM fq), j AS (SELECT query, id, max(round(len(list_intersect(tq.t, ti.t))::DOUBLE / (len(tq.t) + len(ti.t) - len(list_intersect(tq.t, ti.t))), 6)) AS score FROM tq, ti GROUP BY ALL), tg AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM j WHERE score >= 0.3 QUALIFY rank <= 10)"


@query("WITH " + SQL_TRIG + " SELECT * FROM tg")
def trigram_search(spark, d):
    return S.fuzzy(_index(spark, d), _queries(spark, d), 0.3, 10)


@query("WITH " + SQL_TRIG + ", al AS (SELECT 0 AS p, query, id, score FROM ex UNION ALL SELECT 1, query, id, score FROM ph UNION ALL SELECT 2, query, id, score FROM tg), b AS (SELECT query, id, max(score) AS base, count(DISTINCT p) AS kinds FROM al GROUP BY ALL) SELECT query, id, round(base + CASE WHEN id LIKE 'PART:%' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN kinds > 1 THEN 0.1::DOUBLE ELSE 0 END, 6) AS score FROM b")
def hybrid_search(spark, d):
    i, q = _index(spark, d), _queries(spark, d)
    boosts = T.read(spark, d, "part").select(F.concat(F.lit("PART:"), "p_partkey").alias("id"), F.lit(0.15).alias("boost"))
    return S.fused([S.exact(i, q), S.phrases(i, q), S.fuzzy(i, q, 0.3, 10)], boosts)


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0) SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.v, v.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, v.v), 6) DESC, v.vec_id)::INT AS rank FROM q, v QUALIFY rank <= 10")
def vector_topk(spark, d):
    e = T.read(spark, d, "embeddings")
    return S.vector_top(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 10)


@query("SELECT conv_id, turn, " + SQL_FOLD.format("coalesce(text, '')") + " AS folded, substr(sha1(conv_id || '|' || turn), 1, 8) AS h FROM conversations")
def folded_text(spark, d):
    c = T.read(spark, d, "conversations")
    return c.select("conv_id", "turn", C.fold(F.coalesce("text", F.lit(""))).alias("folded"), C.short_hash(8, F.col("conv_id"), F.col("turn")).alias("h"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n_mail, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+?[0-9][0-9 ()/-]{7,}[0-9]', '[phone]', 'g')) AS clean FROM documents")
def redact_counts(spark, d):
    t = F.col("text")
    return T.read(spark, d, "documents").select("doc_id", F.regexp_count(t, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).cast("long").alias("n_mail"), F.md5(C.scrub_contacts(t)).alias("clean"))


@query("SELECT l_suppkey, round(avg(CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 40)::DOUBLE / nullif(l_suppkey % 3, 0) ELSE (l_partkey % 100) / 100.0::DOUBLE END), 6) AS frequency FROM lineitem GROUP BY 1")
def parsed_frequencies(spark, d):
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws("/", F.col("l_partkey") % 40, F.col("l_suppkey") % 3)).otherwise(F.concat((F.col("l_partkey") % 100).cast("string"), F.lit("%")))
    return T.read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(C.parsed_frequency(text)), 6).alias("frequency"))


@query("SELECT 'edges_without_supplier' AS name, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'duplicate_orders', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'discount_out_of_range', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 1 UNION ALL SELECT 'unknown_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P') UNION ALL SELECT 'parts_without_supplier', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def dq_report(spark, d):
    from ..operators.validate import domain, dangling, report, repeated

    l, o, s, p = (T.read(spark, d, t) for t in ("lineitem", "orders", "supplier", "part"))
    return report(
        {
            "edges_without_supplier": dangling(l, "l_suppkey", s, "s_suppkey"),
            "lines_without_order": dangling(l, "l_orderkey", o, "o_orderkey"),
            "duplicate_orders": repeated(o, "o_orderkey"),
            "discount_out_of_range": l.where(~F.col("l_discount").between(0, 1)),
            "unknown_status": domain(o, "o_orderstatus", ["F", "O", "P"]),
            "parts_without_supplier": dangling(p, "p_partkey", l, "l_partkey"),
        }
    )


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_metrics(spark, d):
    return E.tumbling(T.read(spark, d, "events"))


@query("WITH s AS (SELECT unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS]) AS start FROM events) SELECT start, count(*) AS n FROM s GROUP BY 1")
def sliding_counts(spark, d):
    return E.sliding(T.read(spark, d, "events"), "12 hours", "6 hours")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, d):
    return E.sessions(T.read(spark, d, "events"), "2 hours")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window, in_window > 2 AS refused FROM events")
def rate_limit_windows(spark, d):
    return E.rate_limited(T.read(spark, d, "events"), 3600, 2).select("event_id", "user_id", "in_window", "refused")


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS GROUP BY ALL")
def retention(spark, d):
    e = T.read(spark, d, "events")
    last = e.agg(F.max("ts").alias("now"))  # one row
    return e.join(F.broadcast(last)).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 10 DAYS")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, (props->>'k')::INT AS k, min(event_id) AS event_id FROM events GROUP BY ALL")
def notifications(spark, d):
    e = T.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"))


@query("SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderdate > TIMESTAMP '1997-06-01') AS unread, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def unread_counts(spark, d):
    o = T.read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") > F.to_timestamp(F.lit("1997-06-01"))).alias("u"), F.max("o_orderdate").alias("last"))
    c = T.read(spark, d, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("u", F.lit(0)).alias("unread"), "last")


@query("SELECT p_partkey AS id, 'both' AS side FROM part WHERE p_size <= 20 AND p_retailprice > 1200 UNION ALL SELECT p_partkey, 'left' FROM part WHERE p_size <= 20 AND NOT p_retailprice > 1200 UNION ALL SELECT p_partkey, 'right' FROM part WHERE p_retailprice > 1200 AND NOT p_size <= 20")
def set_ops(spark, d):
    p = T.read(spark, d, "part")
    a, b = p.where("p_size <= 20").select(F.col("p_partkey").alias("id")), p.where("p_retailprice > 1200").select(F.col("p_partkey").alias("id"))
    side = lambda x, n: x.withColumn("side", F.lit(n))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "left")).unionByName(side(b.subtract(a), "right"))


from . import clusters, eligibility, files, gates, growth, lexical, more, people, privacy, routes, snapshots, trees  # noqa: E402, F401  register the queries of those modules too
