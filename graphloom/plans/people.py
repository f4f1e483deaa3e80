"""Registered queries of people, follow-up questions, expert clusters and ids in queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import people as H
from ..sources import tables as T
from .catalog import query


@query(
    """WITH p AS (SELECT c_custkey AS id, 'n' || c_nationkey || ' ' || lower(c_mktsegment) AS k FROM customer), pl AS (SELECT DISTINCT o_custkey AS id, strftime(o_orderdate, '%Y-%m') AS place FROM orders WHERE o_orderpriority LIKE '1%'), a AS (SELECT id AS ask, k, CASE WHEN id % 40 = 0 THEN id + 1 END AS other FROM p WHERE id % 20 = 0),
m AS (SELECT ask, id, 0 AS kind FROM a JOIN p ON id = other UNION ALL SELECT ask, p.id, 1 FROM a JOIN p USING (k) JOIN pl x ON x.id = p.id JOIN pl y ON y.id = ask AND y.place = x.place UNION ALL SELECT ask, id, 2 FROM a JOIN p USING (k)), b AS (SELECT ask, id, min(kind) AS kind FROM m GROUP BY ALL)
SELECT ask, id, CASE kind WHEN 0 THEN 'orcid' WHEN 1 THEN 'name_and_place' ELSE 'name' END AS matched_by, row_number() OVER (PARTITION BY ask ORDER BY kind, id)::INT AS rank FROM b QUALIFY rank <= 5"""
)
def matched_people(spark, d):
    """Customers whose id is divisible by 20 as drafts, all as entries; months of urgent orders as places."""
    c, o = T.read(spark, d, "customer"), T.read(spark, d, "orders")
    key, _ = P.person_key(F.col("c_mktsegment"), F.concat(F.lit("N"), "c_nationkey"))
    registered = lambda k: F.concat(F.lit("R"), k)
    people = c.select(F.col("c_custkey").alias("id"), registered(F.col("c_custkey")).alias("orcid"), key.alias("name_key"))
    asks = c.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("ask"), F.when(F.col("c_custkey") % 40 == 0, registered(F.col("c_custkey") + 1)).alias("orcid"), key.alias("name_key"))
    places = o.where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("place"))
    return H.match_people(asks, places.select(F.col("id").alias("ask"), "place"), people, places)


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 45), s AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_quantity <= 2), mk AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_partkey % 50 = 0)
SELECT DISTINCT 'CUST:' || o_custkey AS person, 'PART:' || p AS id FROM orders JOIN e ON o = o_orderkey UNION SELECT 'CUST:' || o_custkey, 'PART:' || p FROM orders JOIN s ON o = o_orderkey JOIN mk USING (s) UNION SELECT 'CUST:' || c_custkey, 'PART:' || p_partkey FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 3 = 0"""
)
def people_index(spark, d):
    """Parts of customers: direct links, orders about parts, orders of suppliers that make parts."""
    lines, orders = T.read(spark, d, "lineitem"), T.read(spark, d, "orders")
    named = lambda p, c: F.concat(F.lit(p), c)
    edge = lambda df, a, r, b: df.select(a.alias("source_id"), F.lit(r).alias("relation"), b.alias("target_id"))
    cust, part = T.read(spark, d, "customer").select("c_custkey"), T.read(spark, d, "part").select("p_partkey")
    order, item, maker = named("ORD:", "l_orderkey"), named("PART:", "l_partkey"), named("SUPP:", "l_suppkey")
    edges = edge(orders, named("CUST:", "o_custkey"), "authored", named("ORD:", "o_orderkey"))
    edges = edges.unionByName(edge(lines.where("l_quantity >= 45"), order, "about", item)).unionByName(edge(lines.where("l_quantity <= 2"), order, "sold_by", maker)).unionByName(edge(lines.where("l_partkey % 50 = 0"), maker, "makes", item))
    edges = edges.unionByName(edge(cust.join(part, F.col("c_custkey") == F.col("p_partkey")).where("c_custkey % 3 = 0"), named("CUST:", "c_custkey"), "treats", named("PART:", "p_partkey")))
    return H.led_to(cust.select(named("CUST:", "c_custkey").alias("id")), edges, [["treats"], ["authored", "about"], ["authored", "sold_by", "makes"]])


SQL_ASKED = """WITH a AS (SELECT DISTINCT l_orderkey AS ask, l_suppkey AS cluster FROM lineitem WHERE l_orderkey % 20 = 0), t AS (SELECT DISTINCT l_suppkey AS cluster, p_name AS term FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity >= 45), k AS (SELECT DISTINCT l_orderkey AS ask, p_name AS term FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 20 = 0 AND l_linenumber = 1),
c AS (SELECT ask, count(*) AS n FROM a GROUP BY 1), w AS (SELECT ask, term, count(*) AS n_with FROM a JOIN t USING (cluster) GROUP BY ALL), q AS (SELECT ask, term, n_with, n FROM w JOIN c USING (ask) ANTI JOIN k USING (ask, term) WHERE n_with < n QUALIFY row_number() OVER (PARTITION BY ask ORDER BY least(n_with, n - n_with) DESC, abs(2 * n_with - n), term) = 1)"""


def _asked(spark, d):
    """Orders whose id is divisible by 20 ask about the suppliers of their lines; names of returned parts as terms."""
    lines, part = T.read(spark, d, "lineitem"), T.read(spark, d, "part").select("p_partkey", "p_name")
    own = lines.where("l_orderkey % 20 = 0")
    name = lambda df: df.join(part, F.col("l_partkey") == F.col("p_partkey"))
    asks = own.select(F.col("l_orderkey").alias("ask"), F.col("l_suppkey").alias("cluster"))
    terms = name(lines.where("l_returnflag = 'R' AND l_quantity >= 45")).select(F.col("l_suppkey").alias("cluster"), F.col("p_name").alias("term"))
    known = name(own.where("l_linenumber = 1")).select(F.col("l_orderkey").alias("ask"), F.col("p_name").alias("term"))
    return asks, terms, H.best_questions(asks, terms, known)


@query(SQL_ASKED + " SELECT * FROM q")
def followup_questions(spark, d):
    return _asked(spark, d)[2]


@query(SQL_ASKED + " SELECT ask, a.cluster, t.term IS NOT NULL AS has FROM a JOIN q USING (ask) LEFT JOIN t ON t.cluster = a.cluster AND t.term = q.term")
def followup_sides(spark, d):
    asks, terms, chosen = _asked(spark, d)
    return H.sides(chosen, asks, terms)


@query(
    """WITH i AS (SELECT 'MONDO:' || lpad(p_partkey::VARCHAR, 7, '0') AS id FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'PART:' || p_partkey FROM part), q AS (SELECT p_partkey AS k, CASE p_partkey % 80 WHEN 0 THEN 'mondo_' || p_partkey WHEN 20 THEN ' PART: 00' || p_partkey WHEN 40 THEN p_name || ' ' || p_partkey ELSE 'Part:' || p_partkey END AS query FROM part WHERE p_partkey % 20 = 0)
SELECT k, query, k % 80 <> 40 AS is_id, id FROM q LEFT JOIN i ON id = CASE k % 80 WHEN 0 THEN 'MONDO:' || lpad(k::VARCHAR, 7, '0') WHEN 40 THEN NULL ELSE 'PART:' || k END"""
)
def id_search(spark, d):
    """Ids written in several ways, from parts whose id is divisible by 20, against padded and plain ids; names are no ids."""
    key = F.col("p_partkey")
    p = T.read(spark, d, "part")
    index = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("MONDO:"), F.lpad(key.cast("string"), 7, "0")).alias("id")).unionByName(p.select(F.concat(F.lit("PART:"), key).alias("id")))
    text = F.when(key % 80 == 0, F.concat(F.lit("mondo_"), key)).when(key % 80 == 20, F.concat(F.lit(" PART: 00"), key)).when(key % 80 == 40, F.concat_ws(" ", "p_name", key)).otherwise(F.concat(F.lit("Part:"), key))
    asks = p.where("p_partkey % 20 = 0").select(key.alias("k"), text.alias("query"))
    asks = asks.withColumn("is_id", P.is_id_query(F.col("query")))
    found = asks.where("is_id").select("k", F.explode(P.id_candidates(F.col("query"))).alias("id")).join(index, "id").distinct()
    return asks.join(found, "k", "left").select("k", "query", "is_id", "id")


@query(
    """WITH mb AS (SELECT p_type || '-' || p_size % 10 AS cluster, p_partkey AS id, p_size % 10 AS s FROM part), cl AS (SELECT cluster, min(s) AS s FROM mb GROUP BY 1), sz AS (SELECT cluster, count(*) AS n_members FROM mb GROUP BY 1), ca AS (SELECT l_partkey AS id, l_suppkey AS gene, 'c' || l_partkey || '-' || l_suppkey AS edge, max(1 - l_discount) AS conf FROM lineitem WHERE l_quantity >= 45 GROUP BY ALL), li AS (SELECT s_suppkey AS gene, 'N' || s_nationkey AS node, 'g' || s_suppkey AS edge, 0.5::DOUBLE + s_suppkey % 50 / 100 AS conf FROM supplier),
a AS (SELECT s_suppkey AS ask, s_nationkey AS nk FROM supplier WHERE s_suppkey % 20 = 0), ht AS (SELECT ask, 'S' || ask AS node FROM a UNION ALL SELECT ask, 'N' || nk FROM a WHERE ask % 40 = 0),
me AS (SELECT ask, node, id, [edge] AS edges, conf AS st FROM ht JOIN ca ON node = 'S' || gene UNION ALL SELECT ask, ht.node, id, [ca.edge, li.edge], ca.conf * li.conf FROM ht JOIN li ON li.node = ht.node JOIN ca USING (gene)), bs AS (SELECT ask, id, st, edges FROM me QUALIFY row_number() OVER (PARTITION BY ask, id ORDER BY st DESC, node, edges) = 1),
pe AS (SELECT ask, cluster, id, st, edges FROM bs JOIN mb USING (id)), re AS (SELECT ask, cluster, sum(st) AS ss FROM pe GROUP BY ALL), nm AS (SELECT ask, cluster FROM a, cl WHERE ask % 40 = 0 AND nk = s), ow AS (SELECT ask, cluster FROM a JOIN cl ON cluster = 'ECONOMY-' || ask % 7),
al AS (SELECT ask, cluster FROM re UNION SELECT * FROM nm UNION SELECT * FROM ow), sc AS (SELECT ask, cluster, round(0.5::DOUBLE * coalesce(ss / n_members, 0) + CASE WHEN nm.ask IS NULL THEN 0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN ow.ask IS NULL THEN 0::DOUBLE ELSE 0.2::DOUBLE * (0.9::DOUBLE / 1.5::DOUBLE) END, 6) AS score, n_members FROM al JOIN sz USING (cluster) LEFT JOIN re USING (ask, cluster) LEFT JOIN nm USING (ask, cluster) LEFT JOIN ow USING (ask, cluster)),
rk AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, cluster)::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10), us AS (SELECT DISTINCT ask, cluster, unnest(edges) AS edge FROM pe), cf AS (SELECT edge, conf FROM ca UNION ALL SELECT edge, conf FROM li), sg AS (SELECT ask, cluster, round(avg(conf), 6) AS strength FROM us JOIN cf USING (edge) GROUP BY ALL), tr AS (SELECT cluster, count(DISTINCT l_orderkey) AS n_trials FROM mb JOIN lineitem ON l_partkey = id WHERE l_quantity < 5 GROUP BY 1)
SELECT ask, cluster, score, n_members, coalesce(n_trials, 0) AS n_trials, coalesce(strength, 0) AS strength, rank FROM rk LEFT JOIN sg USING (ask, cluster) LEFT JOIN tr USING (cluster)"""
)
def expert_clusters(spark, d):
    """Suppliers whose id is divisible by 20 as queries that match themselves, every other one its nation, and a cluster; parts by type and size as clusters."""
    lines, supplier, part = T.read(spark, d, "lineitem"), T.read(spark, d, "supplier"), T.read(spark, d, "part")
    k, nation = F.col("s_suppkey"), F.concat(F.lit("N"), "s_nationkey")
    cluster = F.concat_ws("-", "p_type", F.col("p_size") % 10)
    members = part.select(cluster.alias("cluster"), F.col("p_partkey").alias("id"))
    clusters = part.groupBy(cluster.alias("cluster")).agg(F.concat(F.lit("Parts of NATION_"), F.min(F.col("p_size") % 10), F.lit(" alone")).alias("text"))
    gene = lambda c: F.concat(F.lit("S"), c)
    causes = lines.where("l_quantity >= 45").groupBy(F.col("l_partkey").alias("id"), gene("l_suppkey").alias("gene"), F.concat(F.lit("c"), "l_partkey", F.lit("-"), "l_suppkey").alias("edge")).agg(F.max(1 - F.col("l_discount")).alias("confidence"))
    links = supplier.select(gene(k).alias("gene"), nation.alias("node"), F.concat(F.lit("g"), k).alias("edge"), (0.5 + (k % 50) / 100).alias("confidence"))
    asks = supplier.where("s_suppkey % 20 = 0")
    hit = lambda rows, node, kind, label, base: rows.select(k.alias("ask"), node.alias("node"), F.lit(kind).alias("kind"), label.alias("label"), F.lit(base).alias("base"))
    hits = hit(asks, gene(k), "gene", F.col("s_name"), 1.0).unionByName(hit(asks.where("s_suppkey % 40 = 0"), nation, "pathway", F.concat(F.lit("Nation "), "s_nationkey"), 0.8))
    hits = hits.unionByName(hit(asks, F.concat(F.lit("ECONOMY-"), k % 7), "cluster", F.lit("x"), 0.9)).unionByName(hit(asks, gene(k + 1), "gene", F.lit("x"), 0.1))
    trials = lines.where("l_quantity < 5").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("trial"))
    return H.expert_clusters(hits, clusters, members, causes, links, trials)
