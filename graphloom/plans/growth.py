"""Registered queries of scope growth, slots and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope as S
from ..sources import tables as T
from ..streaming import slots as B
from .catalog import SQL_MECH, _mechanisms, query

_HOP = """, m{h} AS MATERIALIZED (SELECT target AS id, -min((-score, reason))[1] AS score, min((-score, reason))[2] AS reason FROM offers WHERE source IN (SELECT id FROM s{p} WHERE hop = {p}) AND target NOT IN (SELECT id FROM s{p}) AND target IN (SELECT id FROM el) GROUP BY 1), s{h} AS MATERIALIZED (SELECT * FROM s{p} UNION ALL SELECT * FROM (SELECT id, {h} AS hop, score, reason FROM m{h} ORDER BY score DESC, id LIMIT least({cap}, 250 - (SELECT count(*) FROM s{p}))))"""
SQL_SCOPE = (
    "WITH "
    + SQL_MECH
    + """, g AS (SELECT DISTINCT disease AS id, gene FROM mt WHERE mechanism IS NOT NULL), few AS (SELECT id FROM g GROUP BY 1 HAVING count(*) <= 8), pw AS (SELECT DISTINCT s_nationkey AS pathway, s_suppkey AS gene FROM supplier), of_ AS (SELECT id, gene, pathway FROM g JOIN few USING (id) JOIN pw USING (gene)),
offers AS MATERIALIZED (SELECT x.id AS source, y.id AS target, 1.0::DOUBLE AS score, 'gene ' || gene AS reason FROM g x JOIN g y USING (gene) WHERE x.id <> y.id AND x.id IN (SELECT id FROM few) UNION ALL SELECT DISTINCT x.id, y.id, 0.5::DOUBLE, 'pathway ' || pathway FROM of_ x JOIN of_ y USING (pathway) WHERE x.id <> y.id AND x.gene <> y.gene),
el AS (SELECT p_partkey AS id FROM part WHERE p_size >= 10), s0 AS MATERIALIZED (SELECT p_partkey AS id, 0 AS hop, 1.0::DOUBLE AS score, 'seed' AS reason FROM part WHERE p_partkey % 100 = 0)"""
    + _HOP.format(h=1, p=0, cap=120)
    + _HOP.format(h=2, p=1, cap=60)
)


@query(SQL_SCOPE + " SELECT id, hop, score, reason FROM s2")
def scope_expansion(spark, d):
    """Parts whose id is divisible by 100 as seeds; suppliers as genes, nations as pathways; at most 120, then 60 join."""
    genes = _mechanisms(spark, d).select(F.col("disease").alias("id"), "gene")
    members = T.read(spark, d, "supplier").select(F.col("s_nationkey").alias("pathway"), F.col("s_suppkey").alias("gene"))
    part = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    offers = S.gene_offers(genes, 8).unionByName(S.pathway_offers(genes, members, 8))
    return S.expand(part.where("id % 100 = 0"), offers, part.where("p_size >= 10"), [120, 60], 250)


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS asked, least(count(*), 30) AS granted FROM events GROUP BY ALL")
def daily_budgets(spark, d):
    """Requests granted a day with 30 a user, slots never short."""
    got = B.granted(T.read(spark, d, "events"), capacity=1 << 30, daily=30)
    return got.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("verdict") == "granted").alias("granted"))


@query()
def slot_grants(spark, d):
    """Every request by two slots of 60 minutes and 20 grants a day; a rule step by step, tested by plain Python in tests/test_growth.py."""
    return B.granted(T.read(spark, d, "events"), minutes=60).select("event_id", "user_id", "verdict")
