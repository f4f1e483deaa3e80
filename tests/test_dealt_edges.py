"""Edges and their counts: assertions are sent once, dealt by the ends of their edge, in tasks of a bounded size."""

from graphloom.operators import graph as G
from graphloom.operators import merge as M


def assertions(spark, rows, relation=None):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, "source_id string, relation string, target_id string, origin string, tier string, source_type string, source_ref string, polarity string, weight double")
    return d if relation is None else d.withColumn("relation", F.lit(relation))


ROWS = [("d1", "shared_gene", "d2", "observed", "curated_db", "t", f"r{i % 3}", "supports", None) for i in range(6)] + [("d2", "shared_gene", "d1", "observed", "review", "t", "r", "supports", None), ("d1", "near_on_chromosome", "d2", "observed", "review", "t", "r", "contradicts", None), ("d1", "shared_gene", "d1", "observed", "review", "t", "r", "supports", None)]


def test_assertions_are_sent_once(spark):
    for relation in (None, "shared_gene"):
        e = M.edges(assertions(spark, ROWS, relation), 9)
        assert e._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {(r["source_id"], r["relation"], r["target_id"]): (r["n_evidence"], r["n_contradicting"]) for r in M.edges(assertions(spark, ROWS)).collect()}
    assert got == {("d1", "shared_gene", "d2"): (3, 0), ("d2", "shared_gene", "d1"): (1, 0), ("d1", "near_on_chromosome", "d2"): (1, 1), ("d1", "shared_gene", "d1"): (1, 0)}


def test_relations_of_a_hub(spark):
    more = [(f"x{i}", "shared_gene", "d1", "observed", "review", "t", "r", "supports", None) for i in range(20)]
    got = {(r["node"], r["relation"]): (r["n_edges"], r["n_neighbours"]) for r in G.relations(M.edges(assertions(spark, ROWS + more)), 58).where("node IN ('d1', 'd2')").collect()}
    # Both directions between d1 and d2 are two edges to one neighbour; a loop is one edge.
    assert got == {("d1", "shared_gene"): (23, 22), ("d2", "shared_gene"): (2, 1), ("d1", "near_on_chromosome"): (1, 1), ("d2", "near_on_chromosome"): (1, 1)}
