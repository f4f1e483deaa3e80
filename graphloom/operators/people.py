"""People matched to entries, the ids that people's works lead to, the question that splits candidates best, expert clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import normal_name
from ..shared import staged
from .merge import top


def first_ids(df: DataFrame, key: list[str], n: int, salts: int = 32) -> DataFrame:
    """(key, id): the n least ids of each key; a key of many ids lies in many tasks first."""
    rows = df.select(*key, "id").distinct().withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    few = top(rows, [*key, "_salt"], [F.asc("id")], n).drop("_salt", "rank")
    return top(few, key, [F.asc("id")], n).drop("rank")


def match_people(asks: DataFrame, wanted: DataFrame, people: DataFrame, places: DataFrame, most: int = 5) -> DataFrame:
    """(ask, id, matched_by, rank): entries for a draft: its registered id, then the same name and a shared place, then the same name.

    asks (ask, orcid, name_key: null if weak), wanted (ask, place), people (id, orcid, name_key), places (id,
    place).  Within a kind the lesser id goes first.  Of a name, and of a name at a place, the first `most` ids
    are enough for the first `most` of the answer, so a common name costs no more than a rare one.
    """
    people = people.where("id IS NOT NULL")
    exact = asks.where("orcid IS NOT NULL").select("ask", "orcid").join(people.select("orcid", "id"), "orcid").select("ask", "id", F.lit(0).alias("kind"))
    named = asks.where("name_key <> ''").select("ask", "name_key").distinct()
    by_name = named.join(first_ids(people.where("name_key <> ''"), ["name_key"], most), "name_key").select("ask", "id", F.lit(2).alias("kind"))
    at = people.where("name_key <> ''").select("id", "name_key").join(places.where("place IS NOT NULL").select("id", "place"), "id")
    both = named.join(wanted.where("place IS NOT NULL").select("ask", "place").distinct(), "ask").join(first_ids(at, ["name_key", "place"], most), ["name_key", "place"]).select("ask", "id", F.lit(1).alias("kind"))
    best = exact.unionByName(both).unionByName(by_name).groupBy("ask", "id").agg(F.min("kind").alias("kind"))
    ranked = top(best, ["ask"], [F.asc("kind"), F.asc("id")], most)
    return ranked.select("ask", "id", F.when(F.col("kind") == 0, "orcid").when(F.col("kind") == 1, "name_and_place").otherwise("name").alias("matched_by"), "rank")


def led_to(people: DataFrame, edges: DataFrame, chains: list[list[str]]) -> DataFrame:
    """(person, id): what people are linked to directly or at the end of a chain of relations; a chain of one is a direct link.

    people (id), edges (source_id, relation, target_id), walked either way.  After each step a person has each
    node once, so many ways to one node are walked on once.
    """
    there = edges.select(F.col("source_id").alias("at"), "relation", F.col("target_id").alias("to"))
    ways = there.unionByName(edges.select(F.col("target_id").alias("at"), "relation", F.col("source_id").alias("to"))).where("at <> to")
    found = None
    for chain in chains:
        front = people.select(F.col("id").alias("person"), F.col("id").alias("at"))
        for i, relation in enumerate(chain):
            step = front.join(ways.where(F.col("relation") == relation).select("at", "to"), "at").where("to <> person")
            front = step.select("person", F.col("to").alias("at")).distinct()
            if i + 1 < len(chain):
                front = staged(front, "walk")
        ends = front.select("person", F.col("at").alias("id"))
        found = ends if found is None else found.unionByName(ends)
    return found.distinct()


def best_questions(asks: DataFrame, terms: DataFrame, known: DataFrame) -> DataFrame:
    """(ask, term, n_with, n): the term that parts an ask's candidates most evenly; none where all or no candidates have it.

    asks (ask, cluster), terms (cluster, term), known (ask, term): what is asked no more.  Ties go to the lesser term.
    """
    asked = asks.select("ask", "cluster").where("cluster IS NOT NULL").distinct()
    n = asked.groupBy("ask").agg(F.count(F.lit(1)).alias("n"))
    have = asked.join(terms.select("cluster", "term").where("term IS NOT NULL").distinct(), "cluster").groupBy("ask", "term").agg(F.count(F.lit(1)).alias("n_with"))
    open_ = have.join(known.select("ask", "term"), ["ask", "term"], "left_anti").join(n, "ask").where("n_with < n")
    order = F.struct((-F.least(F.col("n_with"), F.col("n") - F.col("n_with"))).alias("split"), F.abs(2 * F.col("n_with") - F.col("n")).alias("off"), "term", "n_with", "n")
    return open_.groupBy("ask").agg(F.min(order).alias("o")).select("ask", "o.term", "o.n_with", "o.n")


def sides(questions: DataFrame, asks: DataFrame, terms: DataFrame) -> DataFrame:
    """(ask, cluster, has): the candidates with and without the chosen term."""
    have = terms.select("cluster", "term").distinct().withColumn("_has", F.lit(True))
    return asks.select("ask", "cluster").where("cluster IS NOT NULL").distinct().join(questions.select("ask", "term"), "ask").join(have, ["cluster", "term"], "left").select("ask", "cluster", F.coalesce("_has", F.lit(False)).alias("has"))


def word_runs(name: str) -> Column:
    """All runs of whole words of a normalized name, as an array."""
    words = F.split(name, " ")
    n = F.size(words)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), " ")))))


def teams(asked: DataFrame) -> DataFrame:
    """(ask, team, nodes): the nodes of each ask that others match too, and the least ask with just these."""
    shared = asked.join(asked.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "node", "left_semi")
    sets = staged(shared.groupBy("ask").agg(F.array_sort(F.collect_set("node")).alias("nodes")), "sets")
    return sets.join(sets.groupBy("nodes").agg(F.min("ask").alias("team")), "nodes").select("ask", "team", "nodes")


def expert_clusters(hits: DataFrame, clusters: DataFrame, members: DataFrame, causes: DataFrame, links: DataFrame, trials: DataFrame, most: int = 10, least_base: float = 0.2) -> DataFrame:
    """(ask, cluster, score, n_members, n_trials, strength, rank): clusters by how well their members reach what a query matched.

    hits (ask, node, kind: gene, mechanism, pathway or cluster, label, base), clusters (cluster, text), members
    (cluster, id), causes (id, gene, edge, confidence), links (gene, node, edge, confidence), trials (id, trial).
    A member's best chain id -> gene [-> node] counts, ties to the lesser node, then to the lesser edges.
    score = 0.5 * coverage * mean strength + 0.3 if the text names a matched mechanism or pathway + 0.2 * own match.

    What a node reaches grows with the graph, and so do the asks that match a common one.  So asks that match the same
    nodes, those aside that they match alone, are one team: its members are reached and summed once, and each
    ask only adds where a node of its own gives a better chain.
    """
    hits = staged(hits.where(F.col("base") >= least_base).groupBy("ask", "node").agg(F.max("base").alias("base"), F.min("kind").alias("kind"), F.min("label").alias("label")), "hits")
    members = members.select("cluster", "id").distinct()
    reach = causes.select("id", F.col("gene").alias("node"), F.array("edge").alias("edges"), F.col("confidence").alias("strength"))
    two = causes.alias("c").join(links.alias("l"), "gene").select("id", F.col("l.node").alias("node"), F.array("c.edge", "l.edge").alias("edges"), (F.col("c.confidence") * F.col("l.confidence")).alias("strength"))
    reach = reach.unionByName(two).where("strength > 0")
    chain = F.struct((-F.col("strength")).alias("s"), "node", "edges")
    asked = hits.where("kind <> 'cluster'").select("ask", "node")
    team_of = staged(teams(asked), "teams")
    nodes = team_of.select("team", F.explode("nodes").alias("node")).distinct()
    team_of = team_of.select("ask", "team")
    alone = asked.join(nodes.select("node").distinct(), "node", "left_anti")
    best = staged(nodes.join(reach, "node").groupBy("team", "id").agg(F.min(chain).alias("o")), "best")
    own_best = alone.join(reach, "node").groupBy("ask", "id").agg(F.min(chain).alias("new")).join(team_of, "ask", "left")
    other = own_best.join(best.withColumnRenamed("o", "old"), ["team", "id"], "left").where(F.col("old").isNull() | (F.col("new") < F.col("old")))
    other = staged(other.join(members, "id").select("ask", "team", "cluster", "old", "new"), "other")
    per = staged(best.join(members, "id").select("team", "cluster", (-F.col("o.s")).alias("strength"), "o.edges"), "reached")
    sums = per.groupBy("team", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("strength").alias("s"))
    more = other.select("ask", "cluster", F.col("old").isNull().cast("long").alias("n"), (F.coalesce("old.s", F.lit(0.0)) - F.col("new.s")).alias("s"))
    reached = team_of.join(sums, "team").select("ask", "cluster", "n", "s").unionByName(more).groupBy("ask", "cluster").agg(F.sum("n").alias("n_reached"), F.sum("s").alias("sum_strength"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_members"))
    texts = staged(clusters.select("cluster", normal_name(F.coalesce("text", F.lit(""))).alias("text")), "texts")
    runs = texts.select("cluster", F.explode(word_runs("text")).alias("name"))
    named = hits.where("kind IN ('mechanism', 'pathway')").select("ask", normal_name(F.col("label")).alias("name")).where("name <> ''").distinct().join(runs, "name").select("ask", "cluster").distinct().withColumn("_named", F.lit(0.3))
    own = hits.where("kind = 'cluster'").join(clusters.select(F.col("cluster").alias("node")), "node").select("ask", F.col("node").alias("cluster"), F.least(F.lit(1.0), F.col("base") / 1.5).alias("_own"))
    j = reached.join(named, ["ask", "cluster"], "full").join(own, ["ask", "cluster"], "full").join(size, "cluster", "left")
    none = F.lit(0.0)
    score = 0.5 * F.coalesce(F.col("n_reached") / F.col("n_members") * (F.col("sum_strength") / F.col("n_reached")), none) + F.coalesce("_named", none) + 0.2 * F.coalesce("_own", none)
    ranked = staged(top(j.withColumn("score", F.round(score, 6)).where("score > 0"), ["ask"], [F.desc("score"), F.asc("cluster")], most), "ranked")
    conf = causes.select("edge", "confidence").unionByName(links.select("edge", "confidence")).groupBy("edge").agg(F.max("confidence").alias("confidence"))
    of_team = ranked.select("ask", "cluster").join(team_of, "ask", "left")
    edges = per.join(of_team.select("team", "cluster").distinct(), ["team", "cluster"], "left_semi").select("team", "cluster", F.explode("edges").alias("edge"))
    used = staged(edges.groupBy("team", "cluster", "edge").agg(F.count(F.lit(1)).alias("n")).join(conf, "edge"), "used")
    of = used.groupBy("team", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("s"))
    # An edge leaves a cluster of an ask with the last member that uses it.
    uses = lambda column, step: F.transform(F.coalesce(f"{column}.edges", F.array().cast("array<string>")), lambda e: F.struct(e.alias("edge"), F.lit(step).alias("step")))
    moved = other.join(ranked.select("ask", "cluster"), ["ask", "cluster"], "left_semi").select("ask", "team", "cluster", F.inline(F.concat(uses("old", -1), uses("new", 1))))
    moved = moved.groupBy("ask", "team", "cluster", "edge").agg(F.sum("step").alias("step")).join(conf, "edge").join(used.select("team", "cluster", "edge", "n"), ["team", "cluster", "edge"], "left")
    before = F.coalesce("n", F.lit(0))
    change = (before + F.col("step") > 0).cast("int") - (before > 0).cast("int")
    moved = moved.groupBy("ask", "cluster").agg(F.sum(change).alias("_n"), F.sum(change * F.col("confidence")).alias("_s"))
    both = of_team.join(of, ["team", "cluster"], "left").join(moved, ["ask", "cluster"], "left")
    total = lambda x: F.coalesce(x, F.lit(0)) + F.coalesce(f"_{x}", F.lit(0))
    strength = both.where(total("n") > 0).select("ask", "cluster", F.round(total("s") / total("n"), 6).alias("strength"))
    tested = members.join(ranked.select("cluster").distinct(), "cluster", "left_semi").join(trials.select("id", "trial"), "id").select("cluster", "trial").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("n_trials"))
    out = ranked.join(strength, ["ask", "cluster"], "left").join(tested, "cluster", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("ask", "cluster", "score", zero("n_members"), zero("n_trials"), F.coalesce("strength", none).alias("strength"), "rank")
