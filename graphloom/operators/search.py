"""Lexical, phrase, trigram and vector search, and their fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fold
from ..shared import staged
from .merge import top
from .trigram import fuzzy  # noqa: F401  part of this module's searches


def exact(index: DataFrame, queries: DataFrame) -> DataFrame:
    """index (id, text, kind: name or synonym), queries (query): 3.0 for the id, 2.5 for the name, 2.2 for a synonym."""
    q = queries.select("query", F.lower("query").alias("key"), fold(F.col("query")).alias("folded"))
    by_id = q.join(index.select("id", F.lower("id").alias("key")).distinct(), "key").select("query", "id", F.lit(3.0).alias("score"))
    names = index.select("id", fold(F.col("text")).alias("folded"), F.when(F.col("kind") == "name", 2.5).otherwise(2.2).alias("score"))
    return by_id.unionByName(q.join(names, "folded").select("query", "id", "score")).groupBy("query", "id").agg(F.max("score").alias("score"))


def phrases(index: DataFrame, queries: DataFrame, most: int = 6, least_chars: int = 4) -> DataFrame:
    """Names that stand in a longer query as whole words: 1.2 + 0.5 * words / query words."""
    words = F.split(fold(F.col("query")), " ")
    q = queries.select("query", words.alias("w"), F.size(words).alias("n")).where("n > 1")
    grams = q.select("query", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("n") - 1))).alias("k"), "w").select("query", "n", "k", "w", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("k") + 1)).alias("at"))
    grams = grams.select("query", "n", "k", F.array_join(F.slice("w", F.col("at"), F.col("k")), " ").alias("folded")).where(F.length("folded") >= least_chars).distinct()
    return grams.join(index.select("id", fold(F.col("text")).alias("folded")).distinct(), "folded").groupBy("query", "id").agg(F.round(F.max(1.2 + 0.5 * F.col("k") / F.col("n")), 6).alias("score"))


def dice(index: DataFrame, queries: DataFrame, least: float = 0.6) -> DataFrame:
    """Word overlap 2 * common / (words of both) of at least `least`; a final s does not count."""
    words = lambda c: F.array_distinct(F.transform(F.filter(F.split(fold(F.col(c)), " "), lambda w: w != ""), lambda w: F.regexp_replace(w, "(?<=...)s$", "")))
    i = index.select("id", fold(F.col("text")).alias("text")).distinct().select("id", "text", words("text").alias("w")).select("id", "text", F.size("w").alias("n"), F.explode("w").alias("word"))
    q = queries.select("query", words("query").alias("w")).select("query", F.size("w").alias("m"), F.explode("w").alias("word"))
    both = q.join(i, "word").groupBy("query", "m", "id", "text", "n").agg(F.count(F.lit(1)).alias("both"))
    return both.withColumn("score", F.round(2 * F.col("both") / (F.col("m") + F.col("n")), 6)).where(F.col("score") >= least).groupBy("query", "id").agg(F.max("score").alias("score"))


def _packed(rows: int):
    """Batches of (id, v) to blocks of unit vectors: (ids, matrix, width); vectors without length go."""

    def run(batches):
        for batch in batches:
            wide: dict[int, list] = {}
            for i, v in zip(batch["id"].to_pylist(), batch["v"].to_pylist(), strict=True):
                if v and None not in v:
                    wide.setdefault(len(v), []).append((i, v))
            for width, found in wide.items():
                m = np.array([v for _, v in found], np.float64)
                size = np.sqrt((m * m).sum(1))
                ids, m = np.array([i for i, _ in found], object)[size > 0], m[size > 0] / size[size > 0, None]
                for at in range(0, len(ids), rows):
                    yield pa.RecordBatch.from_arrays([pa.array([list(ids[at : at + rows])]), pa.array([m[at : at + rows].tobytes()], pa.binary()), pa.array([width])], ["ids", "m", "width"])

    return run


def _best(k: int):
    """Pairs of a block of the index and one of queries to each query's k best in it."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                i, q = (np.frombuffer(r[x]).reshape(-1, r["width"]) for x in ("m", "qm"))
                ids, score = np.array(r["ids"]), np.round(q @ i.T, 6)
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score))[:, :k]
                which = np.repeat(np.arange(len(q)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(r["qids"])[which]), pa.array(ids[order.ravel()]), pa.array(score[which, order.ravel()])], ["query", "id", "score"])

    return run


def vector_top(index: DataFrame, queries: DataFrame, k: int, rows: int = 2048, small_bytes: int = 32 << 20) -> DataFrame:
    """Exact cosine top k of a stated query set against all vectors: (query, id, score, rank); long ids.

    index (id, v), queries (query, q).  Both sides are packed into blocks of at most `rows` vectors; each block of
    the index meets each block of queries (broadcast while all have at most `small_bytes`), and only the k best
    of a query in a block leave the task.  Null
    vectors, and those with nulls or without length, have no neighbours; vectors of unlike lengths do not meet.
    """
    packed = lambda df, i, v: staged(df.select(F.col(i).cast("long").alias("id"), F.col(v).alias("v")).mapInArrow(_packed(rows), "ids array<long>, m binary, width long"), "blocks")
    i = packed(index, "id", "v")
    q = packed(queries, "query", "q").select(F.col("ids").alias("qids"), F.col("m").alias("qm"), F.col("width").alias("qwidth"))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("qm")), F.lit(0)).alias("bytes")).first()
    if size["bytes"] <= small_bytes:  # index blocks stay where they are
        met = i.join(F.broadcast(q), F.col("width") == F.col("qwidth"))
    else:  # each pair of blocks is a unit of work of its own
        spread = i.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(size["n"] - 1)))).repartition("salt", F.xxhash64("ids"))
        numbered = q.withColumn("salt", F.row_number().over(Window.orderBy(F.element_at("qids", 1), F.size("qids"))) - 1)  # one row a block
        met = spread.join(numbered, "salt").where("width = qwidth")
    met = met.select("ids", "m", "width", "qids", "qm")
    return top(met.mapInArrow(_best(k), "query long, id long, score double"), ["query"], [F.desc("score"), F.asc("id")], k)


def fused(parts: list[DataFrame], boosts: DataFrame) -> DataFrame:
    """Best base score per (query, id) over the parts, plus the node's boost, plus 0.1 if two kinds found it."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [p.select("query", "id", "score").withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    best = every.groupBy("query", "id").agg(F.max("score").alias("base"), F.countDistinct("part").alias("kinds"))
    return best.join(boosts, "id", "left").select("query", "id", F.round(F.col("base") + F.coalesce("boost", F.lit(0.0)) + F.when(F.col("kinds") > 1, 0.1).otherwise(0.0), 6).alias("score"))
