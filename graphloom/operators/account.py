"""Follows, calls, threads and contributions as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import placed
from .merge import top


def follow_changes(follows: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per follow and change of its subject made after it in another version than it knows."""
    met = follows.join(changes.withColumnRenamed("created_at", "changed_at").withColumnRenamed("version", "new_version"), "subject")
    return met.where((F.col("changed_at") > F.col("created_at")) & ~F.col("version").eqNullSafe(F.col("new_version")))


def follow_calls(follows: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per user and call that names a followed subject in its list; the least subject stands for it."""
    named = calls.select("call_id", F.explode(F.array_distinct("subjects")).alias("subject"))
    return follows.join(named, "subject").groupBy("user", "call_id").agg(F.min("subject").alias("subject"))


def listed_calls(calls: DataFrame, cards: DataFrame, now: str) -> DataFrame:
    """Published calls that are not expired, by publishers whose card can be seen."""
    alive = calls.where((F.col("status") == "published") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.to_timestamp(F.lit(now)))))
    return alive.join(cards.where("visible").select("publisher"), "publisher", "left_semi")


def thread_list(threads: DataFrame, messages: DataFrame, reads: DataFrame) -> DataFrame:
    """Per thread and user: unread messages of others, the last message, and whether an own one exists.

    Messages up to a reading are the place of the reading among both less its place among readings, so a busy thread is
    sorted once and members never meet its messages one by one; own messages after the reading are taken off.
    """
    read = reads.where("read_at IS NOT NULL").groupBy("thread", "user").agg(F.max("read_at").alias("read_at"))
    told = messages.select("thread", F.col("sent_at").alias("at"), F.lit(0).alias("kind"), "user").unionByName(read.select("thread", F.col("read_at").alias("at"), F.lit(1).alias("kind"), "user"))
    order = [F.col("at"), F.col("kind"), F.col("user")]
    both = placed(told, ["thread"], order).where("kind = 1").select("thread", "user", "place")
    alone = placed(told.where("kind = 1"), ["thread"], order).select("thread", "user", F.col("place").alias("readings"))
    upto = both.join(alone, ["thread", "user"]).select("thread", "user", (F.col("place") - F.col("readings")).alias("upto"))
    whole = messages.groupBy("thread").agg(F.count(F.lit(1)).alias("n"), F.max("sent_at").alias("last"))
    own = messages.join(read, ["thread", "user"], "left").groupBy("thread", "user").agg(F.count_if(F.col("read_at").isNull() | (F.col("sent_at") > F.col("read_at"))).alias("own"))
    j = threads.join(upto, ["thread", "user"], "left").join(whole, "thread", "left").join(own, ["thread", "user"], "left")
    unread = F.coalesce("n", F.lit(0)) - F.coalesce("upto", F.lit(0)) - F.coalesce("own", F.lit(0))
    return j.select("thread", "user", unread.alias("unread"), "last", F.col("own").isNotNull().alias("wrote"))


def overlaid(edges: DataFrame, flags: DataFrame, contributions: DataFrame) -> DataFrame:
    """Edges with their open flags and the contributed ones; a flagged edge is under review."""
    both = edges.select("id", "status").unionByName(contributions.select("id", F.lit("user").alias("status")))
    n = flags.groupBy("id").agg(F.count(F.lit(1)).alias("flags"))
    return both.join(n, "id", "left").select("id", F.coalesce("flags", F.lit(0)).alias("flags"), F.when(F.col("flags") > 0, "under_review").otherwise(F.col("status")).alias("status"))


def stamped(entries: DataFrame, key: list[str]) -> DataFrame:
    """Of repeated entries the last one, at the place of the first."""
    first = entries.groupBy(*key).agg(F.min("place").alias("at"))
    return top(entries, key, [F.desc("place")], 1).drop("rank", "place").join(first, key)


def limited(entries: DataFrame, user: str, order: list, most: int) -> DataFrame:
    """Each user's entries with what becomes of them: added up to the limit, refused beyond."""
    ranked = top(entries, [user], order, 2**31 - 1)
    return ranked.withColumn("outcome", F.when(F.col("rank") <= most, "added").otherwise("limit"))


def suggestion_score(own: DataFrame, calls: DataFrame) -> DataFrame:
    """(user, call_id, score): 3 for a common disease, 2 for a common gene, 1 for two symptoms or more in common."""
    met = own.join(calls.select("call_id", "kind", F.explode("ids").alias("id")).distinct(), ["kind", "id"]).groupBy("user", "call_id", "kind").agg(F.countDistinct("id").alias("n"))
    points = F.when(F.col("kind") == "disease", 3).when(F.col("kind") == "gene", 2).when(F.col("n") >= 2, 1).otherwise(0)
    return met.groupBy("user", "call_id").agg(F.sum(points).alias("score")).where("score > 0")
