"""Names of a dictionary in whole texts: words are matched by their first word, the longest match counts.

Texts are cut into folded words.  A word goes on only if some name begins with it, with as many following words
as that name has, so the dictionary's first words thin the texts before any phrase is built.  Of matches in one
another the longest stays; those that only overlap all stay.  A name of several ids is ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import staged

APART = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), APART), lambda w: w != "")


def dictionary(names: DataFrame, most_words: int) -> DataFrame:
    """(name, first, size, id, n_ids) of names (id, name) with one to most_words words; id is the least, n_ids how many."""
    w = names.where("id IS NOT NULL").select("id", words_of(F.coalesce("name", F.lit(""))).alias("w")).where(F.size("w").between(1, most_words))
    cut = w.select("id", F.array_join("w", " ").alias("name"), F.element_at("w", 1).alias("first"), F.size("w").alias("size"))
    return staged(cut.groupBy("name", "first", "size").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n_ids")), "names")


def mentions(texts: DataFrame, names: DataFrame, most_words: int = 6) -> DataFrame:
    """(key, at, size, name, id, n_ids): where names stand in texts (key, text); at counts words from 1, id is null if ambiguous.

    Keys tell texts apart; a null text has no mentions.
    """
    known = dictionary(names, most_words)
    sizes = known.groupBy("first").agg(F.collect_set("size").alias("sizes"))  # at most most_words numbers
    words = texts.select("key", words_of(texts["text"]).alias("w"))
    # The words that follow travel with each word, so phrases need no second look at the text.
    each = words.select("key", F.posexplode(F.transform("w", lambda x, i: F.struct(x.alias("first"), i.alias("i")))).alias("p", "x"), "w").select("key", (F.col("p") + 1).alias("at"), F.col("x.first").alias("first"), F.slice("w", F.col("p") + 1, F.lit(most_words)).alias("next"))
    starts = each.join(sizes, "first").select("key", "at", "next", F.explode("sizes").alias("size")).where(F.size("next") >= F.col("size"))
    phrases = starts.select("key", "at", F.array_join(F.slice("next", F.lit(1), F.col("size")), " ").alias("name"))
    found = phrases.join(known, "name")
    end = F.col("at") + F.col("size")
    before = Window.partitionBy("key").orderBy("at", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    kept = found.withColumn("reach", F.max(end).over(before)).where(F.col("reach").isNull() | (F.col("reach") < end))
    return kept.select("key", "at", "size", "name", F.when(F.col("n_ids") == 1, F.col("id")).alias("id"), "n_ids")
