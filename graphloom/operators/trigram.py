"""Trigram similarity of texts: sets of whole texts, and the best stretch of a longer text.

Texts and queries are folded and made unique first, so copies cost nothing.  Candidates come from an inverted
index by the prefix rule: a match at threshold t shares ceil(t * n) of a query's n trigrams, so it shares one of
any n - ceil(t * n) + 1 of them, and only the rarest so many are looked up.  A trigram that most texts
hold is looked up only for queries of nothing else.  Sets of n and m trigrams share at least t * (n + m) / (1 + t)
where their similarity is t: so the larger the texts, the fewer trigrams are looked up in those of their size, and a
pair whose looked-up trigrams leave too few is not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fold, trigrams
from ..shared import staged
from .merge import top

#: Thresholds of `similar` and `word similar` (fixed values).
SIMILAR, WORD_SIMILAR = 0.3, 0.6
ROUNDING = 1e-6
#: A trigram is rare where not more than one text in so many holds it; no part of the result.
RARE = 16


def word_trigrams(text: Column) -> Column:
    """Trigrams of each folded word, two spaces before it and one after, in order and with repeats."""
    words = F.filter(F.split(fold(text), " "), lambda w: w != "")
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(words, cut))


def rarest(queries: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(q, gram, n, rest): of each query the trigrams to look up, its size and how many held ones are not looked up.

    queries (q, qs: distinct trigrams), texts (t, ts).
    """
    df = texts.select(F.explode("ts").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    each = queries.select("q", F.size("qs").alias("n"), F.explode("qs").alias("gram")).join(df, "gram")
    ranked = top(each, ["q"], [F.asc("df"), F.asc("gram")], 1 << 30)
    # Trigrams that no text holds cannot be shared: they count among those looked up.
    held = each.groupBy("q").agg(F.count(F.lit(1)).alias("held"))
    probes = F.col("n") - F.ceil((least - ROUNDING) * F.col("n")) + 1 - (F.col("n") - F.col("held"))
    return ranked.join(held, "q").where(F.col("rank") <= probes).select("q", "gram", "n", F.greatest(F.lit(0), F.col("held") - probes).alias("rest"))


def rarest_by_size(queries: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(q, gram, m, need, rest): of each query the trigrams to look up among texts of m trigrams, how many it must share with them and how many held ones are not looked up.

    At least one of the rarest held - need + 1 is shared.  Other rare ones are looked up too: they cost little, and the
    more are looked up, the fewer pairs are left to compare.
    """
    low = least - ROUNDING
    sizes = staged(texts.select(F.size("ts").alias("m"), F.explode("ts").alias("gram")).groupBy("gram", "m").agg(F.count(F.lit(1)).alias("df")), "sizes")
    df = sizes.groupBy("gram").agg(F.sum("df").alias("df"))
    each = queries.select("q", F.size("qs").alias("n"), F.explode("qs").alias("gram")).join(df, "gram")
    ranked = top(each, ["q"], [F.asc("df"), F.asc("gram")], 1 << 30)
    held = each.groupBy("q").agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("df") <= texts.count() / RARE).alias("rare"))
    suits = (F.col("m") >= low * F.col("n")) & (F.col("n") >= low * F.col("m"))
    at = ranked.join(held, "q").join(sizes.select("gram", "m"), "gram").where(suits).withColumn("need", F.ceil(low / (1 + low) * (F.col("n") + F.col("m"))))
    at = at.withColumn("probes", F.greatest(F.col("held") - F.col("need") + 1, "rare"))
    return at.where((F.col("need") <= F.col("held")) & (F.col("rank") <= F.col("probes"))).select("q", "gram", "m", "need", (F.col("held") - F.col("probes")).alias("rest"))


def candidates(queries: DataFrame, texts: DataFrame, least: float, whole: bool) -> DataFrame:
    """(q, qs, t, ts) of pairs that may reach the threshold; whole: sizes must suit a similarity of whole sets."""
    posts = texts.select("t", F.size("ts").alias("m"), F.explode("ts").alias("gram"))
    # The look-ups are few bytes and much work: dealt to all cores, which a number given here keeps.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    probes = staged(rarest_by_size(queries, texts, least) if whole else rarest(queries, texts, least), "probes").repartition(4 * cores, "q")
    if whole:
        met = probes.join(posts, ["gram", "m"])
        pairs = met.groupBy("q", "t").agg((F.count(F.lit(1)) + F.first("rest")).alias("most"), F.first("need").alias("need")).where("most >= need").select("q", "t")
    else:
        pairs = probes.join(posts, "gram").select("q", "t").distinct()
    pairs = staged(pairs, "pairs").repartition(4 * cores, "q", "t")
    return pairs.join(queries, "q").join(texts, "t")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both)


def best_stretch(qs: Column, run: Column) -> Column:
    """The greatest overlap of a set of trigrams and any stretch of a run of trigrams.

    A best stretch begins and ends with a trigram of the set, so only those places are tried.
    """
    places = F.filter(F.sequence(F.lit(1), F.size(run)), lambda i: F.array_contains(qs, F.element_at(run, i)))
    of = lambda i: F.array_max(F.transform(F.filter(places, lambda j: j >= i), lambda j: overlap(qs, F.array_distinct(F.slice(run, i, j - i + 1)))))
    return F.when(F.size(run) > 0, F.coalesce(F.array_max(F.transform(places, of)), F.lit(0.0))).otherwise(0.0)


def spread(scored: DataFrame, index: DataFrame, queries: DataFrame, columns: list[str], k: int | None = None) -> DataFrame:
    """Scores of folded texts (q, t, ...) for the rows that have them: (query, id, ...), the best of a row's texts.

    Where the k best by one score are asked for, ties to the least id, only the k least ids of a text can be among them.
    """
    names = index.select("id", fold(F.col("text")).alias("t")).distinct()
    if k is not None:
        names = top(names, ["t"], [F.asc("id")], k).select("id", "t")
    asks = queries.select("query", fold(F.col("query")).alias("q")).distinct()
    j = scored.join(names, "t").join(asks, "q")
    return j.groupBy("query", "id").agg(*(F.max(c).alias(c) for c in columns))


def unique(df: DataFrame, text: str, name: str, grams: str, cut) -> DataFrame:
    return staged(df.select(fold(F.col(text)).alias(name)).where(F.col(name) != "").distinct().withColumn(grams, cut(F.col(name))), "texts")


def fuzzy(index: DataFrame, queries: DataFrame, least: float = SIMILAR, k: int = 30) -> DataFrame:
    """(query, id, score, rank): the k texts nearest each query by Jaccard similarity of their trigrams."""
    t, q = unique(index, "text", "t", "ts", trigrams), unique(queries, "query", "q", "qs", trigrams)
    s = candidates(q, t, least, True).select("q", "t", F.round(overlap(F.col("qs"), F.col("ts")), 6).alias("score")).where(F.col("score") >= least)
    return top(spread(s, index, queries, ["score"], k), ["query"], [F.desc("score"), F.asc("id")], k)


def similar_words(index: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """(query, id, similarity, word_similarity, score, rank): texts similar as a whole or in a stretch, by the greater of both.

    A text is kept if its similarity is at least SIMILAR or that of its best stretch at least WORD_SIMILAR.
    """
    sets = lambda c: F.array_distinct(word_trigrams(c))
    t, q = unique(index, "text", "t", "ts", sets), unique(queries, "query", "q", "qs", sets)
    pairs = candidates(q, t, SIMILAR, True).select("q", "qs", "t", "ts").unionByName(candidates(q, t, WORD_SIMILAR, False).select("q", "qs", "t", "ts")).dropDuplicates(["q", "t"])
    s = pairs.select("q", "t", F.round(overlap(F.col("qs"), F.col("ts")), 6).alias("similarity"), F.round(best_stretch(F.col("qs"), word_trigrams(F.col("t"))), 6).alias("word_similarity"))
    s = s.where((F.col("similarity") >= SIMILAR) | (F.col("word_similarity") >= WORD_SIMILAR)).withColumn("score", F.greatest("similarity", "word_similarity"))
    found = spread(s, index, queries, ["score", "similarity", "word_similarity"])
    return top(found, ["query"], [F.desc("score"), F.asc("id")], k)
