"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node that links reach; a node without links has no row.

    links: (a, b) of any one orderable type.  Alternating large-star and small-star rounds keep one
    link a node and halve the depth of the trees; each round is written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    links = staged(links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        both = links.select("a", "b").union(links.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a node links to the least node around it.
        large = both.where(b > a).join(least, a == F.col("node")).select(F.col("m").alias("a"), "b").where(a < b).distinct()
        # Small star: a node and its smaller neighbours link to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low.withColumnRenamed("b", "node"), b == F.col("node"))
        new = small.select(F.col("m").alias("x"), a.alias("y")).union(small.select(F.col("m").alias("x"), b.alias("y"))).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = staged(new, "links")
        # Done when every b has one a and no a is a b: all trees are stars.
        deep = new.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() or new.join(new.select(a.alias("top")), b == F.col("top"), "left_semi").limit(1).count()
        links = new
        if not deep:
            return links.select(b.alias("node"), a.alias("root")).union(links.select(a.alias("node"), a.alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
