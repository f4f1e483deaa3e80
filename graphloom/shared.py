"""Tables kept between rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in local mode, where the session may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        holder = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = holder.get() if holder.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *key: str, each: int = 1 << 18) -> DataFrame:
    """df by key in tasks of about `each` of its `rows` rows, so that a task does not grow with the table."""
    return df.repartition(max(1, -(-rows // each)), *key)


def in_order(df: DataFrame, *key: str | Column) -> tuple[DataFrame, int]:
    """df with `no`, the number of each row (int, from 0) in the order of a key without repeats, and how many rows it has."""
    s = staged(df.orderBy(*key).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    sizes = s.groupBy(F.shiftright("_at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # one row a range
    firsts, n = [], 0
    for r in sizes:
        firsts.append((r["range"], n))
        n += r["n"]
    before = s.sparkSession.createDataFrame(firsts, "_range long, _before long")
    no = (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int")
    return s.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_range")).select(*df.columns, no.alias("no")), n


def placed(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """df with `place`, the number of each row (from 0) among the rows of its key in the given total order.

    Rows are dealt by ranges of key and order, so a large key lies in several tasks; a row's number is its number
    within its range plus the rows of the key in the ranges before, of which there is one sum a range and key.
    """
    low = F.lit((1 << 33) - 1)
    rows = staged(df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(low))
    first = rows.groupBy("_range", *key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_key{i}" for i, k in enumerate(key)}
    offsets = first.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(F.col("_range").alias("_in"), *(F.col(k).alias(n) for k, n in names.items()), "_first", "_before")
    j = rows.join(offsets, [F.col("_range") == F.col("_in"), *(F.col(k).eqNullSafe(F.col(n)) for k, n in names.items())])
    return j.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"))
