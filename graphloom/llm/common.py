"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and TAB..CR. `bytes.split()` uses the same set.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
#: Stands for a null document id inside the operators: it sorts after every real id.
NULL_KEY = 2**63 - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(key, text): the id as long with nulls last, the text with null as empty; other columns go."""
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_KEY)).alias("key"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )


def text_id(docs: DataFrame) -> Column:
    """Tells texts of one id apart: a row is known by its key and this."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def row_number(key: int, text: str) -> int:
    """A signed 64-bit number of a row, from its key and text."""
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "big", signed=True) + text.encode(), 7)
    return h - (1 << 64) if h >> 63 else h


def doc_id_of(key: Column) -> Column:
    """The inverse of the key: the null stand-in becomes null again."""
    return F.when(key != NULL_KEY, key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none (tests)."""
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
    spark = df.sparkSession
    release(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now and not at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, to size partitions in proportion to the input."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(total: int, each: int) -> int:
    return max(1, -(-total // each))


def sliced(rows, max_bytes: int):
    """Cut one Arrow batch into slices of about max_bytes, so that Python holds little at once."""
    if not rows.num_rows:
        return
    step = max(1, int(rows.num_rows * max_bytes // max(1, rows.nbytes)))
    for at in range(0, rows.num_rows, step):
        yield rows.slice(at, step)
