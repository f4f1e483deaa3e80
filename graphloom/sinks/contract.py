"""Contract tables and published snapshots.

A snapshot is a folder of its own with one Parquet folder a table, and a manifest with rows, bytes and SHA-256 of each
file.  It is visible only through the list of published versions, to which one row is appended after all
else is written: readers follow that list, so a torn write is never seen, and a rerun writes another folder.
Publishing is refused unless a validation of that very content passed (see `validate`).
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import wide_hash

CONTRACT = {
    "nodes": ["id", "type", "label", "description", "url", "attrs"],
    "synonyms": ["node_id", "synonym", "source"],
    "assertions": ["source_id", "target_id", "relation", "origin", "features", "tier", "source_type", "source_ref", "url", "quote", "retrieved_at", "polarity", "claim_type"],
}
REQUIRED = {"nodes": ["id"], "synonyms": ["node_id", "synonym"], "assertions": ["source_id", "target_id", "relation"]}
PUBLISHED = "version string, folder string, published_at timestamp"


class Refused(RuntimeError):
    """The gate: what was asked to be published has not passed its validation."""


def coerced(df: DataFrame, table: str) -> DataFrame:
    """The contract's columns in order, as strings, missing ones null; rows without the required ones go.

    Nodes are unique by id: of several the one with the least other values (nulls last) stays, which does not
    depend on partitions; synonyms and assertions are unique as whole rows.
    """
    columns = CONTRACT[table]
    rows = df.select(*((F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns)).dropna(subset=REQUIRED[table])
    if table != "nodes":
        return rows.distinct()
    rest = [c for c in columns if c != "id"]
    order = F.struct(*(x for c in rest for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))
    return rows.groupBy("id").agg(F.min(order).alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in rest))


def digest(tables: dict[str, DataFrame]) -> str:
    """One name for the content of all tables, whatever the order of rows and files."""
    parts = []
    for name, df in sorted(tables.items()):
        rows = df.select(F.lit(1).alias("all"), F.to_json(F.struct(*sorted(df.columns))).alias("row"))  # names every value
        one = wide_hash(rows, "all", ["row"]).drop("all")
        row = one.first()
        parts.append(f"{name}:{','.join(sorted(df.columns))}:{'/'.join(map(str, row)) if row else ''}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def validate(tables: dict[str, DataFrame], checks: dict[str, DataFrame], root: str) -> tuple[str, dict[str, int]]:
    """Count the faulty rows of each check; the outcome is kept under the digest of the tables."""
    spark = next(iter(tables.values())).sparkSession
    found = {name: df.count() for name, df in checks.items()}
    name = digest(tables)
    rows = [(name, check, n) for check, n in found.items()] or [(name, "none", 0)]
    spark.createDataFrame(rows, "digest string, rule string, faulty long").coalesce(1).write.mode("append").parquet(f"{root}/_validations")
    return name, found


def _passed(spark: SparkSession, root: str, name: str) -> bool:
    try:
        rows = spark.read.parquet(f"{root}/_validations").where(F.col("digest") == name)
    except Exception as error:  # no validation was ever written
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.max("faulty").alias("worst")).first()
    return row["n"] > 0 and row["worst"] == 0


def manifest(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(table, file, bytes, sha256, rows) of every data file, read where it lies."""
    out = None
    for name in names:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{name}")
        short = lambda c: F.substring_index(c, "/", -1)
        rows = spark.read.parquet(f"{folder}/{name}").groupBy(short(F.input_file_name()).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        one = files.select(F.lit(name).alias("table"), short(F.col("path")).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).join(rows, "file", "left").fillna(0, ["rows"]).select("table", "file", "bytes", "sha256", "rows")
        out = one if out is None else out.unionByName(one)
    return out


def publish(tables: dict[str, DataFrame], root: str, version: str, rows_a_file: int = 1_000_000) -> str:
    """Write all tables and their manifest, then list the version; the folder's path.  Refused without a passed validation."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"{root}/{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(f"{folder}/{name}")
    written = {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in tables.items()}
    if not _passed(spark, root, digest(written)):  # what was written, not what was meant
        raise Refused(f"{version}: no passed validation of this content")
    manifest(spark, folder, sorted(tables)).coalesce(1).write.parquet(f"{folder}/_manifest")
    listed = spark.range(1).select(F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.current_timestamp().alias("published_at"))
    listed.coalesce(1).write.mode("append").parquet(f"{root}/_published")
    return folder


def published(spark: SparkSession, root: str, version: str | None = None) -> str:
    """The folder of a version (of several the last), or of the last version."""
    rows = spark.read.schema(PUBLISHED).parquet(f"{root}/_published")
    rows = rows if version is None else rows.where(F.col("version") == version)
    last = rows.orderBy(F.desc("published_at"), F.desc("folder")).first()
    if last is None:
        raise LookupError(f"{version} is not published")
    return last["folder"]


def load(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a published version."""
    folder = published(spark, root, version)
    names = [r["table"] for r in spark.read.parquet(f"{folder}/_manifest").select("table").distinct().collect()]
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def damage(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """(table, file, fault) of files that are missing, added or differ from the manifest."""
    folder = published(spark, root, version)
    told = spark.read.parquet(f"{folder}/_manifest")
    names = [r["table"] for r in told.select("table").distinct().collect()]
    now = manifest(spark, folder, names).select("table", "file", F.col("sha256").alias("now"))
    j = told.join(now, ["table", "file"], "full")
    fault = F.when(F.col("sha256").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return j.select("table", "file", fault.alias("fault")).where("fault IS NOT NULL")


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """For bulk loads: the columns in order with a header, nulls as empty fields, arrays and structs as JSON."""
    kinds = dict(df.dtypes)
    out = df.select(*((F.to_json(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")).alias(c) for c in columns))
    out.write.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
