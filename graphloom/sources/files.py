"""Readers of public file formats as tables.

Every reader cuts files into records with a separator that Spark's own readers know, so large plain files are read
in several byte ranges and a record over a border is read once, by the range in which it begins; compressed files are
one range each.  Rows that do not parse are kept with `bad` set, to be counted and not lost (see `faults`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import staged


def faults(df: DataFrame) -> DataFrame:
    """(rows, bad): how many records there are and how many did not parse; parsed rows are kept for it in the shared folder."""
    return staged(df, "parsed").agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("bad"))


def lines_of(record: Column) -> Column:
    return F.split(record, r"\r?\n")


# OBO stanzas ----------------------------------------------------------------------------------------


def tag_values(lines: Column, tag: str) -> Column:
    """The values of all `tag: value` lines, without trailing comments and modifiers."""
    values = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(f"{tag}: "))), lambda x: F.substring(x, len(tag) + 3, 1 << 30))
    return F.transform(values, lambda x: F.trim(F.regexp_replace(x, r"\s(?:\{[^}]*\}\s*)?!.*$|\s\{[^}]*\}\s*$", "")))


def quoted(values: Column) -> Column:
    """The quoted text that begins each value, its escapes undone."""
    return F.transform(values, lambda x: F.regexp_replace(F.regexp_extract(x, r'^"((?:[^"\\]|\\.)*)"', 1), r"\\(.)", "$1"))


def obo(spark: SparkSession, path: str, kind: str = "Term") -> DataFrame:
    """(id, name, namespace, definition, parents, synonyms, xrefs, alt_ids, part_of, obsolete, bad) of each stanza.

    Records begin at a line that opens with a bracket.  bad: no id, or two of them.
    """
    records = spark.read.option("lineSep", "\n[").text(path)
    stanza = records.where(F.regexp_extract(F.ltrim("value"), r"^\[?(\w+)\]", 1) == kind)
    lines = stanza.select(lines_of(F.col("value")).alias("lines"))
    one = lambda tag: F.try_element_at(tag_values(F.col("lines"), tag), F.lit(1))
    every = lambda tag: tag_values(F.col("lines"), tag)
    parts = F.transform(F.filter(every("relationship"), lambda x: F.startswith(x, F.lit("part_of "))), lambda x: F.substring_index(x, " ", -1))
    xrefs = F.transform(every("xref"), lambda x: F.substring_index(x, " ", 1))
    return lines.select(
        one("id").alias("id"),
        one("name").alias("name"),
        one("namespace").alias("namespace"),
        F.try_element_at(quoted(every("def")), F.lit(1)).alias("definition"),
        every("is_a").alias("parents"),
        F.filter(quoted(F.transform(F.filter(F.col("lines"), lambda x: F.startswith(x, F.lit("synonym: "))), lambda x: F.substring(x, 10, 1 << 30))), lambda x: x != "").alias("synonyms"),
        xrefs.alias("xrefs"),
        every("alt_id").alias("alt_ids"),
        parts.alias("part_of"),
        F.array_contains(every("is_obsolete"), "true").alias("obsolete"),
        (F.size(every("id")) != 1).alias("bad"),
    )


# Tab-separated tables -------------------------------------------------------------------------------


def delimited(spark: SparkSession, path: str, columns: list[str], separator: str = "\t", comment: str | None = None, skip: str | None = None, header: bool = False) -> DataFrame:
    """All columns as strings (empty is null) and `bad`: rows with more or fewer fields than columns.

    comment: lines that begin with it go; skip: a pattern of other lines to leave out (preambles, rulers); header: a line
    that equals the columns' names goes, with or without a leading hash, wherever it stands in the file.
    """
    lines = spark.read.text(path).where(F.col("value") != "")
    if comment is not None:
        lines = lines.where(~F.startswith("value", F.lit(comment)))
    if skip is not None:
        lines = lines.where(~F.col("value").rlike(skip))
    if header:
        lines = lines.where(F.regexp_replace("value", r"^#\s*|\r$", "") != separator.join(columns))
    cells = F.split(F.regexp_replace("value", r"\r$", ""), F.lit("\\Q" + separator + "\\E"), -1)
    row = lines.select(cells.alias("cells"))
    return row.select(*(F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(columns)), (F.size("cells") != len(columns)).alias("bad"))


def comma_separated(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """Quoted CSV after a preamble: only rows whose `key` column holds something other than its name or a ruler are data."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _broken string"
    rows = spark.read.schema(schema).option("escape", '"').option("columnNameOfCorruptRecord", "_broken").csv(path)
    ruler = F.col(key).rlike(r"^[+*=\-\s]*$") | (F.lower(F.col(key)) == key.lower())
    return rows.where(F.col(key).isNotNull() & ~ruler).withColumn("bad", F.col("_broken").isNotNull()).drop("_broken")


def several(value: Column, separator: str = "|") -> Column:
    """The parts of a multi-valued field, trimmed, empty ones left out; null gives none."""
    parts = F.split(F.coalesce(F.regexp_replace(value, '^"|"$', ""), F.lit("")), F.lit("\\Q" + separator + "\\E"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


GAF = ["db", "object_id", "symbol", "qualifier", "term", "reference", "evidence", "with_from", "aspect", "name", "synonyms", "type", "taxon", "date", "assigned_by", "extension", "form"]


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of the GAF 2 format with `negated` and `synonyms`, `references` as arrays; comment lines begin with `!`.

    bad: not 15 to 17 fields, or no object or term.
    """
    lines = spark.read.text(path).where((F.col("value") != "") & ~F.startswith("value", F.lit("!")))
    cells = lines.select(F.split(F.regexp_replace("value", r"\r$", ""), "\t", -1).alias("cells"))
    got = cells.select(*(F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(GAF)), F.size("cells").alias("n"))
    negated = F.array_contains(several(F.col("qualifier")), "NOT")
    bad = ~F.col("n").between(15, 17) | F.col("object_id").isNull() | F.col("term").isNull()
    return got.select(*(c for c in GAF if c not in ("synonyms", "reference")), several(F.col("synonyms")).alias("synonyms"), several(F.col("reference")).alias("references"), negated.alias("negated"), bad.alias("bad"))


# XML and JSON ---------------------------------------------------------------------------------------


def xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """One row an element of that name, with `bad` for those that do not fit the schema."""
    df = spark.read.format("xml").option("rowTag", row).option("columnNameOfCorruptRecord", "_broken").schema(schema + ", _broken string").load(path)
    return df.withColumn("bad", F.col("_broken").isNotNull()).drop("_broken")


GRAPH = "graphs array<struct<nodes:array<struct<id:string,lbl:string,type:string,meta:struct<deprecated:boolean,definition:struct<val:string>,synonyms:array<struct<pred:string,val:string>>,xrefs:array<struct<val:string>>>>>,edges:array<struct<sub:string,pred:string,obj:string>>>>"


def ontology_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ontology graphs in JSON; a file is one JSON value, so files and not ranges are read side by side."""
    graphs = spark.read.schema(GRAPH).option("multiLine", True).json(path).select(F.explode("graphs").alias("g"))
    curie = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), "^([A-Za-z]+)_", "$1:")
    n = graphs.select(F.explode("g.nodes").alias("n"))
    values = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: x["val"])
    nodes = n.select(curie(F.col("n.id")).alias("id"), F.col("n.lbl").alias("name"), F.col("n.meta.definition.val").alias("definition"), values("n.meta.synonyms").alias("synonyms"), values("n.meta.xrefs").alias("xrefs"), F.coalesce("n.meta.deprecated", F.lit(False)).alias("obsolete"), (F.col("n.id").isNull()).alias("bad"))
    edges = graphs.select(F.explode("g.edges").alias("e")).select(curie(F.col("e.sub")).alias("child"), F.regexp_extract("e.pred", r"([^/#]+)$", 1).alias("relation"), curie(F.col("e.obj")).alias("parent"))
    return nodes, edges
