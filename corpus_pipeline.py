"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Nulls: a null text fails the quality rules, so no later stage meets one; rows with a null or repeated
doc_id are told apart by their texts.  Of equal rows, and of near duplicates, the one of the least id
(then of the least text hash) stays.  Extra columns, whatever their names, go through all stages but
the last.  An empty table gives an empty result; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import best_fit_packing, decontamination, line_dedup, quality_rules, similar_sets, simhash_neardup
from graphloom.llm.common import read, staged
from graphloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier one go; the documents stay."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash fingerprints within 4 bits (op5's), or Jaccard 0.8 or more, which fingerprints cannot promise."""
    return similar_sets.keep_first(docs, prints=staged(simhash_neardup.row_fingerprints(docs), "near-fingerprints"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, placed in sequences."""
    return best_fit_packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("best-fit packing", packing)]

#: The stages cannot be said in SQL; tests/llm holds their operators against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
