"""Registered queries of redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import redaction as R
from ..sources import tables as T
from .catalog import query


@query()
def redacted_documents(spark, d):
    """Spans of every whole text and the digest of what is left; check digits keep it out of SQL (see tests/test_redaction.py)."""
    found = R.redact(T.read(spark, d, "documents"), "doc_id", "text")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("spans").alias("n_spans"), listed.alias("spans"), F.sha2("text", 256).alias("text_sha256"))


@query()
def redaction_counts(spark, d):
    return R.counted(T.read(spark, d, "documents"), "text")
