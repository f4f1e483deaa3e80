"""Event operators: each works on a batch table and on a stream of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; `late` sets the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """One row per key; on a stream, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def rate_limited(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Whether each request is over the limit of its moving window; refused requests count."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("refused", F.col("in_window") > limit)


def retained(events: DataFrame, now: str, days: int) -> DataFrame:
    return events.where(F.col("ts") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))


def enriched(events: DataFrame, users: DataFrame) -> DataFrame:
    """Stream-static join: events with what is known of their users."""
    return events.join(users, "user_id", "left")


def write_new(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run a stream over what is there now into Parquet; a restart goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
