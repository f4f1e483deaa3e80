"""The event operators as streams over files."""

from pyspark.sql import functions as F

from graphloom.streaming import events as E


def test_tumbling_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = E.tumbling(stream, "1 day", "40 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("tumbled").collect()))
    assert got == sorted(map(tuple, E.tumbling(rows).collect())) and got


def test_dedupe_stream_writes_each_key_once(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.union(rows.limit(50)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    E.write_new(E.deduplicated(stream, ["event_id"], "40 days"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == rows.count()
