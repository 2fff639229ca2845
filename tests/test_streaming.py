"""The windowed counts of a stream equal those of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymer.streaming.events import windowed


def test_stream_equals_table(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 4} 0{i % 10}:00:00", "ab"[i % 2], float(i)) for i in range(40)]
    table = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    table.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    run = windowed(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in windowed(table).collect()}
