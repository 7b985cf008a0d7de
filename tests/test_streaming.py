from pyspark.sql import functions as F

from tessera.operators import windows
from tessera.streaming.append import event_windows, stream_windows


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 2).alias("series_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 37 / 4).alias("value"))
    for k in range(4):
        rows.where((F.col("ts").cast("long") >= 250 * k) & (F.col("ts").cast("long") < 250 * (k + 1))).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{tmp_path}/in")
    q = stream_windows(stream, "ts").writeStream.format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = windows.decode(spark.table("w")).select("series_id", "pos", "value").collect()
    want = windows.decode(windows.build(rows.select("series_id", F.floor(F.col("ts").cast("long") / 2).alias("pos"), "value"))).where("pos < 384").select("series_id", "pos", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 768


def test_event_windows(spark, tmp_path):
    rows = spark.range(100).select(F.lit("s").alias("series_id"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/in")
    q = event_windows(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("e").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["min"]) for r in spark.table("e").collect()) == [(10, 90.0), (30, 0.0), (30, 30.0), (30, 60.0)]
