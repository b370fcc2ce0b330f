import __spark_entry__ as entry


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    from strideway.streaming import windows

    rows = [("a", "b", "2024-01-01 00:00:10"), ("a", "b", "2024-01-01 00:00:50"), ("b", "c", "2024-01-01 00:05:00"), ("c", "d", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "src string, dst string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, dst string, ts timestamp").parquet(str(tmp_path / "in"))
    q = windows.window_networks(stream, "1 minute", "1 minute").writeStream.format("memory").queryName("nets").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["src"], r["dst"]): r["w"] for r in spark.table("nets").collect()}
    assert got == {("a", "b"): 2, ("b", "c"): 1}
