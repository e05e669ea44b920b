"""The stream's roll-up ends up equal to the table's."""

from pyspark.sql import functions as F

from weftnet.streaming.rollup import daily_flow


def test_stream_equals_table(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 5} 10:00:00", i % 3, 1.5 * i) for i in range(40)]
    frame = spark.createDataFrame(rows, "ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = daily_flow(stream).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily_flow(frame).collect()))
