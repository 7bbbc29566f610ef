from pyspark.sql import functions as F

from corpusloom.streaming import incremental as I


def test_micro_batches_equal_one_batch(spark, tmp_path):
    rows = [(1, "Same text."), (2, "same text"), (3, "other"), (4, "SAME TEXT!"), (5, "new"), (6, "other")]
    source = str(tmp_path / "in")
    for i in range(0, 6, 2):
        spark.createDataFrame(rows[i : i + 2], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    I.stream_settle(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("status = 'kept'").count() == 3 and got.count() == 6
    assert got.where("status = 'duplicate' and main_id is null").count() == 0
    unique = I.drain(I.stream_exact(spark.readStream.schema("doc_id long, text string").parquet(source)), "unique_rows", str(tmp_path / "s2"))
    assert unique.count() == 5


def test_windows_and_operations(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:35:00", "a", 2.0), (1, "2024-01-01 02:00:00", "b", 4.0)], "user_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r["n"] for r in I.tumbling(events).collect()) == [1, 2]
    assert sorted(r["n"] for r in I.sliding(events).collect()) == [1, 1, 2, 2]
    assert sorted(r["n"] for r in I.sessions(events).collect()) == [1, 2]
    sources = spark.createDataFrame([("a", "packed", "x", None), ("b", "packed", "y", True), ("c", "packed", "z", None)], "source_id string, status string, text string, verified boolean")
    ops = spark.createDataFrame([("a", "verify", None, 1, 1), ("a", "replace", "new", 2, 2), ("b", "delete", None, 1, 3)], "source_id string, op string, value string, at int, no int")
    assert {r["source_id"]: (r["status"], r["text"]) for r in I.apply_operations(sources, ops).collect()} == {"a": ("extracted", "new"), "c": ("packed", "z")}
    outputs = spark.createDataFrame([("p1", "a"), ("p2", "c")], "path string, source_id string")
    gone = I.missing_outputs(sources.withColumn("reason", F.lit(None).cast("string")), outputs, spark.createDataFrame([("p2",)], "path string"))
    assert {r["source_id"]: r["status"] for r in gone.collect()} == {"a": "skipped", "b": "packed", "c": "packed"}
    assert I.pending(sources, spark.createDataFrame([("a",)], "source_id string")).count() == 2
