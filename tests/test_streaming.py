from conftest import rows

from triloom.streaming.ingest import append_batch, hourly_predicates, ingest

SCHEMA = "subject string, predicate string, object string"


def test_batches_append_words_and_may_be_run_again(spark, tmp_path):
    folder = str(tmp_path / "kg")
    one = spark.createDataFrame([("b", "p", "a"), (None, "p", "a")], SCHEMA)
    two = spark.createDataFrame([("a", "p", "c")], SCHEMA)
    append_batch(one, 0, folder)
    append_batch(two, 1, folder)
    append_batch(two, 1, folder)
    words = dict(rows(spark.read.parquet(f"{folder}/words"), "word", "token"))
    assert words == {"a": 0, "b": 1, "p": 2, "c": 3}
    assert rows(spark.read.parquet(f"{folder}/edges"), "subject", "predicate", "object", "batch") == [(0, 2, 3, 1), (1, 2, 0, 0)]


def test_stream_of_files(spark, tmp_path):
    spark.createDataFrame([("x", "p", "y")], SCHEMA).write.parquet(str(tmp_path / "in/a"))
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = ingest(source, str(tmp_path / "kg"), str(tmp_path / "check"))
    q.awaitTermination()
    spark.createDataFrame([("y", "p", "z")], SCHEMA).write.parquet(str(tmp_path / "in/b"))
    ingest(source, str(tmp_path / "kg"), str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "kg/words")), "word") == [("p",), ("x",), ("y",), ("z",)]
    assert spark.read.parquet(str(tmp_path / "kg/edges")).count() == 2


def test_windowed_count_drops_late_rows(spark, tmp_path):
    schema = "predicate string, loaded_at timestamp"
    src = str(tmp_path / "in")
    for i, (p, t) in enumerate([("p", "2030-01-01 00:10:00"), ("p", "2030-01-01 09:00:00"), ("late", "2030-01-01 00:20:00"), ("p", "2030-01-01 23:00:00")]):
        spark.createDataFrame([(p, t)], "predicate string, t string").selectExpr("predicate", "CAST(t AS TIMESTAMP) AS loaded_at").write.parquet(f"{src}/{i}")
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        out = hourly_predicates(s).select("predicate", "edges").writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        out.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("p", 1), ("p", 1)]
