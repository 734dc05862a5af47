"""Triples as a stream: files that arrive are parsed, new words get tokens, and edges are appended.

The word table grows and tokens never change. A batch's effects are written
under its number, so a batch that is run again after a failure overwrites what
it had written and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triloom.operators import vocab
from triloom.operators.ranking import globally_indexed
from triloom.session import exists, scope, written

WORDS = "token int, word string, batch bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_batch(triples: DataFrame, batch: int, folder: str) -> None:
    """Adds the words and edges of one batch to the tables `words` and `edges` of the folder."""
    spark = triples.sparkSession
    with scope():
        t = written(vocab.complete(triples).select(*vocab.TRIPLE), "batch")
        terms = written(vocab.terms(t), "batch-terms")
        known = _read(spark, f"{folder}/words", WORDS).where(F.col("batch") < batch)
        last = known.agg(F.max("token")).first()[0]
        old = written(known.join(terms, "word", "left_semi").select("token", "word"), "batch-known")  # what follows reads only the batch's words
        fresh = globally_indexed(terms.join(old, "word", "left_anti"), [F.col("word")], "i")
        new = written(fresh.select((F.col("i") + (0 if last is None else last + 1)).cast("int").alias("token"), "word"), "batch-new")
        new.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/words")
        edges = vocab.encoded(t, old.unionByName(new)).withColumn("batch", F.lit(batch))
        edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/edges")


def ingest(source: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream; `source` is a streaming DataFrame with the three term columns. All files there are taken, then it ends."""
    return source.writeStream.foreachBatch(lambda df, i: append_batch(df, i, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_predicates(source: DataFrame, time: str = "loaded_at", late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """(window, predicate, edges): a windowed count with a watermark; rows later than `late` behind the newest are left out."""
    return source.withWatermark(time, late).groupBy(F.window(time, width), "predicate").agg(F.count("*").alias("edges"))


