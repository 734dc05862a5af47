"""Writing triples, embeddings and summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _term(c: Column) -> Column:
    """An IRI in brackets; blank nodes and quoted literals as they are; any other text as a quoted literal."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"'), "\n", r"\\n"), "\r", r"\\r"), F.lit('"'))
    return F.when(c.rlike(r"^(?:https?://|urn:)[^\s<>\"{}|\\^`]+$"), F.concat(F.lit("<"), c, F.lit(">"))).when(c.rlike(r'^_:[A-Za-z0-9]+$|^"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^<>]+>)?$'), c).otherwise(quoted)


def triple_lines(triples: DataFrame) -> DataFrame:
    """(value): triples without nulls as N-Triples lines, which are Turtle too."""
    t = triples.dropna(subset=["subject", "predicate", "object"])
    resource = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    return t.select(F.concat_ws(" ", resource("subject"), F.concat(F.lit("<"), F.col("predicate"), F.lit(">")), _term(F.col("object")), F.lit(".")).alias("value"))


def write_triples(triples: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Triples as parquet, orc, csv, nt or ttl; another format is a ValueError."""
    if file_format in ("parquet", "orc"):
        triples.write.mode("overwrite").format(file_format).save(path)
    elif file_format == "csv":
        triples.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif file_format in ("nt", "ttl"):
        triple_lines(triples).write.mode("overwrite").text(path)
    else:
        raise ValueError("format must be parquet, orc, csv, nt or ttl")


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.write.mode("overwrite").parquet(path)


def write_summary(runs: DataFrame, path: str, by: list[str], value: str) -> DataFrame:
    """Extremes, mean, deviation and number of `value` for each group, as CSV; the summary is returned too."""
    s = runs.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count("*").alias("runs"))
    s.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # one row for each group of runs
    return s


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    """A small driver-side document, where Spark writes."""
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
