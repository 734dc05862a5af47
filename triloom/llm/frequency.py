"""Occurrences and records of every distinct term, with last-seen counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.operators import skew


def term_counts(rows: DataFrame, term: str = "token", record: str = "walk_id", position: str = "pos") -> DataFrame:
    """(term, occurrences, records, last_record), one row for each distinct term that isn't null.

    Rows are hash-partitioned by term and ordered by record and position. A
    counter that remembers the last row it saw takes a row as a new occurrence
    if record or position differ, and as a new record if the record differs, so
    no set of records is held. Rows delivered twice follow each other in this
    order and count once. Heavy terms are split by record over several tasks
    (a record's rows stay together) and their counters added up. Rows with a
    null record are counted as occurrences of no record; a null position is a
    position of its own. Other columns are ignored. No rows give no rows.
    """
    rows = rows.select(F.col(term).alias("t"), F.col(record).alias("r"), F.col(position).alias("p")).where("t IS NOT NULL")
    plan = skew.plan_shards(rows, F.col("t"))
    placed = skew.with_shard(rows, F.col("t"), plan, [F.col("r")])
    seen = Window.partitionBy(skew.KEY, skew.SALT).orderBy("r", "p")
    first = F.row_number().over(seen) == 1
    other_record = first | ~F.lag("r").over(seen).eqNullSafe(F.col("r"))
    other_place = ~F.lag("p").over(seen).eqNullSafe(F.col("p"))
    marked = placed.select(skew.KEY, skew.SALT, "r", other_record.alias("new_record"), other_place.alias("new_place"))
    return (
        marked.groupBy(skew.KEY, skew.SALT)
        .agg(F.count(F.when(F.col("new_record") | F.col("new_place"), 1)).alias("o"), F.count(F.when(F.col("new_record") & F.col("r").isNotNull(), 1)).alias("n"), F.max("r").alias("l"))
        .groupBy(F.col(skew.KEY).alias(term))
        .agg(F.sum("o").alias("occurrences"), F.sum("n").alias("records"), F.max("l").alias("last_record"))
    )


def marked_terms(counts: DataFrame, vocabulary: DataFrame, records: int, term: str = "token", rare_below: int = 3, common_share: tuple[int, int] = (1, 10)) -> DataFrame:
    """All terms of `counts` and `vocabulary` with occurrences, records (0 if none) and `mark`.

    `rare`: a vocabulary term with fewer than `rare_below` occurrences.
    `common`: a term in more than the fraction `common_share` of all records.
    Else null. A term that is both (a tiny corpus) is `common`.
    """
    v = vocabulary.select(F.col(term).alias("v")).where("v IS NOT NULL").distinct()
    c = counts.join(v, counts[term] == v["v"], "full")
    c = c.select(F.coalesce(term, "v").alias(term), F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("records", F.lit(0)).alias("records"), F.col("v").isNotNull().alias("known"))
    up, down = common_share
    mark = F.when(F.col("records") * down > F.lit(records) * up, "common").when(F.col("known") & (F.col("occurrences") < rare_below), "rare")
    return c.withColumn("mark", mark)
