"""Dense positions in a global order, and positions within groups, without a single-task window.

Rows are range-partitioned by the order, so equal shares of them, also of one
huge group, lie on each task. A row's position is its place in its partition
plus the rows of the partitions before; only one count for each partition
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triloom.operators import skew
from triloom.session import local_table, written

_SHIFT = 33  # partition number and place in a monotonically increasing id


def _offsets(counts: dict[int, int]) -> list[tuple[int, int]]:
    out, before = [], 0
    for part in sorted(counts):
        out.append((part, before))
        before += counts[part]
    return out


def globally_indexed(df: DataFrame, order: Sequence[Column], into: str = "gidx", running: tuple[str, str] | None = None) -> DataFrame:
    """Adds each row's position (from 0) in the order, as a written table. Ties get positions in any order.

    With `running` = (column, name) also the sum of the column over all rows up
    to and with this one; the column is a whole number without nulls.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    t = written(placed, "ordered").withColumn("__part", F.shiftright("__m", _SHIFT)).withColumn("__at", F.col("__m").bitwiseAND(F.lit((1 << _SHIFT) - 1)))
    sums = [F.count("*").alias("n")] + ([F.sum(running[0]).alias("s")] if running else [])
    parts = t.groupBy("__part").agg(*sums).collect()  # one row for each partition
    rows = [(p, o, s) for (p, o), (_, s) in zip(_offsets({r["__part"]: r["n"] for r in parts}), _offsets({r["__part"]: r["s"] if running else 0 for r in parts}), strict=True)]
    look = local_table(spark, rows, "__part bigint, __before bigint, __sum bigint")
    t = t.join(F.broadcast(look), "__part").withColumn(into, F.col("__before") + F.col("__at"))
    if running:
        upto = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        t = t.withColumn(running[1], F.col("__sum") + F.sum(running[0]).over(upto))
    return t.drop("__m", "__part", "__at", "__before", "__sum")


def indexed_within(df: DataFrame, group: str, order: Sequence[Column], into: str = "idx", size: str = "size", weight: str | None = None) -> DataFrame:
    """Adds each row's position in its group (from 0) and the group's rows.

    With `weight` (a whole number) also `cum_w`, the sum of weights up to and
    with the row, and `tot_w`, the group's. A group with a third of all rows is
    spread over the tasks like any other rows.
    """
    g = globally_indexed(df, [F.col(group), *order], "__g", (weight, "__run") if weight else None)
    first = [F.min("__g").alias("__first"), F.count("*").alias(size)]
    if weight:
        first += [F.sum(weight).alias("tot_w"), F.min(F.col("__run") - F.col(weight)).alias("__base")]
    stats = written(g.groupBy(F.col(group).alias("__grp")).agg(*first), "group-stats")
    rows = stats.agg(F.sum(size)).first()[0] or 0
    plan = skew.plan_from_counts(stats, "__grp", size, rows)
    out = skew.join_by_key(g, stats, F.col(group), F.col("__grp"), plan=plan, spread=[F.col("__g")])
    out = out.withColumn(into, F.col("__g") - F.col("__first"))
    if weight:
        out = out.withColumn("cum_w", F.col("__run") - F.col("__base"))
    return out.drop("__g", "__grp", "__first", "__run", "__base")
