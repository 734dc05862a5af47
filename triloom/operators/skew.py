"""Per-key results where a few keys hold most rows: fragment and replicate by estimated load.

1. One pass with mergeable heavy-hitter sketches estimates the rows of the
   heaviest keys (`estimate_load`). As many keys are followed as can lie above
   the split limit, so the sketch grows with the tasks, not with the data.
2. The driver splits every key above a share of a task's even load into
   proportionate shards and bin-packs the shards, largest first, onto the least
   loaded of the reduce tasks that their candidate salts lead to
   (`plan_from_loads`). A shard has a fixed number of candidates, whose hashes
   the driver computes as Spark's shuffle does, so the plan is linear in shards.
3. Keys under the limit are not planned: each is less than `split_share` of a
   task's load, and they go where their hash leads, with the salt 0.
4. Rows get the salt of their key's shard (`with_shard`). Aggregates combine
   before the shuffle by (key, salt) and merge a key's shards afterwards
   (`aggregate_by_key`). Joins shuffle by (key, salt) and copy of the other
   side only the rows of split keys, once for each of their shards
   (`join_by_key`).

A salt only steers where rows go: results don't depend on the estimates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.session import local_table

KEY, SALT = "__key", "__salt"
CANDIDATES = 16  # salts that are tried for each shard
MOST_TRACKED = 1_000_000  # what Spark's sketch allows
_GROUPS = 64  # partial sketches that one task merges


@dataclass
class ShardPlan:
    """The salts of each split or placed key. `rows` counts all rows, those with a null key too."""

    rows: int
    tasks: int
    loads: dict = field(default_factory=dict)
    salts: dict = field(default_factory=dict)
    places: dict = field(default_factory=dict)

    def shards(self, key: object) -> int:
        return len(self.salts.get(key, [0]))


def hash_int(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Spark's 32-bit Murmur3 of whole numbers (int), from the hash of what stands before them."""
    u = lambda x: np.asarray(x).astype(np.int64).astype(np.uint32)
    with np.errstate(over="ignore"):
        k = u(values) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = u(seed) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).astype(np.int32)


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _tracked(tasks: int, split_share: float) -> tuple[int, int]:
    """Keys that may lie above the limit, and items a sketch has to follow so that its error (about 4 / items) is an eighth of the limit."""
    keys = math.ceil(tasks / split_share)
    return keys, max(10_000, 32 * keys)


def estimate_loads(df: DataFrame, keys: dict[str, Column], tasks: int, split_share: float = 0.5) -> tuple[int, dict[str, dict]]:
    """Number of rows, and for each named key the estimated rows of its heaviest values, null included, from one pass.

    Partial sketches of tasks are merged in two rounds. With so many tasks that
    Spark's sketch is too small (above 15,625) keys are counted exactly.
    """
    most, items = _tracked(tasks, split_share)
    if items > MOST_TRACKED:
        rows = df.count()
        limit = rows / tasks * split_share
        exact = {n: {r[KEY]: r["n"] for r in df.select(k.alias(KEY)).groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") >= limit).collect()} for n, k in keys.items()}
        return rows, exact
    cols = df.select(*[k.alias(n) for n, k in keys.items()])
    near = cols.groupBy(F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("__g")).agg(*[F.expr(f"approx_top_k_accumulate(`{n}`, {items})").alias(n) for n in keys], F.count("*").alias("__n"))
    whole = near.groupBy(F.lit(1)).agg(*[F.expr(f"approx_top_k_combine(`{n}`, {items})").alias(n) for n in keys], F.sum("__n").alias("__n"))
    r = whole.select(*[F.expr(f"approx_top_k_estimate(`{n}`, {most})").alias(n) for n in keys], "__n").first()
    return (r["__n"], {n: {x["item"]: x["count"] for x in r[n] or []} for n in keys}) if r else (0, {n: {} for n in keys})


def estimate_load(df: DataFrame, key: Column, tasks: int | None = None, split_share: float = 0.5) -> tuple[int, dict]:
    """As `estimate_loads`, of one key."""
    rows, loads = estimate_loads(df, {KEY: key}, tasks or tasks_of(df.sparkSession), split_share)
    return rows, loads[KEY]


def plan_each(df: DataFrame, keys: dict[str, Column], tasks: int | None = None, split_share: float = 0.5) -> dict[str, ShardPlan]:
    """A plan for each named key, all from one pass."""
    tasks = tasks or tasks_of(df.sparkSession)
    rows, loads = estimate_loads(df, keys, tasks, split_share)
    kinds = {n: df.select(k.alias(n)).schema[n].dataType.simpleString() for n, k in keys.items()}
    return {n: plan_from_loads(df.sparkSession, rows, loads[n], kinds[n], tasks, split_share) for n in keys}


def plan_shards(df: DataFrame, key: Column, tasks: int | None = None, split_share: float = 0.5) -> ShardPlan:
    """Estimates loads, splits keys above `split_share` of a task's even load, bin-packs the shards and finds their salts."""
    return plan_each(df, {KEY: key}, tasks, split_share)[KEY]


def plan_from_loads(spark: SparkSession, rows: int, loads: dict, kind: str, tasks: int | None = None, split_share: float = 0.5) -> ShardPlan:
    """The plan for known or estimated loads of the heaviest keys, whose type is `kind`; keys under the split limit are left out."""
    tasks = tasks or tasks_of(spark)
    plan = ShardPlan(rows, tasks, loads)
    limit = max(1.0, rows / tasks * split_share)
    heavy = sorted(((k, n) for k, n in loads.items() if n >= limit), key=lambda x: (-x[1], repr(x[0])))
    if not heavy or tasks < 2:
        return plan
    cut = [(n / s, k, s) for k, n in heavy for s in [min(tasks, -(-n // int(limit)))]]
    keys = local_table(spark, [(k,) for _, k, _ in cut], f"{KEY} {kind}")
    seeds = [r[0] for r in keys.select(F.hash(KEY)).collect()]  # one number for each key above the limit
    held = np.full(tasks, (rows - sum(n for _, n in heavy)) / tasks)  # what the other keys bring to every task
    for i in sorted(range(len(cut)), key=lambda i: -cut[i][0]):
        load, k, shards = cut[i]
        salts = np.arange(1, CANDIDATES * shards + 1)
        to, first = np.unique(np.mod(hash_int(salts, seeds[i]).astype(np.int64), tasks), return_index=True)
        take = np.argsort(held[to], kind="stable")[:shards]
        held[to[take]] += load
        plan.salts[k], plan.places[k] = salts[first[take]].tolist(), to[take].tolist()
    return plan


def plan_from_counts(counts: DataFrame, key: str, n: str, rows: int, split_share: float = 0.5) -> ShardPlan:
    """The plan for a table of counts for each key. Only keys above the split limit reach the driver: at most tasks / `split_share`."""
    spark = counts.sparkSession
    tasks = tasks_of(spark)
    heavy = counts.where((F.col(n) >= max(1.0, rows / tasks * split_share)) & F.col(key).isNotNull()).groupBy(key).agg(F.sum(n).alias("n"))
    return plan_from_loads(spark, rows, {r[key]: r["n"] for r in heavy.collect()}, counts.schema[key].dataType.simpleString(), tasks, split_share)


def _lookup(df: DataFrame, plan: ShardPlan) -> DataFrame:
    """The plan as a table to broadcast: at most tasks / `split_share` keys, with at most tasks + keys salts among them."""
    kind = df.schema[KEY].dataType.simpleString()
    return local_table(df.sparkSession, [(k, s) for k, s in plan.salts.items()], f"__k {kind}, __salts array<int>")


def with_shard(df: DataFrame, key: Column, plan: ShardPlan, spread: Sequence[Column] | None = None) -> DataFrame:
    """Adds the key and its shard's salt as `__key` and `__salt`.

    `spread` are columns that tell rows of a key apart (an id); without them
    all columns are taken. A row's shard follows from its content alone, so a
    task that is run again deals rows out as before. Equal rows share a shard:
    aggregates combine them before the shuffle, joins leave them to adaptive
    splitting.
    """
    by = F.xxhash64(*(spread or [F.col(f"`{c}`") for c in df.columns]))
    df = df.withColumn(KEY, key)
    if not plan.salts:
        return df.withColumn(SALT, F.lit(0))
    df = df.withColumn("__by", by)
    joined = df.join(F.broadcast(_lookup(df, plan)), F.col(KEY).eqNullSafe(F.col("__k")), "left")
    salt = F.coalesce(F.element_at("__salts", (F.pmod("__by", F.size("__salts").cast("long")) + 1).cast("int")), F.lit(0))
    return joined.withColumn(SALT, F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(salt)).drop("__k", "__salts", "__by")


def aggregate_by_key(df: DataFrame, key: Column, partial: Sequence[Column], merge: Sequence[Column], plan: ShardPlan | None = None, spread: Sequence[Column] | None = None) -> DataFrame:
    """`__key` and the aggregates `merge` over the shards' `partial` aggregates.

    Rows are combined before the shuffle; a null key is a key like any other.
    An empty table gives no rows.
    """
    plan = plan or plan_shards(df, key)
    return with_shard(df, key, plan, spread).groupBy(KEY, SALT).agg(*partial).groupBy(KEY).agg(*merge)


def join_by_key(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "inner", plan: ShardPlan | None = None, spread: Sequence[Column] | None = None, hashed: bool = False) -> DataFrame:
    """Equi-join of the skewed `left` with `right`; of split keys the right rows are copied to each shard.

    `how` is inner, left, left_semi or left_anti: a right or full join would
    have to know in which shards a right row found no partner. Null keys match
    nothing. Columns keep their names, so clashing names stay ambiguous as in
    any join: rename them before. `hashed`, where right keys are unique and a
    task's share of them fits its memory, makes a table of them instead of
    sorting both sides.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how must be inner, left, left_semi or left_anti")
    plan = plan or plan_shards(left, left_key)
    r = right.withColumn("__rkey", right_key).where(F.col("__rkey").isNotNull())
    if plan.salts:
        look = _lookup(left.select(left_key.alias(KEY)), plan)
        r = r.join(F.broadcast(look), F.col("__rkey") == F.col("__k"), "left").withColumn("__rsalt", F.explode(F.coalesce("__salts", F.array(F.lit(0))))).drop("__k", "__salts")
    else:
        r = r.withColumn("__rsalt", F.lit(0))
    out = with_shard(left, left_key, plan, spread).join(r.hint("shuffle_hash") if hashed else r, (F.col(KEY) == F.col("__rkey")) & (F.col(SALT) == F.col("__rsalt")), how)
    return out.drop(SALT, KEY, "__rsalt", "__rkey")


def fits_broadcast(table: DataFrame) -> bool:
    """Whether a written table is small enough for Catalyst to broadcast it, by its size in bytes."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    spark = table.sparkSession
    named = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return not named.startswith("-") and size <= spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(named)


def join_measured(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "inner", spread: Sequence[Column] | None = None) -> DataFrame:
    """Equi-join of the skewed `left` with a written table: a small one is broadcast by Catalyst's own check, beyond it heavy keys are split."""
    if fits_broadcast(right):
        return left.join(right, left_key == right_key, how)
    return join_by_key(left, right, left_key, right_key, how, spread=spread)
