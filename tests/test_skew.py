import time
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from triloom.operators import skew
from triloom.operators.ranking import globally_indexed, indexed_within
from triloom.session import written


@pytest.fixture(scope="module")
def skewed(spark):
    keys = ["hot"] * 4000 + ["warm"] * 1500 + [None] * 300 + [f"k{i % 900}" for i in range(4200)]
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string").repartition(5), Counter(keys)


def test_heavy_keys_are_split_and_placed_apart(skewed):
    df, counts = skewed
    plan = skew.plan_shards(df, F.col("k"))
    assert plan.rows == sum(counts.values())
    assert plan.shards("hot") == 4  # limit 1250 rows a shard, at most one for each task
    assert plan.shards("k1") == 1
    n = plan.tasks
    placed = skew.with_shard(df, F.col("k"), plan, [F.col("id")]).withColumn("task", F.pmod(F.hash(skew.KEY, skew.SALT), F.lit(n)))
    load = dict(rows(placed.groupBy("task").count()))
    assert max(load.values()) < 1.5 * plan.rows / n
    aimed = {(s, t) for s, t in zip(plan.salts["hot"], plan.places["hot"], strict=True)}
    assert set(rows(placed.where("k = 'hot'").select(skew.SALT, "task").distinct())) == aimed


def test_many_heavy_keys_are_all_seen(spark):
    df = spark.range(100_000).select((F.col("id") % 1000).alias("k"))
    plan = skew.plan_shards(df, F.col("k"), tasks=4000)
    assert len(plan.salts) == 1000
    assert {len(s) for s in plan.salts.values()} == {9}  # 100 rows in shards of at most 12.5


def test_plan_for_ten_thousand_tasks_is_fast_and_even(spark):
    tasks, began = 10_000, time.time()
    loads = {i: 60 for i in range(15_000)} | {-1: 1_000_000}
    plan = skew.plan_from_loads(spark, 2_000_000, loads, "bigint", tasks)
    assert time.time() - began < 20
    assert plan.shards(-1) == tasks
    held = Counter()
    for k, ts in plan.places.items():
        assert len(set(ts)) == len(ts)
        for t in ts:
            held[t] += loads[k] / len(ts)
    assert max(held.values()) < 2_000_000 / tasks * 1.5


def test_hashes_are_those_of_the_shuffle(spark):
    df = spark.createDataFrame([(i * 7919 - 50_000, f"k{i}") for i in range(200)], "s int, k string")
    got = df.select(F.hash("s").alias("a"), F.hash("k", "s").alias("b"), F.hash("k").alias("seed"), "s").collect()
    s = np.array([r.s for r in got])
    assert skew.hash_int(s, 42).tolist() == [r.a for r in got]
    assert skew.hash_int(s, np.array([r.seed for r in got])).tolist() == [r.b for r in got]


def test_aggregate_has_each_key_once(skewed):
    df, counts = skewed
    got = skew.aggregate_by_key(df, F.col("k"), [F.count("*").alias("n"), F.max("id").alias("m")], [F.sum("n").alias("n"), F.max("m").alias("m")])
    assert {r[0]: r[1] for r in got.collect()} == dict(counts)
    assert got.count() == len(counts)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_is_the_plain_join(spark, skewed, how):
    df, _ = skewed
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4), ("absent", 5)], "rk string, v int")
    got = skew.join_by_key(df, right, F.col("k"), F.col("rk"), how)
    want = df.join(right, F.col("k") == F.col("rk"), how)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_other_joins_are_refused(skewed):
    with pytest.raises(ValueError, match="how"):
        skew.join_by_key(skewed[0], skewed[0], F.col("k"), F.col("k"), "full")


def test_empty_and_uniform(spark):
    empty = spark.createDataFrame([], "id int, k string")
    assert skew.aggregate_by_key(empty, F.col("k"), [F.count("*").alias("n")], [F.sum("n").alias("n")]).count() == 0
    assert skew.plan_shards(empty, F.col("k")).salts == {}
    nulls = spark.createDataFrame([(None,)] * 50, "k string")
    assert rows(skew.aggregate_by_key(nulls, F.col("k"), [F.count("*").alias("n")], [F.sum("n").alias("n")])) == [(None, 50)]
    even = spark.range(1000).select((F.col("id") % 500).alias("k"))
    assert skew.plan_shards(even, F.col("k")).salts == {}


def test_repeated_rows_without_id(spark):
    same = spark.createDataFrame([("a",)] * 3000, "k string")
    got = skew.aggregate_by_key(same, F.col("k"), [F.count("*").alias("n")], [F.sum("n").alias("n")])
    assert rows(got) == [("a", 3000)]


def test_global_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i * 37 % 1009, i % 3) for i in range(1009)], "v int, w int")
    got = rows(globally_indexed(df, [F.col("v")], "i", ("w", "run")), "i", "v", "run", "w")
    assert [r[0] for r in got] == list(range(1009))
    assert [r[1] for r in got] == sorted(r[1] for r in got)
    total = 0
    for r in got:
        total += r[3]
        assert r[2] == total
    assert globally_indexed(df.limit(0), [F.col("v")]).count() == 0


def test_index_within_groups(spark):
    df = spark.createDataFrame([("a", x % 7, 1) for x in range(300)] + [("b", 5, 2), ("b", 5, 2), ("c", 1, 9)], "g string, v int, w int")
    got = rows(indexed_within(df, "g", [F.col("v")], weight="w"), "g", "idx", "size", "cum_w", "tot_w", "v")
    a = [r for r in got if r[0] == "a"]
    assert [r[1] for r in a] == list(range(300))
    assert [r[5] for r in a] == sorted(x % 7 for x in range(300))
    assert [r for r in got if r[0] != "a"] == [("b", 0, 2, 2, 4, 5), ("b", 1, 2, 4, 4, 5), ("c", 0, 1, 9, 9, 1)]


def test_measured_join_is_the_plain_join(spark, skewed):
    df, _ = skewed
    right = written(spark.createDataFrame([("hot", 1), ("k5", 3)], "rk string, v int"), "side")
    want = rows(df.join(right, F.col("k") == F.col("rk")))
    assert skew.fits_broadcast(right)
    assert rows(skew.join_measured(df, right, F.col("k"), F.col("rk"))) == want
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not skew.fits_broadcast(right)
        assert rows(skew.join_measured(df, right, F.col("k"), F.col("rk"))) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
