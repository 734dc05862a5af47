"""Items that appear together: an incremental table of pair counts.

`deltas` turns changed baskets into signed changes of pair counts, item counts
and the number of baskets, in one pass. `PairTable` keeps the counts in hash
buckets of a folder of the caller's and merges changes into the buckets they
reach. Each change ends with a manifest, written whole: a later process opens
the folder and goes on, and a process that dies before it leaves the counts as
they were. Association scores are given for all pairs, or recomputed for those
that the last change affects.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.operators import skew
from triloom.session import fresh_path, get_text, names, put_text, remove, written

BUCKET_ROWS = 2_000_000
_STATE = "a int, b int, n bigint, bucket int, kind int"  # kind 0: a pair a < b; 1: an item a = b
_CHANGE = "a int, b int, d bigint, kind int"  # kind 2: the number of baskets


def _meetings(rows: DataFrame, record: str, left: str, right: str, sign: int) -> DataFrame:
    """(s, r, a, b) of rows that name a record and two items; an item is left out if null or negative."""
    r = rows.select(F.lit(sign).alias("s"), F.col(record).alias("r"), F.col(left).alias("l"), F.col(right).alias("m"))
    r = r.where("r IS NOT NULL AND l >= 0 AND m >= 0")
    return r.select("s", "r", F.least("l", "m").cast("int").alias("a"), F.greatest("l", "m").cast("int").alias("b"))


def deltas(after: DataFrame, before: DataFrame | None = None, record: str = "walk_id", left: str = "center", right: str = "context") -> DataFrame:
    """(a, b, d, kind): changes of the counts of pairs (kind 0, a < b), of items (1, a = b) and of records (2, a = b = -1), zeros left out.

    `after` holds all rows of new or changed records, `before` the rows that
    the changed or removed records had (none of them: null). A pair counts once
    for each record with a row that holds both items, in either order; an item
    once for each record with it. Rows are shuffled once, by record; each names
    its pair, its items and its record, and duplicates leave where it then is.
    A record with very many rows is split by pairs over several tasks, and what
    its parts name in common leaves in a step of its own. The counts combine
    before they are shuffled.
    """
    m = _meetings(after, record, left, right, 1)
    if before is not None:
        m = m.unionByName(_meetings(before, record, left, right, -1))
    name = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    a, b, none = F.col("a"), F.col("b"), F.lit(-1)
    alone, both = F.array(name(a, a), name(none, none)), F.array(name(a, b), name(a, a), name(b, b), name(none, none))
    plan = skew.plan_shards(m, F.col("r"))
    m = skew.with_shard(m, F.col("r"), plan, [a, b]).select(skew.KEY, skew.SALT, "s", "a", "b")
    placed = m.repartition(*([skew.KEY, skew.SALT] if plan.salts else [skew.KEY]))  # a constant salt would hide the partitioning
    named = placed.distinct().select(skew.KEY, skew.SALT, "s", F.explode(F.when(a == b, alone).otherwise(both)).alias("x")).select(skew.KEY, skew.SALT, "s", "x.a", "x.b").distinct()
    if plan.salts:
        split = named.where(F.col(skew.SALT) != 0).select(skew.KEY, F.lit(0).alias(skew.SALT), "s", "a", "b").distinct()
        named = named.where(F.col(skew.SALT) == 0).unionByName(split)
    kind = F.when(a < 0, 2).when(a == b, 1).otherwise(0)
    return named.groupBy("a", "b").agg(F.sum("s").cast("bigint").alias("d")).where("d <> 0").select("a", "b", "d", kind.alias("kind"))


class PairTable:
    """Counts of pairs and items in a folder that all executors share. Opening a folder goes on from its last manifest.

    Buckets grow in number with the rows: one has about `bucket_rows`, and when
    they hold four times that, all are written anew in four times as many. The
    folder is the caller's; nothing in it is removed but by `vacuum`. Two
    processes that change one folder at the same time: the later manifest is an
    error and its change is as if it had not been.
    """

    def __init__(self, spark: SparkSession, folder: str, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.folder, self.bucket_rows = spark, folder.rstrip("/"), bucket_rows
        manifests = [n for n in names(spark, self.folder) if n.startswith("manifest-") and n.endswith(".json")]
        s = json.loads(get_text(spark, f"{self.folder}/{manifests[-1]}")) if manifests else {"version": 0, "buckets": 0, "records": 0, "places": {}, "rows": {}, "change": None, "loads": []}
        self._take(s)

    def _take(self, s: dict) -> None:
        self.version, self.buckets, self.records, self.change, self.loads = s["version"], s["buckets"], s["records"], s["change"], s["loads"]
        self.places = {int(k): v for k, v in s["places"].items()}  # bucket -> table that holds it
        self.rows = {int(k): v for k, v in s["rows"].items()}

    def _commit(self, **state: object) -> None:
        put_text(self.spark, f"{self.folder}/manifest-{state['version']:09d}.json", json.dumps(state))
        self._take(json.loads(json.dumps(state)))

    def apply(self, after: DataFrame, before: DataFrame | None = None, load: str | None = None, **columns: str) -> PairTable:
        """Merges the changes of these baskets; see `deltas`. A named `load` that was merged before changes nothing."""
        if load is not None and load in self.loads:
            return self
        version = self.version + 1
        change = f"change-{version:09d}-{uuid.uuid4().hex[:8]}"
        deltas(after, before, **columns).write.partitionBy("kind").parquet(f"{self.folder}/{change}")
        c = self.spark.read.schema(_CHANGE).parquet(f"{self.folder}/{change}")
        sums = c.agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == 2, F.col("d"))).alias("records")).first()
        c = c.where("kind < 2")
        most = sum(self.rows.values()) + sums["n"]
        buckets, places, rows = self.buckets, dict(self.places), dict(self.rows)
        if not buckets or most > 4 * buckets * self.bucket_rows:  # new ones for all rows
            while (buckets or 1) * self.bucket_rows < most:
                buckets = 4 * (buckets or 1)
            buckets = buckets or 1
            old, reached, places, rows = self._counts(), buckets, {}, {}
        else:
            hit = [r[0] for r in c.select(self._bucket(buckets)).distinct().collect()]  # at most as many as buckets
            old, reached = self._counts(only=hit), max(1, len(hit))
        both = old.select("a", "b", "n", "kind").unionByName(c.select("a", "b", F.col("d").alias("n"), "kind")).withColumn("bucket", self._bucket(buckets))
        # a bucket's rows go to one task and are added up there
        merged = both.repartition(reached, "bucket").groupBy("bucket", "kind", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
        place = f"counts-{version:09d}-{uuid.uuid4().hex[:8]}"
        merged.write.partitionBy("bucket", "kind").parquet(f"{self.folder}/{place}")
        found = {r["bucket"]: r["n"] for r in self.spark.read.schema(_STATE).parquet(f"{self.folder}/{place}").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        gone = [] if reached == buckets and not places else [b for b in hit if b not in found]
        for b in gone:
            places.pop(b, None)
            rows.pop(b, None)
        places |= dict.fromkeys(found, place)
        self._commit(version=version, buckets=buckets, records=self.records + (sums["records"] or 0), places=places, rows=rows | found, change=change, loads=[*self.loads, *([load] if load else [])])
        return self

    def _bucket(self, buckets: int) -> F.Column:
        return F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).cast("int").alias("bucket")

    def _counts(self, only: list[int] | None = None) -> DataFrame:
        by_place: dict[str, list[str]] = {}
        for b, place in self.places.items():
            if only is None or b in set(only):
                by_place.setdefault(place, []).append(f"{self.folder}/{place}/bucket={b}")
        out = None
        for place, paths in by_place.items():
            df = self.spark.read.schema(_STATE).option("basePath", f"{self.folder}/{place}").parquet(*paths)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], _STATE) if out is None else out

    def pairs(self) -> DataFrame:
        """(a, b, n): in how many records a and b meet."""
        return self._counts().where("kind = 0").select("a", "b", "n")

    def items(self) -> DataFrame:
        """(x, n): in how many records x occurs."""
        return self._counts().where("kind = 1").select(F.col("a").alias("x"), "n")

    def scores(self, pairs: DataFrame | None = None) -> DataFrame:
        """(a, b, n, n_a, n_b, lift) of `pairs` (all, if none are given): lift is how many times n exceeds chance.

        An item may be in a tenth of the pairs: the joins with the items' counts
        split such items by estimated load.
        """
        p = self.pairs() if pairs is None else pairs
        items, plans = self.items(), skew.plan_each(p, {c: F.col(c) for c in "ab"})
        for c in "ab":
            side = items.select(F.col("x").alias("__x"), F.col("n").alias(f"n_{c}"))
            p = skew.join_by_key(p, side, F.col(c), F.col("__x"), plan=plans[c], spread=[F.col("a"), F.col("b")]).drop("__x")
        lift = F.col("n").cast("double") * F.lit(float(self.records)) / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
        return p.select("a", "b", "n", "n_a", "n_b", lift.alias("lift"))

    def affected(self) -> DataFrame:
        """Scores of the pairs whose count, or one of whose items' counts, the last change altered.

        The number of records is a factor of all lifts alike; a change of it
        alone affects no pair. Without any change there are none.
        """
        if self.change is None:
            return self.scores(self.pairs().limit(0))
        c = self.spark.read.schema(_CHANGE).parquet(f"{self.folder}/{self.change}")
        p = self.pairs()
        plans = skew.plan_each(p, {x: F.col(x) for x in "ab"})
        for x in "ab":
            side = c.where("kind = 1").select(F.col("a").alias(f"__{x}"))
            p = skew.join_by_key(p, side, F.col(x), F.col(f"__{x}"), "left", plans[x], [F.col("a"), F.col("b")])
        touched = c.where("kind = 0").select(F.col("a").alias("__ta"), F.col("b").alias("__tb"))
        p = p.join(touched, (F.col("a") == F.col("__ta")) & (F.col("b") == F.col("__tb")), "left")
        hit = p.where("__a IS NOT NULL OR __b IS NOT NULL OR __ta IS NOT NULL").select("a", "b", "n")
        return self.scores(written(hit, "affected"))

    def vacuum(self) -> None:
        """Removes tables and manifests of earlier states. Nothing may still read them."""
        kept = {*self.places.values(), self.change, f"manifest-{self.version:09d}.json"}
        for n in names(self.spark, self.folder):
            if n not in kept and n.startswith(("counts-", "change-", "manifest-")):
                remove(self.spark, f"{self.folder}/{n}")


def temporary(spark: SparkSession, bucket_rows: int = BUCKET_ROWS) -> PairTable:
    """A table in the work folder, for one process."""
    return PairTable(spark, fresh_path(spark, "pair-table"), bucket_rows)


def far_above_chance(table: PairTable, least: int, times: int) -> DataFrame:
    """Pairs that meet in at least `least` records and at least `times` as often as by chance, compared in whole numbers."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    often = table.scores(table.pairs().where(F.col("n") >= least))
    return often.where(big("n") * F.lit(table.records).cast("decimal(19,0)") >= F.lit(times).cast("decimal(9,0)") * big("n_a").cast("decimal(14,0)") * big("n_b").cast("decimal(14,0)"))
