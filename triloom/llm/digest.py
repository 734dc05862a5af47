"""Percentiles of numeric columns per group: merging centroid digests, certified and made exact by counting passes.

A digest holds the values of a group as at most about `delta` centroids (mean,
weight), small near the ends and larger in the middle. Digests of partitions,
days or loads merge by clustering their centroids again (`merged`). A counting
pass over the values gives the true rank of every estimate (`certified`), and
brackets around estimates lead to exact order statistics (`exact_quantiles`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.operators import skew
from triloom.session import written

DIGEST = "n bigint, low double, high double, means array<double>, weights array<double>"


def cluster(means: np.ndarray, weights: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of sorted values: one cluster for each unit of the size function delta/(2 pi) asin(2q - 1)."""
    total = weights.sum()
    middle = (np.cumsum(weights) - weights / 2) / total
    unit = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * middle - 1, -1, 1)))
    begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    w = np.add.reduceat(weights, begin)
    with np.errstate(over="ignore", invalid="ignore"):
        m = np.add.reduceat(means * (weights / 1.0), begin) / w
    # sums beyond a double's range: average in smaller steps
    for i in np.flatnonzero(~np.isfinite(m)):
        part = slice(begin[i], begin[i + 1] if i + 1 < len(begin) else len(means))
        m[i] = (means[part] * (weights[part] / w[i])).sum()
    return np.clip(m, means[begin], means[np.r_[begin[1:], len(means)] - 1]), w


class _Builder:
    """Digests of the groups of one partition; a group's values wait in a buffer until they are worth clustering."""

    def __init__(self, delta: float, buffer: int = 8192) -> None:
        self.delta, self.buffer, self.held = delta, buffer, {}

    def add(self, key: object, values: np.ndarray, weights: np.ndarray | None = None, low: float | None = None, high: float | None = None) -> None:
        w = np.ones(len(values)) if weights is None else weights
        lo, hi = (values.min() if low is None else low), (values.max() if high is None else high)
        g = self.held.setdefault(key, {"m": [], "w": [], "k": 0, "low": lo, "high": hi})
        g["m"].append(values)
        g["w"].append(w)
        g["k"] += len(values)
        g["low"], g["high"] = min(g["low"], lo), max(g["high"], hi)
        if g["k"] > self.buffer:
            self._shrink(g)

    def _shrink(self, g: dict) -> None:
        m, w = np.concatenate(g["m"]), np.concatenate(g["w"])
        order = np.argsort(m, kind="stable")
        m, w = cluster(m[order], w[order], self.delta)
        g["m"], g["w"], g["k"] = [m], [w], len(m)

    def rows(self) -> Iterator[tuple]:
        for key, g in self.held.items():
            self._shrink(g)
            yield key, round(g["w"][0].sum()), g["low"], g["high"], g["m"][0].tolist(), g["w"][0].tolist()

    def full(self) -> bool:
        return sum(g["k"] for g in self.held.values()) > 4_000_000


def _emit(builder: _Builder, key_type: pa.DataType, key: str) -> Iterator[pa.RecordBatch]:
    rows = list(builder.rows())
    builder.held = {}
    for i in range(0, len(rows), 2000):
        cols = list(zip(*rows[i : i + 2000], strict=True))
        kinds = [key_type, pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "n", "low", "high", "means", "weights"])


def digests(values: DataFrame, key: str, value: str, delta: float = 200.0) -> DataFrame:
    """One digest for each group and partition; merge them with `merged`.

    Rows with a null key or a value that is null, NaN or infinite are left out.
    Each partition is clustered where it lies, so a group with a third of all
    rows costs no task more than another.
    """
    v = values.select(F.col(key), F.col(value).cast("double").alias("v")).where(F.col(key).isNotNull() & (F.abs("v") < float("inf")))
    kind = v.schema[key].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, key_type = _Builder(delta), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key_type = batch.schema.field(0).type
            codes = pc.dictionary_encode(batch.column(0))
            x, c = batch.column(1).to_numpy(zero_copy_only=False), codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(c, kind="stable")
            ends = np.searchsorted(c[order], np.arange(len(codes.dictionary) + 1))
            for i, k in enumerate(codes.dictionary.to_pylist()):
                b.add(k, x[order[ends[i] : ends[i + 1]]])
            if b.full():
                yield from _emit(b, key_type, key)
        if b.held:
            yield from _emit(b, key_type, key)

    return v.mapInArrow(build, f"{key} {kind}, {DIGEST}")


def merged(parts: DataFrame, key: str, delta: float = 200.0, fan_in: int = 64) -> DataFrame:
    """One digest for each group, from digests of partitions, days or loads; in two rounds, so no task merges more than about `fan_in` times the partitions' root."""
    kind = parts.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {DIGEST}"

    def merge(_: tuple, t: pa.Table) -> pa.Table:
        b = _Builder(delta)
        k = t.column(key)[0].as_py()
        for row in t.select(["means", "weights", "low", "high"]).to_pylist():
            b.add(k, np.array(row["means"]), np.array(row["weights"]), row["low"], row["high"])
        return pa.Table.from_batches(list(_emit(b, t.schema.field(key).type, key)))

    cols = [key, "n", "low", "high", "means", "weights"]
    near = parts.select(*cols).withColumn("__round", F.floor(F.spark_partition_id() / fan_in))
    first = near.groupBy(key, "__round").applyInArrow(merge, schema)
    return first.groupBy(key).applyInArrow(merge, schema)


def quantile_of(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The value at quantile q: between the middles of the centroids around it, at the ends up to the extremes."""
    total = weights.sum()
    at = np.r_[0.0, np.cumsum(weights) - weights / 2, total]
    return float(np.interp(q * total, at, np.r_[low, means, high]))


def estimated(digest: DataFrame, key: str, quantiles: list[float]) -> DataFrame:
    """(key, q, estimate) of each group's digest."""
    kind = digest.schema[key].dataType.simpleString()

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r[key], q, quantile_of(np.array(r["means"]), np.array(r["weights"]), r["low"], r["high"], q)) for r in b.to_pylist() for q in quantiles]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(key).type), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], names=[key, "q", "estimate"])

    return digest.mapInArrow(estimate, f"{key} {kind}, q double, estimate double")


def _finite(values: DataFrame, key: str, value: str, into: str | None = None) -> DataFrame:
    """(key, v, __row): the finite values, with a hash of the row that tells them apart."""
    v = values.select(F.col(key).alias(into or key), F.col(value).cast("double").alias("v"), F.xxhash64(*[F.col(f"`{c}`") for c in values.columns]).alias("__row"))
    return v.where(F.col(into or key).isNotNull() & (F.abs("v") < float("inf")))


def _meet(v: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """The values with the rows of their group in the written table `side`. A group may have a third of all values: beyond a broadcast's size it is split."""
    right = side.withColumnRenamed(key, "__side")
    return skew.join_measured(v, right, F.col(key), F.col("__side"), spread=[F.col("__row")]).drop("__side", "__row")


def certified(values: DataFrame, key: str, value: str, estimates: DataFrame) -> DataFrame:
    """(key, q, estimate, n, rank_error): how far the estimate's true rank is from q, as a share of the group's rows.

    Every value is counted against its group's estimates; counts combine before
    they are shuffled.
    """
    v = _finite(values, key, value)
    counted = _meet(v, written(estimates, "estimates"), key).groupBy(key, "q", "estimate").agg(F.count("*").alias("n"), F.count(F.when(F.col("v") < F.col("estimate"), 1)).alias("below"), F.count(F.when(F.col("v") <= F.col("estimate"), 1)).alias("upto"))
    off = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("q"), F.col("q") - F.col("upto") / F.col("n"))
    return counted.select(key, "q", "estimate", "n", off.alias("rank_error"))


def exact_quantiles(values: DataFrame, key: str, value: str, quantiles: list[float], delta: float = 200.0, reach: float = 0.02, most: int = 200_000) -> DataFrame:
    """(key, q, n, quantile) with linear interpolation, exact.

    1. Digests give for each group and q a bracket of `reach` around q.
    2. A counting pass certifies it: with the rows below and in the bracket it
       is known whether the wanted order statistics lie inside. If not (its
       certified rank error was larger), the bracket becomes the whole range
       on that side.
    3. While a bracket holds more than `most` rows of distinct values, the
       rows in it get digests of their own and narrower brackets, so the last
       sort of a bracket stays bounded.

    `values` is read once for each pass: hand over a written table. Groups are
    those with at least one finite value; null keys are left out.
    """
    named, key = key, "__key"
    v = _finite(values, named, value, key)
    whole = merged(digests(v, key, "v", delta), key, delta)
    state = written(_brackets(whole, key, quantiles, reach), "brackets")
    widen, left = reach, float("inf")
    while True:
        # (key, q, n, base, lo, hi): all rows of the group under lo are `below`
        hit = _meet(v, state, key).groupBy(key, "q", "n", "lo", "hi").agg(F.count(F.when(F.col("v") < F.col("lo"), 1)).alias("below"), F.count(F.when((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")), 1)).alias("inside"))
        place = F.col("q") * (F.col("n") - 1)
        hit = hit.withColumn("r0", F.floor(place)).withColumn("r1", F.ceil(place))
        counted = written(hit.withColumn("sure", (F.col("below") <= F.col("r0")) & (F.col("r1") < F.col("below") + F.col("inside"))), "counted")
        worst = counted.agg(F.max("inside").alias("inside"), F.min("sure").alias("sure"), F.max(F.when(F.col("lo") < F.col("hi"), F.col("inside"))).alias("open"), F.sum(F.when(F.col("lo") < F.col("hi"), F.col("inside"))).alias("all")).first()
        if worst["sure"] is False:
            inf = float("inf")
            lo = F.when(F.col("r0") < F.col("below"), -inf).otherwise(F.col("lo"))
            hi = F.when(F.col("r1") >= F.col("below") + F.col("inside"), inf).otherwise(F.col("hi"))
            state = written(counted.select(key, "q", "n", lo.alias("lo"), hi.alias("hi")), "brackets")
        elif (worst["open"] or 0) > most and worst["all"] < left:  # without progress only repeated values are left
            left = worst["all"]
            state = written(_narrowed(v, counted, key, delta, widen), "brackets")
            widen = min(0.4, widen * 2)
        else:
            break
    b = counted.select(key, "q", "n", "lo", "hi", "below", "r0", "r1")
    runs = _meet(v, b, key).where("v >= lo AND v <= hi").groupBy(key, "q", "n", "below", "r0", "r1", "v").count()
    upto = F.col("below") + F.sum("count").over(Window.partitionBy(key, "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = runs.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("count"))
    at = lambda r: F.max(F.when((F.col("begin") <= F.col(r)) & (F.col(r) < F.col("end")), F.col("v")))
    got = ranked.groupBy(key, "q", "n", "r0").agg(at("r0").alias("v0"), at("r1").alias("v1"))
    part = F.col("q") * (F.col("n") - 1) - F.col("r0")
    return got.select(F.col(key).alias(named), "q", "n", F.when(part == 0, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * part).alias("quantile"))


def _brackets(digest: DataFrame, key: str, quantiles: list[float], reach: float) -> DataFrame:
    wanted = sorted({max(0.0, q - reach) for q in quantiles} | {min(1.0, q + reach) for q in quantiles})
    e = digest.select(key, "n").join(estimated(digest, key, wanted), key)
    out = None
    for q in quantiles:
        lo, hi = max(0.0, q - reach), min(1.0, q + reach)
        one = e.groupBy(key, "n").agg(F.max(F.when(F.col("q") == lo, F.col("estimate"))).alias("lo"), F.max(F.when(F.col("q") == hi, F.col("estimate"))).alias("hi")).withColumn("q", F.lit(q))
        out = one if out is None else out.unionByName(one)
    return out.select(key, "q", "n", "lo", "hi")


def _narrowed(v: DataFrame, counted: DataFrame, key: str, delta: float, reach: float) -> DataFrame:
    """Narrower brackets from digests of the rows inside the present ones."""
    name = F.to_json(F.struct(key, "q"))
    inside = _meet(v, counted.select(key, "q", "lo", "hi"), key).where("v >= lo AND v <= hi").select(name.alias("__part"), "v")
    d = merged(digests(inside, "__part", "v", delta), "__part", delta)
    c = counted.withColumn("__part", name).join(d.select("__part", F.col("low"), F.col("high"), "means", "weights"), "__part")
    kind = counted.schema[key].dataType.simpleString()

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            los, his = [], []
            for r in rows:
                m, w = np.array(r["means"]), np.array(r["weights"])
                q0, q1 = (r["r0"] - r["below"]) / r["inside"] - reach, (r["r1"] - r["below"] + 1) / r["inside"] + reach
                los.append(r["lo"] if q0 <= 0 else quantile_of(m, w, r["low"], r["high"], q0))
                his.append(r["hi"] if q1 >= 1 else quantile_of(m, w, r["low"], r["high"], q1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(los, pa.float64()), pa.array(his, pa.float64())], names=[key, "q", "n", "lo", "hi"])

    return c.select(key, "q", "n", "lo", "hi", "below", "inside", "r0", "r1", "low", "high", "means", "weights").mapInArrow(narrow, f"{key} {kind}, q double, n bigint, lo double, hi double")


def far_outliers(values: DataFrame, quartiles: DataFrame, key: str, value: str, times: float = 3.0) -> DataFrame:
    """Rows of `values` more than `times` interquartile ranges outside the quartiles (q 0.25 and 0.75) of their group."""
    pick = lambda q: F.max(F.when(F.col("q") == q, F.col("quantile")))
    f = quartiles.groupBy(key).agg(pick(0.25).alias("__q1"), pick(0.75).alias("__q3"))
    f = f.select(F.col(key).alias("__k"), (F.col("__q1") - times * (F.col("__q3") - F.col("__q1"))).alias("__least"), (F.col("__q3") + times * (F.col("__q3") - F.col("__q1"))).alias("__most"))
    out = skew.join_measured(values, written(f, "fences"), F.col(key), F.col("__k"))
    return out.where((F.col(value) < F.col("__least")) | (F.col(value) > F.col("__most"))).drop("__k", "__least", "__most")
