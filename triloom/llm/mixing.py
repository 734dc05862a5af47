"""Mixing sources to target shares of the total size, by Pareto order sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.operators import skew
from triloom.session import local_table

STEPS = 4096  # parts into which one pass cuts the order


@dataclass
class Source:
    """What the plan wants of a source: a factor for the expected copies, and the tokens left to the draw."""

    share: float
    max_repeats: int
    classes: dict  # weight class -> tokens
    wanted: float = 0.0
    factor: float = 0.0

    @property
    def size(self) -> int:
        return sum(self.classes.values())

    def copies(self, weight: float) -> float:
        return min(float(self.max_repeats), self.factor * weight)

    def solve(self) -> None:
        """The factor at which the expected tokens are those wanted."""
        reach = lambda f: sum(min(float(self.max_repeats), f * w) * n for w, n in self.classes.items())
        lo, hi = 0.0, self.max_repeats / min(self.classes)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if reach(mid) < self.wanted else (lo, mid)
        self.factor = hi


def version_weights(docs: DataFrame, item: str, group: str, into: str = "weight") -> DataFrame:
    """Adds 1 / (documents that share `group`), so that a ruling in many versions counts about once.

    A document without group has weight 1. A group with a third of all rows is
    split over the tasks.
    """
    n = docs.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n")).where("__n > 1")
    rows = docs.count()
    plan = skew.plan_from_counts(n, "__g", "__n", rows)
    joined = skew.join_by_key(docs, n, F.col(group), F.col("__g"), "left", plan, [F.col(item)])
    return joined.withColumn(into, F.coalesce(1.0 / F.col("__n").cast("double"), F.lit(1.0))).drop("__g", "__n")


def planned(docs: DataFrame, targets: DataFrame, total: float | None = None, source: str = "source", size: str = "tokens", weight: str = "weight") -> dict[str, Source]:
    """The plan for each source that is a target and has tokens.

    Shares of sources without documents are divided among the others. Without
    `total` it is the largest total size at which every share can be reached
    within `max_repeats`. With a larger one, sources that can't reach their
    share give all they may. The driver holds a number for each source and
    weight; different weights 1 / n are at most as many as the square root of
    twice the documents.
    """
    want = {r[source]: (r["target_share"], r["max_repeats"]) for r in targets.where("target_share > 0 AND max_repeats > 0").collect() if r[source] is not None}
    kind = docs.schema[source].dataType.simpleString()
    sums = docs.join(local_table(docs.sparkSession, [(k,) for k in want], f"{source} {kind}"), source, "left_semi").groupBy(source, weight).agg(F.sum(size).alias("n")).where("n > 0").collect()
    plan: dict[str, Source] = {}
    for r in sums:
        if r[source] in want:
            plan.setdefault(r[source], Source(*want[r[source]], {})).classes[r[weight]] = r["n"]
    shares = sum(s.share for s in plan.values())
    if not plan:
        return plan
    most = min(s.size * s.max_repeats / (s.share / shares) for s in plan.values())
    for s in plan.values():
        s.share /= shares
        s.wanted = min(s.share * (most if total is None else total), s.size * s.max_repeats)
        s.solve()
    return plan


def _uniform(item: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on item and seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), item), 11).cast("double") + 0.5) / float(1 << 53)


def mixed(docs: DataFrame, targets: DataFrame, total: float | None = None, item: str = "doc_id", source: str = "source", size: str = "tokens", weight: str = "weight", seed: int = 42) -> DataFrame:
    """(item, source, size, copies): the documents used, and how often.

    Expected copies of a document are its weight times its source's factor, at
    most `max_repeats`. The whole part is certain. What is left of the expected
    copies is the inclusion probability p of one more copy: documents are
    ranked by the odds of a random number divided by the odds of p, and the
    first ones are taken until the source has its tokens. The cut in this order
    is found with two passes of sums over parts of the order, so nothing is
    sorted and a source with a third of all rows is no task of its own.

    Documents whose source is null or no target are not used, nor those of
    size 0. Ties in the order need equal hashes and share their fate.
    """
    plan = planned(docs, targets, total, source, size, weight)
    spark = docs.sparkSession
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (item, source)}
    if not plan:
        return spark.createDataFrame([], f"{item} {kinds[item]}, {source} {kinds[source]}, {size} bigint, copies int")
    rates = local_table(spark, [(k, s.factor, float(s.max_repeats)) for k, s in plan.items()], f"{source} {kinds[source]}, __f double, __m double")
    expected = F.least(F.col("__m"), F.col("__f") * F.col(weight)).alias("__r")
    d = docs.where((F.col(size) > 0) & F.col(weight).isNotNull()).join(rates, source).select(item, source, size, expected)
    p = F.col("__r") - F.floor("__r")
    u = _uniform(F.col(item), seed)
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = d.withColumn("__whole", F.floor("__r").cast("int")).withColumn("__t", F.when(p > 1e-12, odds / (1 + odds)))
    certain = {r[source]: r["n"] for r in ranked.groupBy(source).agg(F.sum(F.col("__whole") * F.col(size)).alias("n")).collect()}
    left = {k: s.wanted - certain.get(k, 0) for k, s in plan.items()}
    cut = {k: (0.0, 1.0, 0.0) for k in plan}  # source -> from, to, tokens before from
    for _ in range(2):
        look = local_table(spark, [(k, *v[:2]) for k, v in cut.items()], f"{source} {kinds[source]}, __lo double, __hi double")
        part = F.least(F.lit(STEPS - 1), F.floor((F.col("__t") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * STEPS)).cast("int")
        inside = ranked.join(look, source).where("__t >= __lo AND __t < __hi")
        sums: dict = {}
        for r in inside.groupBy(source, part.alias("k")).agg(F.sum(size).alias("n")).collect():  # at most STEPS rows for each source
            sums.setdefault(r[source], {})[r["k"]] = r["n"]
        for name, (lo, hi, before) in cut.items():
            step, k, got = (hi - lo) / STEPS, 0, before
            own = sums.get(name, {})
            while k < STEPS - 1 and got + own.get(k, 0) < left[name]:
                got += own.get(k, 0)
                k += 1
            cut[name] = (lo + k * step, lo + (k + 1) * step, got)
            if k in own and left[name] - got > got + own[k] - left[name]:  # with this part it comes nearer
                cut[name] = (*cut[name], True)
            cut[name] = cut[name] if len(cut[name]) == 4 else (*cut[name], False)
        ends = {name: (v[1] if v[3] else v[0]) for name, v in cut.items()}
        cut = {name: v[:3] for name, v in cut.items()}
    take = local_table(spark, [(k, float(v) if left[k] > 0 else -1.0) for k, v in ends.items()], f"{source} {kinds[source]}, __end double")
    out = ranked.join(take, source)
    more = F.when(F.col("__t") < F.col("__end"), 1).otherwise(0)
    return out.select(item, source, F.col(size).cast("bigint").alias(size), (F.col("__whole") + more).cast("int").alias("copies")).where("copies > 0")


def shares(mix: DataFrame, targets: DataFrame, source: str = "source", size: str = "tokens") -> DataFrame:
    """(source, target_share, reached_share, documents, most_copies, tokens) of every target, those without documents too."""
    got = mix.groupBy(source).agg(F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col(size)).alias(size))
    total = mix.agg(F.sum(F.col("copies") * F.col(size))).first()[0] or 0
    t = targets.join(got, source, "left")
    n = F.coalesce(F.col(size), F.lit(0))
    reached = F.lit(0.0) if not total else n / F.lit(float(total))
    return t.select(source, "target_share", reached.alias("reached_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), n.alias(size))
