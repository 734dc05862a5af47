"""Edges with literal objects: dropped, or their numbers replaced by bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.functions.numbers import NUMBER
from triloom.operators import skew
from triloom.operators.ranking import globally_indexed
from triloom.session import written

PLAIN_NUMBER = f"^\\s*({NUMBER})\\s*$"


def numeric(text: Column) -> Column:
    """Text as double if it is a number, blanks around it allowed; else null. NaN and infinities are no numbers."""
    v = F.regexp_extract(text, PLAIN_NUMBER, 1).try_cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def local_name(iri: Column) -> Column:
    """What follows the last slash, and of that what follows the last hash."""
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def is_literal(predicates: Sequence[str]) -> Column:
    """True for the listed predicates; a null predicate is none of them."""
    return F.coalesce(F.col("predicate").isin(list(predicates)), F.lit(False))


def dropped(triples: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """Triples of all other predicates, those with a null predicate too."""
    return triples.where(~is_literal(predicates)) if predicates else triples


def exact_quantiles(counts: DataFrame, group: str, value: str, n_bins: int) -> DataFrame:
    """(group, edges): the distinct values at i / bins of each group's rows, by linear interpolation, in order.

    `counts` (group, value, c) says how often each value occurs; a group has as
    many bins as distinct values, at most `n_bins`. Values get their ranks from
    running sums over a range-partitioned order, and only those at wanted ranks
    go on, so no group is collected or sorted in one task.
    """
    g = globally_indexed(counts, [F.col(group), F.col(value)], "__g", ("c", "__run"))
    own = g.groupBy(F.col(group).alias("__p")).agg(F.min(F.col("__run") - F.col("c")).alias("__base"), F.sum("c").alias("__n"), F.least(F.count("*"), F.lit(n_bins)).cast("int").alias("__bins"))
    r = skew.join_measured(g, written(own, "group-stats"), F.col(group), F.col("__p"), spread=[F.col("__g")])
    r = r.withColumn("__end", F.col("__run") - F.col("__base")).withColumn("__begin", F.col("__end") - F.col("c"))
    place = lambda i: i / F.col("__bins").cast("double") * (F.col("__n") - 1)
    here = lambda rank: (F.col("__begin") <= rank) & (rank < F.col("__end"))
    hit = F.filter(F.sequence(F.lit(0), F.col("__bins")), lambda i: here(F.floor(place(i))) | here(F.ceil(place(i))))
    at = r.withColumn("__hit", hit).where(F.size("__hit") > 0).withColumn("__k", F.explode("__hit"))
    low, high = F.floor(place(F.col("__k"))), F.ceil(place(F.col("__k")))
    pick = lambda rank: F.max(F.when(here(rank), F.col(value)))
    q = at.withColumn("__f", place(F.col("__k")) - low).groupBy(group, "__k", "__f").agg(pick(low).alias("lo"), pick(high).alias("hi"))
    edge = F.when(F.col("__f") == 0, F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("__f"))
    return q.groupBy(group).agg(F.array_sort(F.array_distinct(F.collect_list(edge))).alias("edges"))  # bins + 1 values for each group


def binned(triples: DataFrame, predicates: Sequence[str], n_bins: int = 5, strategy: str = "quantile") -> DataFrame:
    """Literal objects as `<local name>_bin_<k>`; literal edges whose object isn't a number vanish, other edges stay as they are.

    Each predicate gets at most as many bins as it has distinct values. A value
    equal to an inner edge goes to the lower bin; equal values all go to bin 0.
    Predicates with the same local name share bins' names. Without literal
    edges the triples come back unchanged.
    """
    if strategy not in ("quantile", "uniform"):
        raise ValueError("strategy must be quantile or uniform")
    if not predicates:
        return triples
    lit = is_literal(predicates)
    rows = triples.where(lit).withColumn("__v", numeric(F.col("object"))).where("__v IS NOT NULL")
    counts = written(rows.groupBy("predicate", "__v").agg(F.count("*").alias("c")), "value-counts")
    none = F.array().cast("array<double>")
    if strategy == "uniform":
        span = counts.groupBy("predicate").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.least(F.count("*"), F.lit(n_bins)).alias("__bins"))
        inner = F.transform(F.sequence(F.lit(1), F.greatest(F.col("__bins") - 1, F.lit(1)).cast("int")), lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / F.col("__bins")))
        edges = span.select(F.col("predicate").alias("__p"), F.when((F.col("lo") == F.col("hi")) | (F.col("__bins") < 2), none).otherwise(inner).alias("__inner"))
    else:
        n = F.size("edges")
        edges = exact_quantiles(counts, "predicate", "__v", n_bins).select(F.col("predicate").alias("__p"), F.when(n > 2, F.slice("edges", F.lit(2), F.greatest(n - 2, F.lit(1)))).otherwise(none).alias("__inner"))
    k = F.size(F.filter("__inner", lambda e: e < F.col("__v")))
    out = skew.join_measured(rows, written(edges, "bin-edges"), F.col("predicate"), F.col("__p"))  # a row for each listed predicate
    out = out.withColumn("object", F.concat(local_name(F.col("predicate")), F.lit("_bin_"), k.cast("string"))).select(*triples.columns)
    return triples.where(~lit).unionByName(out)
