"""Walks as token streams, and training pairs from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.operators import skew


def tokens(hops: DataFrame) -> DataFrame:
    """(walk_id, pos, token): position 0 is the source of step 0, 2k + 1 the predicate and 2k + 2 the target of step k."""
    token = lambda pos, t: F.struct(pos.cast("int").alias("pos"), F.col(t).alias("token"))
    rest = [token(F.col("step") * 2 + 1, "predicate"), token(F.col("step") * 2 + 2, "dst")]
    at = F.when(F.col("step") == 0, F.array(token(F.lit(0), "src"), *rest)).otherwise(F.array(*rest))
    return hops.select("walk_id", F.explode(at).alias("t")).select("walk_id", "t.pos", "t.token")


def counted_tokens(hops: DataFrame) -> DataFrame:
    """(walk_id, pos, token, n) of counted hops: each token of a position once, with the number of rows that `tokens` has of it."""
    token = lambda pos, t, n: F.struct(pos.cast("int").alias("pos"), t.alias("token"), n.alias("n"))
    rest = F.transform("predicates", lambda p: token(F.col("step") * 2 + 1, p["predicate"], p["n"]))
    rest = F.concat(rest, F.array(token(F.col("step") * 2 + 2, F.col("dst"), F.col("n"))))
    at = F.when(F.col("step") == 0, F.concat(F.array(token(F.lit(0), F.col("src"), F.col("n"))), rest)).otherwise(rest)
    return hops.select("walk_id", F.explode(at).alias("t")).select("walk_id", "t.pos", "t.token", "t.n")


def unpadded(toks: DataFrame) -> DataFrame:
    """Tokens of imported walks without padding (null or negative) and repeated rows; a position may keep several tokens."""
    return toks.where("token >= 0").select("walk_id", "pos", "token").distinct()


def token_counts(toks: DataFrame) -> DataFrame:
    """(token, n)."""
    return toks.groupBy("token").agg((F.sum("n") if "n" in toks.columns else F.count("*")).alias("n"))


def frequent(toks: DataFrame, min_count: int) -> DataFrame:
    """Tokens that occur at least `min_count` times in all walks; positions keep their gaps."""
    if min_count <= 1:
        return toks
    keep = token_counts(toks).where(F.col("n") >= min_count).select(F.col("token").alias("__t"))
    return skew.join_by_key(toks, keep, F.col("token"), F.col("__t"), "left_semi", spread=[F.col("walk_id"), F.col("pos")])


def _met(toks: DataFrame, window: int) -> DataFrame:
    """(walk_id, c, x): each token of a walk with each at another position at most `window` away.

    One shuffle by walk; within a walk the meetings are made from its array.
    A walk of depth d has 2d + 1 positions, so arrays are short if parallel
    edges are counted (`counted_tokens`) and not fanned out.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    walk = toks.groupBy("walk_id").agg(F.collect_list(F.struct("pos", "token", *(["n"] if "n" in toks.columns else []))).alias("ts"))
    c = walk.select("walk_id", "ts", F.explode("ts").alias("c"))

    def near(x: Column) -> Column:
        gap = F.abs(x["pos"] - F.col("c.pos"))
        return (gap >= 1) & (gap <= window)

    return c.select("walk_id", "c", F.explode(F.filter("ts", near)).alias("x"))


def skipgram_pairs(toks: DataFrame, window: int = 5) -> DataFrame:
    """(walk_id, center, context), both directions, no shrinking of the window and no sampling."""
    return _met(toks, window).select("walk_id", F.col("c.token").alias("center"), F.col("x.token").alias("context"))


def skipgram_pairs_with_distance(toks: DataFrame, window: int = 5) -> DataFrame:
    """(walk_id, center, context, distance): distance is the context's position minus the center's."""
    return _met(toks, window).select("walk_id", F.col("c.token").alias("center"), F.col("x.token").alias("context"), (F.col("x.pos") - F.col("c.pos")).alias("distance"))


def counted_pairs(toks: DataFrame, window: int = 5) -> DataFrame:
    """(walk_id, center, context, distance, n) of counted tokens: n is the number of equal pairs of two positions."""
    n = F.col("c.n") * F.col("x.n")
    return _met(toks, window).select("walk_id", F.col("c.token").alias("center"), F.col("x.token").alias("context"), (F.col("x.pos") - F.col("c.pos")).alias("distance"), n.alias("n"))


def cbow_contexts(toks: DataFrame, window: int = 5) -> DataFrame:
    """(walk_id, pos, center, context array<int>, distance array<int>), contexts in order of distance, then token.

    Equal centers at one position share a row; each brings its contexts. All is
    made within the walk's array: one shuffle, by walk. Of counted tokens each
    context stands once, with its number in `n` array<bigint>: as every center
    of a position brings the same contexts, their shares stay what they are.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    if "n" in toks.columns:
        return _counted_contexts(toks, window)
    walk = toks.groupBy("walk_id").agg(F.collect_list(F.struct("pos", "token")).alias("ts"))
    c = walk.select("walk_id", "ts", F.explode(F.array_distinct("ts")).alias("c"))
    gap = lambda x: x["pos"] - F.col("c.pos")
    near = F.filter("ts", lambda x: (F.abs(gap(x)) >= 1) & (F.abs(gap(x)) <= window))
    one = F.transform(near, lambda x: F.struct(gap(x).alias("d"), x["token"].alias("t")))
    times = F.size(F.filter("ts", lambda x: x == F.col("c")))
    g = c.select("walk_id", F.col("c.pos").alias("pos"), F.col("c.token").alias("center"), F.array_sort(F.flatten(F.array_repeat(one, times))).alias("xs")).where(F.size("xs") > 0)
    return g.select("walk_id", "pos", "center", F.transform("xs", lambda x: x["t"]).alias("context"), F.transform("xs", lambda x: x["d"]).alias("distance"))


def _counted_contexts(toks: DataFrame, window: int) -> DataFrame:
    # sorted once for all centers of a walk: by position is by distance from any of them
    walk = toks.groupBy("walk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "n"))).alias("ts"))
    c = walk.select("walk_id", "ts", F.explode("ts").alias("c"))
    gap = lambda x: x["pos"] - F.col("c.pos")
    near = lambda x: (F.abs(gap(x)) >= 1) & (F.abs(gap(x)) <= window)
    g = c.where(F.exists("ts", near)).select("walk_id", F.col("c.pos").alias("pos"), F.col("c.token").alias("center"), F.filter("ts", near).alias("xs"))
    return g.select("walk_id", "pos", "center", F.col("xs.token").alias("context"), F.transform("xs", lambda x: x["pos"] - F.col("pos")).alias("distance"), F.col("xs.n").alias("n"))


def pair_totals(toks: DataFrame, window: int = 5) -> DataFrame:
    """(center, context, n): how often each pair occurs, of counted tokens too."""
    if "n" in toks.columns:
        return counted_pairs(toks, window).groupBy("center", "context").agg(F.sum("n").alias("n"))
    return skipgram_pairs(toks, window).groupBy("center", "context").agg(F.count("*").alias("n"))
