"""One dense vocabulary for subjects, predicates and objects, and edges in its tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.operators import skew
from triloom.operators.ranking import globally_indexed
from triloom.session import written

TRIPLE = ["subject", "predicate", "object"]


def complete(triples: DataFrame) -> DataFrame:
    """Triples without a null term."""
    return triples.dropna(subset=TRIPLE)


def terms(triples: DataFrame) -> DataFrame:
    """(word): the distinct terms; entities and predicates share one id space."""
    return complete(triples).select(F.explode(F.array(*TRIPLE)).alias("word")).distinct()


def vocabulary(triples: DataFrame) -> DataFrame:
    """(token int, word): dense from 0 in byte order of the word. No triples give no rows."""
    return globally_indexed(terms(triples), [F.col("word")], "token").select(F.col("token").cast("int").alias("token"), "word")


def encoded(triples: DataFrame, vocab: DataFrame) -> DataFrame:
    """Triples in tokens; triples with a null or unknown term are left out, all other columns but the terms' stay.

    The terms of all three places are skewed: one pass estimates their loads,
    and the joins split heavy terms. For the predicates the vocabulary is first
    cut to those that occur, and written, so that its size is known and a small
    one is broadcast without a shuffle of the triples.
    """
    t = complete(triples)
    v = vocab.select("token", "word")
    used = t.select(F.col("predicate").alias("__w")).distinct()
    few = written(v.join(used, v["word"] == used["__w"], "left_semi"), "predicates")
    t = _looked_up(t, {"predicate": few, "subject": v, "object": v}, "word", "token")
    rest = [c for c in triples.columns if c not in TRIPLE]
    return t.select(*[F.col(f"__{c}").cast("int").alias(c) for c in TRIPLE], *rest)


def _looked_up(rows: DataFrame, sides: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """In place of each named column c the `value` of the row of its side whose `key` it is, as `__c`; rows without one leave.

    A column goes when it is looked up, so no later shuffle carries it.
    """
    small = {c for c, side in sides.items() if hasattr(side, "_triloom_path") and skew.fits_broadcast(side)}
    plans = skew.plan_each(rows, {c: F.col(c) for c in sides if c not in small}) if len(small) < len(sides) else {}
    for c, side in sides.items():
        s = side.select(F.col(key).alias("__w"), F.col(value).alias(f"__{c}"))
        if c in small:
            rows = rows.join(s, F.col(c) == F.col("__w")).drop("__w", c)
            continue
        rows = skew.join_by_key(rows, s, F.col(c), F.col("__w"), plan=plans[c], spread=[F.col(x if x in rows.columns else f"__{x}") for x in TRIPLE], hashed=True).drop("__w", c)
    return rows


def decoded(edges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Encoded triples as terms again."""
    e = edges.dropna(subset=TRIPLE)
    v = vocab.select("token", "word")
    used = e.select(F.col("predicate").alias("__t")).distinct()
    few = written(v.join(used, v["token"] == used["__t"], "left_semi"), "predicates")
    e = _looked_up(e, {"subject": v, "object": v, "predicate": few}, "token", "word")
    return e.select(*[F.col(f"__{c}").alias(c) for c in TRIPLE], *[c for c in edges.columns if c not in TRIPLE])
