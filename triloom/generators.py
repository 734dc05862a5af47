"""Random graphs with predicates, the same for the same seed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _with_predicates(e: DataFrame, predicates: Sequence[str], seed: int) -> DataFrame:
    pick = F.pmod(F.xxhash64(F.lit(seed), "s", "o", "k"), F.lit(len(predicates)))
    names = F.array(*[F.lit(p) for p in predicates])
    return e.select(F.col("s").cast("string").alias("subject"), F.element_at(names, (pick + 1).cast("int")).alias("predicate"), F.col("o").cast("string").alias("object"))


def erdos_renyi(spark: SparkSession, n: int, p: float = 0.4, predicates: Sequence[str] = ("related",), seed: int = 42) -> DataFrame:
    """Each ordered pair of different vertices with probability p. Made where it is used: each vertex draws its own targets."""
    limit = int(p * (1 << 32))
    targets = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), o), 32) < limit) & (o != F.col("id")))
    e = spark.range(n).select(F.col("id").alias("s"), F.explode(targets).alias("o"), F.lit(0).alias("k"))
    return _with_predicates(e, predicates, seed)


def _from_pairs(spark: SparkSession, pairs: np.ndarray, predicates: Sequence[str], seed: int) -> DataFrame:
    e = spark.createDataFrame(pa.table({"s": pa.array(pairs[:, 0]), "o": pa.array(pairs[:, 1]), "k": pa.array(np.arange(len(pairs)))}))
    return _with_predicates(e, predicates, seed)


def barabasi(spark: SparkSession, n: int, m: int = 1, predicates: Sequence[str] = ("related",), seed: int = 42) -> DataFrame:
    """Each new vertex points to m earlier ones, drawn in proportion to one more than their in-degree. Sequential by nature: made on the driver, n up to some millions."""
    rng = np.random.default_rng(seed)
    urn, pairs = [0], []
    for v in range(1, n):
        for o in {urn[i] for i in rng.integers(0, len(urn), m)}:
            pairs.append((v, o))
            urn.append(o)
        urn.append(v)
    return _from_pairs(spark, np.array(pairs, dtype=np.int64).reshape(-1, 2), predicates, seed)


def growing_random(spark: SparkSession, n: int, m: int = 10, predicates: Sequence[str] = ("related",), seed: int = 42) -> DataFrame:
    """With each new vertex m edges between vertices that are there, drawn evenly; parallel edges and loops may occur."""
    rng = np.random.default_rng(seed)
    there = np.repeat(np.arange(1, n), m) + 1
    pairs = np.stack([np.floor(rng.random(len(there)) * there), np.floor(rng.random(len(there)) * there)], 1).astype(np.int64)
    return _from_pairs(spark, pairs, predicates, seed)
