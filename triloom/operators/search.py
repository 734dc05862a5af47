"""Nearest vectors by dot product."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.operators.ranking import globally_indexed
from triloom.session import written


QUERY_BLOCK = 4096
VECTOR_BLOCK = 4096


def top_k(vectors: DataFrame, queries: DataFrame, k: int, item: str = "token", vector: str = "embedding", query: str = "query_id", query_vector: str = "query", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, rank, item, score): the k items of highest dot product for each query, ties to the smaller item.

    Queries are taken in blocks, however many there are: each block is sent to
    the vectors and multiplied with them where they lie, and of each task only
    the k best of each query are shuffled. A task holds the scores of one block
    of queries with one of vectors. Query ids are taken to be distinct. Null
    vectors match nothing; a vector of another length is an error.
    """
    qt, it = queries.schema[query].dataType.simpleString(), vectors.schema[item].dataType.simpleString()
    asked = written(queries.where(F.col(query_vector).isNotNull() & F.col(query).isNotNull()).select(query, query_vector), "queries")
    n = asked.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"{query} {qt}, rank int, {item} {it}, score double")
    placed = globally_indexed(asked, [F.col(query)], "__i") if n > block else asked.withColumn("__i", F.lit(0))
    there = vectors.where(F.col(vector).isNotNull()).select(item, vector)
    near = None
    for b in range(-(-n // block)):
        rows = placed.where((F.col("__i") >= b * block) & (F.col("__i") < (b + 1) * block)).select(query, query_vector).toArrow()  # at most `block` rows
        names, q = rows.column(0).combine_chunks(), np.array(rows.column(1).to_pylist(), dtype=np.float64)
        part = there.mapInArrow(_best(names, q, k, query, item), f"{query} {qt}, {item} {it}, score double")
        near = part if near is None else near.unionByName(part)
    order = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, "rank", item, "score")


def _best(names: pa.Array, q: np.ndarray, k: int, query: str, item: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores, item_type = None, None, None
        for whole in batches:
            for at in range(0, whole.num_rows, VECTOR_BLOCK):
                b = whole.slice(at, VECTOR_BLOCK)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                own, item_type = b.column(0).to_numpy(zero_copy_only=False), b.column(0).type
                i, s = _top(own, q @ v.T, k)
                if ids is not None:
                    i, s = _top_rows(np.concatenate([ids, i], 1), np.concatenate([scores, s], 1), k)
                ids, scores = i, s
        if ids is not None:
            each = pa.array(np.repeat(np.arange(len(q)), ids.shape[1]))
            yield pa.RecordBatch.from_arrays([names.take(each), pa.array(ids.ravel(), item_type), pa.array(scores.ravel())], names=[query, item, "score"])

    return best


def _top(own: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores, items the same for all rows; exact at ties."""
    if s.shape[1] <= k:
        return np.broadcast_to(own, s.shape), s
    least = np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None]
    rows, cols = np.nonzero(s >= least)  # the k best and what ties with the last of them
    order = np.lexsort((own[cols], -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    begin = np.searchsorted(rows, np.arange(len(s)))
    pick = cols[(begin[:, None] + np.arange(k)).ravel()].reshape(len(s), k)
    return own[pick], np.take_along_axis(s, pick, 1)


def _top_rows(ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -s))[:, :k]  # at most 2 k columns
    return np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
