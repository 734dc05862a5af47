"""Embedding models in numpy: tables, which of their rows a batch needs, its loss, and the gradients of those rows.

A model names its tables and their shapes. `rows` gives the row numbers that a
batch and its negative draws need, by role; `grads` takes the places of these
rows in whatever part of the tables is at hand, so a task holds only rows that
its data touch. A gradient is a pair (places, rows) for each table, places
distinct. Tables start uniform in (-1/d, 1/d).

Negative draws are uniform over the rows of one table (`pooled`). A task draws
them from a pool, a uniform sample of at most `pool` of these rows that changes
every epoch; where the table has no more rows the pool is the whole table.

Data may be counted: a last column says how many equal pairs a row stands for,
or how often each context of a CBOW row occurs. A pair's loss and gradient are
taken that many times, a context counts that often in the mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Params = dict[str, np.ndarray]
Grads = dict[str, tuple[np.ndarray, np.ndarray]]
Rows = dict[str, tuple[str | None, np.ndarray]]  # role -> table, row numbers (-1: none); without a table the values themselves
INIT_BLOCK = 4096
SPARSE = 64  # rows of a block that take as long to skip to as the whole block to draw, about
HELD = 4_000_000  # floats of the words that a CBOW shard holds for its pools


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def by_row(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the same id added up."""
    if not len(ids):
        return ids, rows[:0]
    bits = len(ids).bit_length()
    key = np.sort((ids.astype(np.int64) << bits) | np.arange(len(ids)))  # a stable order, and no two keys are equal
    order, own = key & ((1 << bits) - 1), key >> bits
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[begin], np.add.reduceat(rows.take(order, 0), begin)


class Model:
    """What all models share. Subclasses are frozen dataclasses with `vocab` and `size`."""

    columns: tuple[str, ...]
    output: str
    pooled: str
    tables: tuple[str, ...] = ()  # of the first columns the tables whose rows they name; none if row numbers are computed from several columns
    whole: tuple[str, ...] = ()  # tables that every shard needs as a whole, whatever its data

    def shapes(self) -> dict[str, tuple[int, int]]:
        raise NotImplementedError

    def touched(self) -> list[tuple[str, Column]]:
        """Row numbers that the data name, as columns (or arrays) over the data's columns."""
        raise NotImplementedError

    def rows(self, batch: tuple[np.ndarray, ...], rng: np.random.Generator, pool: np.ndarray | None = None) -> Rows:
        raise NotImplementedError

    def grads(self, p: Params, at: dict[str, np.ndarray]) -> tuple[float, Grads]:
        raise NotImplementedError

    def initial(self, table: str, block: int, seed: int) -> np.ndarray:
        """The first values of the block's rows; they depend on seed, table and block alone."""
        n, width = self.shapes()[table]
        rng = np.random.default_rng([seed, list(self.shapes()).index(table), block])
        size = max(0, min(INIT_BLOCK, n - block * INIT_BLOCK))
        return self._begun(table, rng.uniform(-1 / self.size, 1 / self.size, (size, width)).astype(np.float32))

    def _begun(self, table: str, m: np.ndarray) -> np.ndarray:
        """First values from draws."""
        return m

    def initial_rows(self, table: str, rows: np.ndarray, seed: int) -> np.ndarray:
        """The first values of these rows, which are in order. Where few of a block are wanted its draws are skipped up to each of them."""
        width, t = self.shapes()[table][1], list(self.shapes()).index(table)
        out = np.empty((len(rows), width), np.float32)
        block = rows // INIT_BLOCK
        ends = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(rows)] if len(rows) else [0]
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            b = int(block[lo])
            places = (rows[lo:hi] - b * INIT_BLOCK).tolist()
            if len(places) > SPARSE:
                out[lo:hi] = self.initial(table, b, seed)[places]
                continue
            bits, at = np.random.PCG64([seed, t, b]), 0  # as `default_rng`; a value takes one draw
            rng = np.random.Generator(bits)
            for i, r in enumerate(places, lo):
                bits.advance((r - at) * width)
                out[i], at = rng.uniform(-1 / self.size, 1 / self.size, width), r + 1
            out[lo:hi] = self._begun(table, out[lo:hi])
        return out

    def params(self, seed: int) -> Params:
        """All tables at once: for small models."""
        return {t: np.concatenate([self.initial(t, b, seed) for b in range(max(1, -(-n // INIT_BLOCK)))]) for t, (n, _) in self.shapes().items()}

    def held(self) -> int:
        """Rows of the pooled table that a shard holds for its draws, at most."""
        return self.pool

    def draw(self, shape: tuple[int, ...], rng: np.random.Generator, pool: np.ndarray | None) -> np.ndarray:
        return rng.integers(0, self.shapes()[self.pooled][0], shape) if pool is None else pool[rng.integers(0, len(pool), shape)]


@dataclass(frozen=True)
class SkipGram(Model):
    """Center and context tables; `negatives` uniform draws from the vocabulary for each pair, which may hit the true context."""

    vocab: int
    size: int
    negatives: int = 5
    pool: int = 16_384
    columns = ("center", "context")
    tables = ("in", "out")
    output = "in"
    pooled = "out"

    def shapes(self) -> dict[str, tuple[int, int]]:
        return {"in": (self.vocab, self.size), "out": (self.vocab, self.size)}

    def touched(self) -> list[tuple[str, Column]]:
        return [("in", F.col("center")), ("out", F.col("context"))]

    def rows(self, batch: tuple[np.ndarray, ...], rng: np.random.Generator, pool: np.ndarray | None = None) -> Rows:
        center, context, *n = batch
        return {"center": ("in", center), "target": ("out", np.concatenate([context[:, None], self.draw((len(center), self.negatives), rng, pool)], 1))} | _counts(n)

    def grads(self, p: Params, at: dict[str, np.ndarray]) -> tuple[float, Grads]:
        center, target = at["center"], at["target"]
        e = p["in"][center]
        o = p["out"][target]
        loss, d, back = _scored(e, o, at.get("n"))
        return loss, {"in": by_row(center, np.einsum("nk,nkd->nd", d, o)), "out": by_row(target.ravel(), back.reshape(-1, self.size))}


def _counts(n: list[np.ndarray]) -> Rows:
    return {"n": (None, n[0])} if n else {}


def _shares(there: np.ndarray, n: np.ndarray | None, kind: np.dtype) -> np.ndarray:
    """What each context is of its row's mean, 0 where there is none."""
    times = there.astype(kind) if n is None else np.where(there, n, 0).astype(kind)
    return times / np.maximum(times.sum(1, keepdims=True), 1)


def _scored(e: np.ndarray, o: np.ndarray, times: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of vectors e against targets o, of which the first is the true one; gradients of the scores and of the targets.

    `times` is how often each row counts. Sums are divided by the rows and not
    by their counts: Adam's steps don't depend on the scale, and a row that
    counts once keeps its gradient beside one that counts a million times.
    """
    n = len(e)
    z = np.einsum("nd,nkd->nk", e, o)
    label = np.zeros_like(z)
    label[:, 0] = 1
    each, d = np.logaddexp(0, z) - label * z, (_sigmoid(z) - label) / n
    if times is not None:
        w = times[:, None].astype(o.dtype)
        each, d = each * w, d * w
    loss, d = each.sum(dtype=np.float64) / n, d.astype(o.dtype)
    return float(loss), d, d[:, :, None] * e[:, None, :]


@dataclass(frozen=True)
class Cbow(Model):
    """Mean of the context's embeddings (padding -1 left out), a linear layer with bias onto the vocabulary, cross entropy.

    The cross entropy runs over the true word and the pool, whose scores are
    raised so that its sum stands for that over all other words; with a
    vocabulary of at most `pool` words that is the full softmax. The bias is
    the last column of `weight`.

    A larger vocabulary has a new pool in every batch, drawn from the words
    that the shard holds, up to `HELD` floats of them. With one pool for an
    epoch only its words would be pushed down, and the next epoch's pool would
    begin anew: the loss then doesn't fall.
    """

    vocab: int
    size: int
    pool: int = 8192
    columns = ("context", "center")
    tables = ("in", "weight")
    output = "in"
    pooled = "weight"

    def shapes(self) -> dict[str, tuple[int, int]]:
        return {"in": (self.vocab, self.size), "weight": (self.vocab, self.size + 1)}

    def touched(self) -> list[tuple[str, Column]]:
        return [("in", F.col("context")), ("weight", F.col("center"))]

    def _begun(self, table: str, m: np.ndarray) -> np.ndarray:
        if table == "weight":
            m[:, -1] = 0
        return m

    def rows(self, batch: tuple[np.ndarray, ...], rng: np.random.Generator, pool: np.ndarray | None = None) -> Rows:
        context, center, *n = batch
        drawn = np.arange(self.vocab) if pool is None else pool
        if pool is not None and len(pool) > self.pool:
            drawn = np.sort(pool[rng.choice(len(pool), self.pool, replace=False, shuffle=False)])
        return {"context": ("in", context), "true": ("weight", center), "pool": ("weight", drawn)} | _counts(n)

    def held(self) -> int:
        return max(self.pool, HELD // (self.size + 1))

    def grads(self, p: Params, at: dict[str, np.ndarray]) -> tuple[float, Grads]:
        context, true, pool = at["context"], at["true"], at["pool"]
        n, there, kind = len(true), context >= 0, p["in"].dtype
        share = _shares(there, at.get("n"), kind)
        flat, part, sizes = context[there], share[there][:, None], there.sum(1)
        some = np.flatnonzero(sizes)
        h1 = np.ones((n, self.size + 1), kind)
        h1[:, :-1] = 0
        if len(some):
            h1[some, :-1] = np.add.reduceat(part * p["in"].take(flat, 0), (np.cumsum(sizes) - sizes)[some])
        w, o = p["weight"].take(true, 0), p["weight"].take(pool, 0)
        # the pool's rows are distinct and in order, so a true word is at most one of them
        place = np.minimum(np.searchsorted(pool, true), len(pool) - 1)
        hit = np.flatnonzero(pool[place] == true)
        others = np.full(n, len(pool))
        others[hit] -= 1
        scale = (max(self.vocab - 1, 1) / np.maximum(others, 1)).astype(kind)  # what a word of the pool stands for
        z, own = h1 @ o.T, (h1 * w).sum(1)
        if (h1 * h1).sum(1).max() * max((o * o).sum(1).max(), (w * w).sum(1).max()) > 2500:  # some score may be above 50
            top = np.maximum(own, z.max(1))
            z -= top[:, None]
            own -= top
        np.exp(z, out=z)
        z[hit, place[hit]] = 0
        own = np.exp(own)
        # with a column of ones for the bias the product has the sums of the others' values too
        ones = np.concatenate([o[:, :-1], np.ones((len(o), 1), kind)], 1)
        sums = z @ ones
        total = own + sums[:, -1] * scale
        loss = -np.log(own / total + 1e-30).mean()
        factor = (scale / (total * n))[:, None]
        d = ((own / total - 1) / n)[:, None]
        back = d * w[:, :-1] + sums[:, :-1] * factor
        to_pool = z.T @ (h1 * factor)
        np.add.at(to_pool, place[hit], d[hit] * h1[hit])
        rest = np.flatnonzero(pool[place] != true)
        ids, rows = by_row(true[rest], d[rest] * h1[rest])
        each = back.repeat(sizes, 0) * part
        return float(loss), {"in": by_row(flat, each), "weight": (np.concatenate([pool, ids]), np.concatenate([to_pool, rows]))}


@dataclass(frozen=True)
class OrderAwareSkipGram(Model):
    """A context table for each distance from -D to D, plus an embedding of the distance itself."""

    vocab: int
    size: int
    negatives: int = 5
    max_distance: int = 5
    pool: int = 16_384
    columns = ("center", "context", "distance")
    output = "in"
    pooled = "out"
    whole = ("position",)

    def shapes(self) -> dict[str, tuple[int, int]]:
        places = 2 * self.max_distance + 1
        return {"in": (self.vocab, self.size), "out": (places * self.vocab, self.size), "position": (places, self.size)}

    def row(self, distance: np.ndarray | Column, token: np.ndarray | Column) -> np.ndarray | Column:
        return (distance + self.max_distance) * self.vocab + token

    def touched(self) -> list[tuple[str, Column]]:
        return [("in", F.col("center")), ("out", self.row(F.col("distance").cast("long"), F.col("context")))]

    def rows(self, batch: tuple[np.ndarray, ...], rng: np.random.Generator, pool: np.ndarray | None = None) -> Rows:
        center, context, distance, *n = batch
        out = np.concatenate([self.row(distance, context)[:, None], self.draw((len(center), self.negatives), rng, pool)], 1)
        return {"center": ("in", center), "target": ("out", out), "place": ("position", out // self.vocab)} | _counts(n)

    def grads(self, p: Params, at: dict[str, np.ndarray]) -> tuple[float, Grads]:
        center, target, place = at["center"], at["target"], at["place"]
        o = p["out"][target] + p["position"][place]
        loss, d, back = _scored(p["in"][center], o, at.get("n"))
        flat = back.reshape(-1, self.size)
        return loss, {"in": by_row(center, np.einsum("nk,nkd->nd", d, o)), "out": by_row(target.ravel(), flat), "position": by_row(place.ravel(), flat)}

    def context_embeddings(self, p: Params, distance: int = 0) -> np.ndarray:
        at = distance + self.max_distance
        return p["out"][at * self.vocab : (at + 1) * self.vocab]


@dataclass(frozen=True)
class OrderAwareCbow(Model):
    """A context table for each distance, plus an embedding of the distance; their mean is scored against centers with negative draws."""

    vocab: int
    size: int
    negatives: int = 5
    max_distance: int = 5
    pool: int = 16_384
    columns = ("context", "distance", "center")
    output = "out"
    pooled = "out"
    whole = ("position",)

    def shapes(self) -> dict[str, tuple[int, int]]:
        places = 2 * self.max_distance + 1
        return {"in": (places * self.vocab, self.size), "out": (self.vocab, self.size), "position": (places, self.size)}

    def touched(self) -> list[tuple[str, Column]]:
        pairs = F.arrays_zip(F.col("context").alias("t"), F.col("distance").alias("d"))
        row = F.transform(F.filter(pairs, lambda x: x["t"] >= 0), lambda x: (x["d"].cast("long") + self.max_distance) * self.vocab + x["t"])
        return [("in", row), ("out", F.col("center"))]

    def rows(self, batch: tuple[np.ndarray, ...], rng: np.random.Generator, pool: np.ndarray | None = None) -> Rows:
        context, distance, center, *n = batch
        place = np.where(context >= 0, distance + self.max_distance, -1)
        row = np.where(context >= 0, place * self.vocab + context, -1)
        target = np.concatenate([center[:, None], self.draw((len(center), self.negatives), rng, pool)], 1)
        return {"context": ("in", row), "place": ("position", place), "target": ("out", target)} | _counts(n)

    def _mean(self, p: Params, row: np.ndarray, place: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = row >= 0
        share = _shares(there, n, p["in"].dtype)
        return np.einsum("nk,nkd->nd", share, p["in"][np.where(there, row, 0)] + p["position"][np.where(there, place, 0)]), there, share

    def grads(self, p: Params, at: dict[str, np.ndarray]) -> tuple[float, Grads]:
        row, place, target = at["context"], at["place"], at["target"]
        h, there, share = self._mean(p, row, place, at.get("n"))
        o = p["out"][target]
        loss, d, to_target = _scored(h, o)
        back = (np.einsum("nk,nkd->nd", d, o)[:, None, :] * share[:, :, None])[there].astype(o.dtype)
        return loss, {"out": by_row(target.ravel(), to_target.reshape(-1, self.size).astype(o.dtype)), "in": by_row(row[there], back), "position": by_row(place[there], back)}

    def context_embeddings(self, p: Params, distance: int = 0) -> np.ndarray:
        at = distance + self.max_distance
        return p["in"][at * self.vocab : (at + 1) * self.vocab]

    def predict_center(self, p: Params, context: np.ndarray, distance: np.ndarray, top_k: int = 5) -> np.ndarray:
        """For each row of contexts the `top_k` most likely centers, best first."""
        at = self.rows((context, distance, np.zeros(len(context), np.int64)), np.random.default_rng(0))
        scores = self._mean(p, at["context"][1], at["place"][1])[0] @ p["out"].T
        return np.lexsort((np.broadcast_to(np.arange(self.vocab), scores.shape), -scores))[:, :top_k]
