"""Data-parallel training with parameters that are a table.

The rows of data are sorted and cut into shards of equal size: the data of one
center lie in one shard, a center with more in shards of its own. Each epoch

1. every shard is joined with the parameter rows it needs, those that its data
   name and a pool for negative draws (`models`), so that no task and never the
   driver holds the parameters as a whole; their first values follow from the
   row number and are made where they are needed;
2. all shards train at the same time, one task each, from these rows;
3. what they changed is merged by row: the mean over the shards that changed
   it, weighted by the steps that did. With sorted data a center's vector comes
   from one shard; only context rows are means.

Shards, their order, pools and draws depend on data and seed alone, so equal
seeds give equal vectors on any number of machines. Deviations from one
process: means instead of synchronous steps, and Adam's moments start anew in
every shard and epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from triloom.operators.ranking import globally_indexed
from triloom.operators.skew import tasks_of
from triloom.session import drop, mark, release_since, written
from triloom.train.models import INIT_BLOCK, Model

ROWS_A_TASK = 250_000
FLOATS_A_TASK = 16_000_000  # parameters that a shard's data may name, at most; Adam triples them
CHUNK = 65_536  # values of a column in a packed row, about
ROW = "t int, row bigint, vec binary"


@dataclass
class Fit:
    """`params` has the rows (t, row, vec) of all tables: number of the table, row, and its values as 32-bit floats."""

    params: DataFrame
    model: Model
    losses: list[float] = field(default_factory=list)


class Adam:
    """Adam over the rows that a step touches."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, params: dict[str, np.ndarray], grads: dict) -> None:
        self.t += 1
        for name, (ids, g) in grads.items():
            if not len(ids):
                continue
            m, v = self.m[name].take(ids, 0), self.v[name].take(ids, 0)
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * (g * g)
            _put(self.m[name], ids, m)
            _put(self.v[name], ids, v)
            v /= 1 - 0.999**self.t
            np.sqrt(v, out=v)
            v += 1e-8
            m *= self.rate / (1 - 0.9**self.t)
            m /= v
            _put(params[name], ids, params[name].take(ids, 0) - m)


def _put(table: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Sets rows of a matrix, each as one value of its bytes: numpy sets them value by value else."""
    if not (table.flags.c_contiguous and table.dtype == rows.dtype and rows.size):
        table[ids] = rows
        return
    whole = np.dtype((np.void, table.shape[1] * table.itemsize))
    table.view(whole)[ids, 0] = np.ascontiguousarray(rows).view(whole)[:, 0]


class Lists:
    """Whole numbers in lists of any lengths, end to end. Picked rows come as a matrix, padded with -1 to the longest among them."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values, self.ends = values, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, pick: np.ndarray) -> np.ndarray:
        begin, n = self.ends[pick], self.ends[pick + 1] - self.ends[pick]
        out = np.full((len(pick), max(1, n.max(initial=0))), -1, np.int64)
        out[np.arange(out.shape[1]) < n[:, None]] = self.values[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return out

    def placed(self, ids: np.ndarray) -> Lists:
        """The places among `ids`, which are in order, of the numbers that aren't negative."""
        out = Lists(_placed(ids, self.values), np.zeros(0, np.int64))
        out.ends = self.ends
        return out


def _placed(ids: np.ndarray, rows: np.ndarray | Lists) -> np.ndarray | Lists:
    if isinstance(rows, Lists):
        return rows.placed(ids)
    if len(ids) and ids[0] == 0 and ids[-1] == len(ids) - 1:  # every row is at hand
        return rows
    return np.where(rows >= 0, np.searchsorted(ids, rows), -1)


def _packed(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """(shard, row, columns as bytes, lengths of lists as bytes): runs of rows, in the order of their first position `row`.

    An epoch moves and sorts these few rows instead of each row of data.
    """
    lists = {c: isinstance(sharded.schema[c].dataType, ArrayType) for c in columns}
    names = ["shard", "row", *columns, *[f"{c}_n" for c in columns if lists[c]]]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            shard, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = (shard[1:] != shard[:-1]) | (at[1:] != at[:-1] + 1)
            values, ends, sizes = [], [], []
            for j, c in enumerate(columns):
                x = b.column(2 + j)
                n = np.diff(x.offsets.to_numpy()) if lists[c] else np.ones(len(x), np.int32)
                values.append((x.flatten() if lists[c] else x).to_numpy(zero_copy_only=False))
                ends.append(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]))
                cut |= np.diff(ends[-1][:-1] // CHUNK) > 0
                if lists[c]:
                    sizes.append(n.astype(np.int32))
            bounds = [0, *(np.flatnonzero(cut) + 1).tolist(), b.num_rows]
            runs = list(zip(bounds[:-1], bounds[1:], strict=True))
            cols = [[v[e[i]:e[k]].tobytes() for i, k in runs] for v, e in zip(values, ends, strict=True)] + [[n[i:k].tobytes() for i, k in runs] for n in sizes]
            yield pa.RecordBatch.from_arrays([pa.array(shard[bounds[:-1]]), pa.array(at[bounds[:-1]]), *[pa.array(x, pa.binary()) for x in cols]], names=names)

    return written(sharded.select("shard", F.col("__i").alias("row"), *columns).mapInArrow(pack, "shard int, row bigint, " + ", ".join(f"`{n}` binary" for n in names[2:])), "packed")


def _floats(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column as one run of 32-bit floats."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32) if len(column) and offsets[-1] > offsets[0] else np.zeros(0, np.float32)


def _binary(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    m = np.ascontiguousarray(m, np.float32)
    ends = np.arange(len(m) + 1, dtype=np.int64) * m.shape[1] * 4
    if ends[-1] >= 1 << 31:
        raise ValueError("too many values for one batch")
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(m)])


def local_epoch(model: Model, ids: dict[str, np.ndarray], params: dict[str, np.ndarray], pool: np.ndarray | None, data: tuple[np.ndarray | Lists, ...], rate: float, batch_size: int, rng: np.random.Generator) -> tuple[float, dict[str, np.ndarray]]:
    """Steps over all rows in random order; the summed loss, and how many steps changed each row. Changes `params`, whose rows are those numbered `ids`, in order."""
    adam, n, total = Adam(params, rate), len(data[0]), 0.0
    steps = {k: np.zeros(len(v), np.float32) for k, v in params.items()}
    order = rng.permutation(n)
    direct = pool is not None and bool(model.tables)
    if direct:  # all rows are looked up once, and a batch has places at once
        pool = _placed(ids[model.pooled], pool)
        data = (*[_placed(ids[t], x) for t, x in zip(model.tables, data, strict=False)], *data[len(model.tables) :])
    for i in range(0, n, batch_size):
        pick = order[i : i + batch_size]
        wanted = model.rows(tuple(x[pick] for x in data), rng, pool)
        at = {role: r if t is None or direct else np.where(r >= 0, np.searchsorted(ids[t], r), -1) for role, (t, r) in wanted.items()}
        loss, grads = model.grads(params, at)
        adam.step(params, grads)
        for k, (rows, _) in grads.items():
            steps[k][rows] += 1
        total += loss * len(pick)
    return total, steps


def initial(spark: SparkSession, model: Model, seed: int) -> DataFrame:
    """All tables' first values, made where they are kept."""
    return written(_initial(spark, model, seed), "params")


def _initial(spark: SparkSession, model: Model, seed: int) -> DataFrame:
    names = list(model.shapes())
    ends = np.cumsum([-(-n // INIT_BLOCK) for n, _ in model.shapes().values()])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                k = int(np.searchsorted(ends, i, "right"))
                table, block = names[k], i - (int(ends[k - 1]) if k else 0)
                m = model.initial(table, block, seed)
                rows = np.arange(len(m), dtype=np.int64) + block * INIT_BLOCK
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), names.index(table), np.int32)), pa.array(rows), _binary(m)], names=["t", "row", "vec"])

    return spark.range(int(ends[-1])).mapInArrow(make, ROW)


def table(params: DataFrame, model: Model, name: str, into: str = "embedding", row: str = "token") -> DataFrame:
    """(row, vector as array<float>) of one table."""
    width = model.shapes()[name][1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * width
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(_floats(b.column(1))))], names=[row, into])

    own = params.where(F.col("t") == list(model.shapes()).index(name))
    return own.select(F.col("row").cast("int").alias(row), "vec").mapInArrow(read, f"{row} int, {into} array<float>")


def _sharded(data: DataFrame, model: Model, columns: list[str], rows_a_task: int | None) -> tuple[DataFrame, int, int]:
    """(shard, __i, columns), written, with the numbers of rows and shards; __i is the position in the order."""
    rows = written(data.select(*columns), "training")
    order = ["center", *[c for c in columns if c != "center"]]
    count = rows.count()
    if not count:
        return rows, 0, 0
    sizes = [F.size(c) if isinstance(rows.schema[c].dataType, ArrayType) else F.lit(1) for c in model.columns if c != "distance"]
    named = max(1.0, rows.select(F.avg(reduce(add, sizes))).first()[0])  # parameter rows that a row of data names
    size = rows_a_task or max(1, min(ROWS_A_TASK, int(FLOATS_A_TASK / (named * model.size))))
    shards = -(-count // size)
    # rows equal in all columns may be dealt to shards in any way: the last key only lets many of them be cut
    placed = globally_indexed(rows, [*[F.col(c) for c in order], F.monotonically_increasing_id()], "__i")
    return placed.select(F.expr(f"CAST(__i * {shards} DIV {count} AS INT)").alias("shard"), "__i", *columns), count, shards


def fit(data: DataFrame, model: Model, epochs: int = 5, rate: float = 0.0001, batch_size: int | None = None, seed: int = 42, rows_a_task: int | None = None, counted: bool = False) -> Fit:
    """Trains `model` on the columns it names. `batch_size` defaults to a hundredth of a shard's rows.

    A shard has at most `rows_a_task` rows (by default 250,000, fewer if its
    data could name more than `FLOATS_A_TASK` parameters). No rows leave the
    initial parameters. With `counted` the data have a column `n` too (`models`);
    losses are means over all pairs that rows stand for.
    """
    spark, point = data.sparkSession, mark()
    columns = [*model.columns, *(["n"] if counted else [])]
    sharded, count, shards = _sharded(data, model, columns, rows_a_task)
    if not count or not epochs:
        return Fit(initial(spark, model, seed), model)
    pairs = sharded.agg(F.sum("n")).first()[0] if counted and not isinstance(sharded.schema["n"].dataType, ArrayType) else count
    names = list(model.shapes())
    need = None
    for t, c in model.touched():
        is_list = isinstance(sharded.select(c.alias("x")).schema["x"].dataType, ArrayType)
        one = sharded.select("shard", (F.explode(c) if is_list else c).alias("row")).where("row >= 0").select("shard", F.lit(names.index(t)).alias("t"), F.col("row").cast("long").alias("row")).distinct()
        need = one if need is None else need.unionByName(one)
    for t in model.whole:
        every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(names.index(t)).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(model.shapes()[t][0] - 1).cast("long"))).alias("row"))
        need = need.unionByName(every)
    need = written(need.withColumn("pool", F.lit(False)), "touched")
    packed = _packed(sharded, columns)
    release_since(point, packed, need)
    lists = [isinstance(sharded.schema[c].dataType, ArrayType) for c in columns]
    kinds = [np.dtype(np.int64 if "bigint" in sharded.schema[c].dataType.simpleString() else np.int32) for c in columns]
    parts = max(tasks_of(spark), -(-sum(n * w for n, w in model.shapes().values()) // 16_000_000))
    params, losses = None, []
    for epoch in range(epochs):
        changed = written(_trained(packed, lists, kinds, need, params, model, shards, epoch, rate, batch_size, seed), "changed")
        losses.append(changed.where("t < 0").agg(F.sum("loss")).first()[0] / pairs)
        before = _initial(spark, model, seed) if params is None else params
        params = written(_merged(before, changed, model, parts), "params")
        drop(before, changed)
    return Fit(params, model, losses)


def _trained(packed: DataFrame, lists: list[bool], kinds: list[np.dtype], need: DataFrame, params: DataFrame | None, model: Model, shards: int, epoch: int, rate: float, batch_size: int | None, seed: int) -> DataFrame:
    """(t, row, vec, steps, shard, loss): the rows that shards changed; each shard's loss in a row with t = -1.

    Without `params`, in the first epoch, only row numbers are sent: a shard
    makes the first values of its rows itself. A pool that is the whole table
    isn't sent then either.
    """
    spark, names, columns = packed.sparkSession, list(model.shapes()), packed.columns[2:]
    of, (most, _) = names.index(model.pooled), model.shapes()[model.pooled]
    held_rows = min(most, model.held())
    drawn = F.sequence(F.lit(0).cast("long"), F.lit(held_rows - 1).cast("long"))
    if held_rows < most:
        drawn = F.array_distinct(F.transform(drawn, lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col("id"), i), F.lit(most))))
    pools = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(of).alias("t"), F.explode(drawn).alias("row"), F.lit(True).alias("pool"))
    whole = params is None and held_rows == most
    wanted = need if whole else need.unionByName(pools)  # a row of the pool that the data name too comes twice
    wanted = wanted.withColumn("vec", F.lit(None).cast("binary")) if params is None else wanted.join(params, ["t", "row"])
    rows = wanted.select("shard", F.lit(0).alias("kind"), "t", "row", "pool", "vec", *[F.lit(None).cast("binary").alias(c) for c in columns])
    own = packed.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("t"), "row", F.lit(None).cast("boolean").alias("pool"), F.lit(None).cast("binary").alias("vec"), *columns)
    each = rows.unionByName(own).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "t", "row", "pool")
    widths, first = [w for _, w in model.shapes().values()], params is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {i: [] for i in range(len(names))}
        data, shard = [], None
        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column(0)[0].as_py()
            kind = b.column(1).to_numpy()
            cut = int(np.searchsorted(kind, 1))
            p, d = b.slice(0, cut), b.slice(cut)
            if cut:
                t = p.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                for i in np.unique(t):
                    lo, hi = np.searchsorted(t, [i, i + 1])
                    part = p.slice(lo, hi - lo)
                    vec = None if first else _floats(part.column(5)).reshape(-1, widths[i]).copy()
                    held[i].append((part.column(3).to_numpy(zero_copy_only=False).astype(np.int64), part.column(4).to_numpy(zero_copy_only=False).astype(bool), vec))
            if d.num_rows:
                data += list(zip(*[d.column(6 + j).to_pylist() for j in range(len(columns))], strict=True))
        if shard is None or not data:
            return
        blobs = [b"".join(x) for x in zip(*data, strict=True)]
        data.clear()
        lengths = iter(blobs[len(lists) :])
        full = tuple(Lists(np.frombuffer(x, k), np.frombuffer(next(lengths), np.int32)) if is_list else np.frombuffer(x, k).astype(np.int64) for x, k, is_list in zip(blobs, kinds, lists, strict=False))
        ids, own, in_pool = {}, {}, None
        for i, n in enumerate(names):
            r = np.concatenate([x[0] for x in held[i]]) if held[i] else np.zeros(0, np.int64)
            last = np.r_[r[1:] != r[:-1], True] if len(r) else np.zeros(0, bool)  # of a row's two the one of the pool
            ids[n] = r[last]
            if i == of and whole:
                ids[n], in_pool = np.arange(most, dtype=np.int64), np.ones(most, bool)
            elif i == of:
                in_pool = np.concatenate([x[1] for x in held[i]])[last]
            if first:
                own[n] = model.initial_rows(n, ids[n], seed)
            else:
                own[n] = (np.concatenate([x[2] for x in held[i]]) if held[i] else np.zeros((0, widths[i]), np.float32))[last]
            held[i].clear()
        rng = np.random.default_rng([seed, epoch, shard])
        loss, steps = local_epoch(model, ids, own, ids[model.pooled][in_pool], full, rate, batch_size or max(1, len(full[0]) // 100), rng)
        out = ["t", "row", "vec", "steps", "shard", "loss"]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([b""]), pa.array([0.0], pa.float32()), pa.array([shard], pa.int32()), pa.array([loss])], names=out)
        for i, n in enumerate(names):
            hit = np.flatnonzero(steps[n])
            for k in range(0, len(hit), 10_000):
                h = hit[k : k + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), i, np.int32)), pa.array(ids[n][h]), _binary(own[n][h]), pa.array(steps[n][h]), pa.array(np.full(len(h), shard, np.int32)), pa.nulls(len(h), pa.float64())],
                    names=out,
                )

    return each.mapInArrow(run, f"{ROW}, steps float, shard int, loss double")


def _merged(before: DataFrame, changed: DataFrame, model: Model, parts: int) -> DataFrame:
    """The parameters after an epoch: rows no shard changed stay, the others are means weighted by steps."""
    widths = [w for _, w in model.shapes().values()]
    old = before.select("t", "row", "vec", F.lit(0.0).cast("float").alias("steps"), F.lit(-1).alias("shard"))
    new = changed.where("t >= 0").select("t", "row", "vec", "steps", "shard")
    sorted_ = old.unionByName(new).repartition(parts, "t", "row").sortWithinPartitions("t", "row", "shard")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple | None = None  # t, row, old vector, weighted sum, weight

        def out(t: int, rows: np.ndarray, old: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
            m = np.where(weights[:, None] > 0, sums / np.maximum(weights, 1)[:, None], old)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(rows), _binary(m)], names=["t", "row", "vec"])

        for b in batches:
            ts, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
            for t in np.unique(ts):
                lo, hi = (int(x) for x in np.searchsorted(ts, [t, t + 1]))
                v = _floats(b.column(2).slice(lo, hi - lo)).reshape(-1, widths[t]).astype(np.float64)
                r, w = rows[lo:hi], b.column(3).to_numpy()[lo:hi].astype(np.float64)
                begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                own, first = r[begin], v[begin]  # the old row comes first
                sums, weights = np.add.reduceat(v * w[:, None], begin), np.add.reduceat(w, begin)
                if carry is not None:
                    ct, cr, cold, csum, cw = carry
                    if ct == t and cr == own[0]:
                        first[0], sums[0], weights[0] = cold, sums[0] + csum, weights[0] + cw
                    else:
                        yield out(ct, np.array([cr]), cold[None], csum[None], np.array([cw]))
                carry = (int(t), own[-1], first[-1], sums[-1], weights[-1])
                if len(own) > 1:
                    yield out(int(t), own[:-1], first[:-1], sums[:-1], weights[:-1])
        if carry is not None:
            ct, cr, cold, csum, cw = carry
            yield out(ct, np.array([cr]), cold[None], csum[None], np.array([cw]))

    return sorted_.mapInArrow(merge, ROW)


def fit_mllib(tokens: DataFrame, size: int = 100, window: int = 5, min_count: int = 1, epochs: int = 1, rate: float = 0.025, seed: int = 42, partitions: int = 8) -> DataFrame:
    """(token, embedding): Spark ML's Word2Vec over the walks as sentences.

    It differs from the other models: hierarchical softmax, a window that
    shrinks at random, and rare words leave without a gap. Its parameters are
    held by the driver.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    walk = tokens.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("ts"))
    sentences = walk.select(F.transform("ts", lambda t: t["token"].cast("string")).alias("words"))
    m = Word2Vec(vectorSize=size, windowSize=window, minCount=max(1, min_count), maxIter=epochs, stepSize=rate, seed=seed, numPartitions=partitions, inputCol="words", outputCol="v").fit(sentences)
    return m.getVectors().select(F.col("word").cast("int").alias("token"), vector_to_array("vector", "float32").alias("embedding"))
