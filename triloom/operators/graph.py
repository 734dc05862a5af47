"""The directed multigraph as an indexed edge table, and its metrics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from triloom.functions.hashing import draw32
from triloom.operators import skew
from triloom.operators.ranking import globally_indexed, indexed_within
from triloom.session import drop, mark, release_since, written

WEIGHT_SCALE = 1000  # weights become whole numbers, so that running sums are the same everywhere


def vertices(edges: DataFrame) -> DataFrame:
    """(vertex): subjects and objects."""
    return edges.select(F.explode(F.array("subject", "object")).alias("vertex")).distinct()


def whole_weight(weights: str = "weights") -> Column:
    """Weights as whole numbers; null is 0, a negative one an error."""
    bad = F.raise_error(F.lit("weights must not be negative")).cast("bigint")
    return F.coalesce(F.when(F.col(weights) < 0, bad).otherwise(F.round(F.col(weights) * WEIGHT_SCALE).cast("bigint")), F.lit(0))


def out_index(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """Edges with `out_idx` (from 0, by object and predicate) and `out_deg` of their subject.

    `weighted` adds whole-number weights `w`, their running sum `cum_w` and
    total `tot_w`. A null weight is 0; an edge of weight 0 is never drawn; a
    negative weight is an error.
    """
    e = edges.select("subject", "predicate", "object", *(["weights"] if weighted else []))
    order = [F.col("object"), F.col("predicate")]
    if not weighted:
        return indexed_within(e, "subject", order, "out_idx", "out_deg")
    return indexed_within(e.withColumn("w", whole_weight()).drop("weights"), "subject", [*order, F.col("w")], "out_idx", "out_deg", "w")


def walk_table(edges: DataFrame, weighted: bool = False, steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What walks need, as two written tables: vertices with edges, and edges by position.

    Edges have positions in the order of subject, object and predicate; those
    of a vertex are the `deg` ones from `first` on. A step draws a position, so
    its join key is unique among the edges and a hub is no heavier a key than
    any other vertex. Each edge carries `first` and `deg` of its object, so a
    step needs no other join. Walks that take at most `steps` steps on from
    what they reach, for each vertex, may be fewer than the edges: then they
    look their vertices up themselves, and edges carry nothing.

    `sole` tells that surely no other edge runs between the same two vertices;
    it is there without weights, since an edge of weight 0 has no position.

    Weighted, positions are of slots: the range of weights of each vertex is
    cut into as many equal slots as it has edges with weight, and an edge has a
    row for each slot it reaches into, two on average. `base` and `tot` are
    where the vertex's weights begin in the running sum `run` of all edges, and
    how much they are.

    Vertices: (v, first, deg[, base, tot]). Edges: (pos, subject, predicate,
    object[, next_first, next_deg][, w, run, next_base, next_tot][, sole]).
    """
    e = edges.select("subject", "predicate", "object", *(["weights"] if weighted else []))
    order = [F.col("subject"), F.col("object"), F.col("predicate")]
    own, more = [F.min("pos").alias("first"), F.count("*").alias("deg")], []
    if weighted:
        e = e.withColumn("w", whole_weight()).drop("weights").where("w > 0")
        g = globally_indexed(e, [*order, F.col("w")], "pos", ("w", "run"))
        own += [F.min(F.col("run") - F.col("w")).alias("base"), F.sum("w").alias("tot")]
    else:
        g = globally_indexed(e, order, "pos")
        more = ["sole"]
    v = written(g.groupBy(F.col("subject").alias("v")).agg(*own), "walk-vertices")
    n, total = v.agg(F.count("*"), F.coalesce(F.sum("deg"), F.lit(0))).first()
    carried = steps is None or n * steps >= total
    if weighted:
        g = skew.join_by_key(g, v, F.col("subject"), F.col("v"), plan=skew.plan_from_counts(v, "v", "deg", total), spread=[F.col("pos")])
        part = lambda at: F.expr(f"CAST(({at}) - base AS DECIMAL(19,0)) * CAST(deg AS DECIMAL(19,0)) DIV CAST(tot AS DECIMAL(19,0))")
        slots = F.sequence(part("run - w").cast("bigint"), part("run - 1").cast("bigint"))
        g = g.withColumn("__slot", F.explode(slots)).withColumn("pos", F.col("first") + F.col("__slot")).drop("v", "first", "deg", "base", "tot", "__slot")
        more = ["w", "run", *(["next_base", "next_tot"] if carried else [])]
    else:
        g = _sole_marked(g)
    if not carried:
        return v, written(g.select("pos", "subject", "predicate", "object", *more), "walk-table")
    nexts = v.select(F.col("v").alias("__v"), *[F.col(c).alias(f"next_{c}") for c in v.columns if c != "v"])
    joined = skew.join_by_key(g, nexts, F.col("object"), F.col("__v"), "left", spread=[F.col("pos")])
    return v, written(joined.select("pos", "subject", "predicate", "object", "next_first", "next_deg", *more), "walk-table")


def _sole_marked(g: DataFrame) -> DataFrame:
    """Adds `sole` to edges by position: whether both neighbours in the order are seen beside it and run between other vertices.

    Parallel edges are neighbours. An edge at the end of a batch has a
    neighbour that isn't seen and counts as one of several.
    """

    def mark_sole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(names.index("pos")).to_numpy()
            other = np.zeros(b.num_rows + 1, bool)
            if b.num_rows > 1:
                s, o = (b.column(names.index(c)) for c in ("subject", "object"))
                same = pc.and_(pc.equal(s[1:], s[:-1]), pc.equal(o[1:], o[:-1])).to_numpy(zero_copy_only=False)
                other[1:-1] = (at[1:] == at[:-1] + 1) & (same == False)  # noqa: E712
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(other[1:] & other[:-1])], names=[*names, "sole"])

    names = g.columns
    return g.mapInArrow(mark_sole, StructType([*g.schema.fields, StructField("sole", BooleanType())]))


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, in_degree, out_degree, degree); rows count, parallel edges too."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("subject").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("vertex"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    d = ends.groupBy("vertex").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def metrics(edges: DataFrame) -> DataFrame:
    """One row: number_nodes, number_edges, avg_degree, min_degree, max_degree, density E / (V (V - 1)). No edges give 0 nodes and null degrees."""
    d = degrees(edges).agg(F.count("*").alias("number_nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("number_edges"), F.avg("degree").alias("avg_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    v = F.col("number_nodes").cast("double")
    return d.withColumn("density", F.when(v > 1, F.col("number_edges") / (v * (v - 1))))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """(degree, vertices)."""
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("vertices"))


@dataclass
class SimpleGraph:
    """Edges (subject, object) without parallel ones, as a written table, and how their hubs are split in joins on the subject."""

    edges: DataFrame
    plan: skew.ShardPlan

    @classmethod
    def of(cls, edges: DataFrame, loops: bool = True) -> SimpleGraph:
        e = edges.select("subject", "object").where("subject IS NOT NULL AND object IS NOT NULL")
        e = written((e if loops else e.where("subject <> object")).distinct(), "simple-edges")
        return cls(e, skew.plan_shards(e, F.col("subject")))

    def step(self, level: DataFrame) -> DataFrame:
        """`level` (start, v, ...) with every edge that leaves v, as `object`."""
        return skew.join_by_key(self.edges, level, F.col("subject"), F.col("v"), plan=self.plan, spread=[F.col("object")]).drop("subject")


def bfs_levels(g: SimpleGraph, starts: DataFrame, depth: int | None = None) -> list[DataFrame]:
    """Breadth-first trees of all `starts` (start): for each depth a written table (start, v, parent).

    All starts advance together, one level a round. Of several parents at equal
    depth a vertex keeps the smallest. The state has a row of three numbers for
    each start and vertex it reaches: hand over starts in blocks.
    """
    first = starts.select("start", F.col("start").alias("v"), F.lit(None).cast(starts.schema["start"].dataType).alias("parent"))
    levels = [written(first, "bfs-0")]
    seen = levels[0].select("start", "v")
    while depth is None or len(levels) <= depth:
        near = g.step(levels[-1].select("start", "v")).groupBy("start", F.col("object").alias("new")).agg(F.min("v").alias("parent"))
        near = near.join(seen.select(F.col("start").alias("__s"), F.col("v").alias("__v")), (F.col("start") == F.col("__s")) & (F.col("new") == F.col("__v")), "left_anti")
        near = written(near.select("start", F.col("new").alias("v"), "parent"), f"bfs-{len(levels)}")
        if not near.head(1):
            drop(near)
            break
        levels.append(near)
        seen = seen.unionByName(near.select("start", "v"))
    return levels


def start_blocks(starts: DataFrame, size: int) -> Iterator[DataFrame]:
    """The distinct starts that aren't null, in blocks of at most `size`."""
    s = starts.toDF("start").where("start IS NOT NULL").distinct()
    placed = globally_indexed(s, [F.col("start")], "__i")
    for block in range(-(-placed.count() // size)):
        yield placed.where((F.col("__i") >= block * size) & (F.col("__i") < (block + 1) * size)).select("start")


def betweenness(edges: DataFrame, sources: DataFrame | None = None, sources_a_block: int = 1000) -> DataFrame:
    """(vertex, betweenness), unnormalised, over the simple graph without parallel edges and loops.

    The sum over `sources`, by default over all vertices, in blocks: those of a
    block advance together, one level a round, path counts forward and then
    dependencies backward. A block's state has a row for each of its sources
    and vertex it reaches, and is removed when its sums are written.
    """
    g = SimpleGraph.of(edges, loops=False)
    v = vertices(edges)
    sums = None
    for block in start_blocks(v if sources is None else sources, sources_a_block):
        point = mark()
        part = written(_dependencies(g, block).groupBy("vertex").agg(F.sum("b").alias("b")), "betweenness")
        release_since(point, part)
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return v.withColumn("betweenness", F.lit(0.0))
    total = sums.groupBy("vertex").agg(F.sum("b").alias("b"))
    return v.join(total, "vertex", "left").select("vertex", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _dependencies(g: SimpleGraph, starts: DataFrame) -> DataFrame:
    """(vertex, b): for each start what its shortest paths give the vertices inside them."""
    levels = [written(starts.select("start", F.col("start").alias("v"), F.lit(1.0).alias("sigma")), "level")]
    seen = levels[0].select("start", "v")
    while True:
        near = g.step(levels[-1]).groupBy("start", F.col("object").alias("v")).agg(F.sum("sigma").alias("sigma"))
        near = written(near.join(seen, ["start", "v"], "left_anti"), "level")
        if not near.head(1):
            break
        levels.append(near)
        seen = seen.unionByName(near.select("start", "v"))
    below = None  # (start, v, sigma, delta) of the level beneath
    out = starts.select(F.col("start").alias("vertex"), F.lit(0.0).alias("b"))
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k]
        if below is None:
            here = here.withColumn("delta", F.lit(0.0))
        else:
            b = below.select(F.col("start").alias("bs"), F.col("v").alias("bv"), ((1 + F.col("delta")) / F.col("sigma")).alias("part"))
            got = g.step(here.select("start", "v")).join(b, (F.col("start") == F.col("bs")) & (F.col("object") == F.col("bv"))).groupBy("start", "v").agg(F.sum("part").alias("p"))
            here = here.join(got, ["start", "v"], "left").select("start", "v", "sigma", (F.col("sigma") * F.coalesce("p", F.lit(0.0))).alias("delta"))
        below = written(here, "delta")
        out = out.unionByName(below.select(F.col("v").alias("vertex"), F.col("delta").alias("b")))
    return out


def sampled_vertices(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(start): n vertices, or all if there are fewer: those of the smallest draws."""
    v = vertices(edges).where("vertex IS NOT NULL")
    return v.orderBy(draw32(F.lit(seed), F.col("vertex")), "vertex").limit(n).select(F.col("vertex").alias("start"))


def graph_statistics(edges: DataFrame, sources: int | None = None, seed: int = 42, sources_a_block: int = 1000) -> DataFrame:
    """One row: mean_degree_centrality, number_nodes, number_edges, density, mean_betweenness, betweenness_error; centralities unnormalised.

    The mean betweenness needs no path counts: over all vertices betweenness
    adds up to the distances less one of all pairs that reach each other. With
    `sources` only so many random sources are searched and stand for all;
    `betweenness_error` then is the standard error of the mean over sources,
    else 0. Without edges the means are null.
    """
    g = SimpleGraph.of(edges, loops=False)
    chosen = vertices(edges) if sources is None else sampled_vertices(edges, sources, seed)
    parts = None
    for block in start_blocks(chosen, sources_a_block):
        point = mark()
        levels = bfs_levels(g, block)
        each = [lv.select("start", F.lit(max(0, d - 1)).alias("d")) for d, lv in enumerate(levels)]
        part = written(reduce(DataFrame.unionByName, each).groupBy("start").agg(F.sum("d").cast("double").alias("d")), "distances")
        release_since(point, part)
        parts = part if parts is None else parts.unionByName(part)
    m = metrics(edges).select(F.col("avg_degree").alias("mean_degree_centrality"), "number_nodes", "number_edges", "density")
    if parts is None:
        return m.select("*", F.lit(None).cast("double").alias("mean_betweenness"), F.lit(None).cast("double").alias("betweenness_error"))
    # each source stands for V / k others; the mean divides by V again
    error = F.lit(0.0) if sources is None else F.coalesce(F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.0))
    b = parts.agg(F.avg("d").alias("mean"), error.alias("error")).first()
    return m.select("*", F.lit(b["mean"]).alias("mean_betweenness"), F.lit(b["error"]).alias("betweenness_error"))


def top_k_by_degree(edges: DataFrame, k: int) -> DataFrame:
    """The k vertices of highest degree; ties go to the smaller vertex."""
    return degrees(edges).orderBy(F.desc("degree"), "vertex").limit(k)

