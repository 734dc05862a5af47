"""Walks over the indexed edge table: uniform, by weight, and breadth-first.

Every walk advances one hop a round, all walks together. A round is one join
on the position of the drawn edge, so a hub's edges and the walks that leave it
spread over many keys; positions that many walks draw (at vertices with few
edges) are split by estimated load. Each round's hops are a written table: the next
round starts from it, and no lineage grows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triloom.functions.hashing import draw32
from triloom.operators import graph, skew
from triloom.session import mark, release_since, written

HOP = ["walk_id", "step", "src", "predicate", "dst"]


def replicated(starts: DataFrame, walk_number: int) -> DataFrame:
    """(walk_id, start, k): each distinct start `walk_number` times; walk_id is start * walk_number + k."""
    s = starts.toDF("start").where("start IS NOT NULL").distinct()
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(walk_number - 1))))
    return s.select(walk_number_of(walk_number).alias("walk_id"), "start", "k")


def random_walks(edges: DataFrame, starts: DataFrame | None = None, depth: int = 4, walk_number: int = 100, seed: int = 42, weighted: bool = False, multi_edge: str = "fanout", hashing: str = "xxhash64") -> DataFrame:
    """(walk_id, step, src, predicate, dst): the hops of walks of at most `depth` hops.

    Edges are drawn uniformly, parallel ones each for itself, or in proportion
    to `weights`. A walk ends where no edge leaves; a start without edges has
    no rows. `multi_edge`: with `fanout` a hop has a row for each edge between
    its two vertices, with `sample` only for the one drawn; with `counted` it
    has one row that counts these edges (`counted`). The draw depends on seed,
    start, number of the walk and step alone.
    """
    if multi_edge not in ("fanout", "sample", "counted"):
        raise ValueError("multi_edge must be fanout, sample or counted")
    if depth < 1 or walk_number < 1:
        raise ValueError("depth and walk_number must be at least 1")
    v, table = graph.walk_table(edges, weighted, walk_number * (depth - 1))
    here = v.columns[1:]
    s = v if starts is None else starts.toDF("__start").where("__start IS NOT NULL").distinct().join(v, F.col("__start") == F.col("v"))
    front = s.withColumnRenamed("v", "start").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(walk_number - 1))))
    carried, columns = f"next_{here[0]}" in table.columns, HOP if weighted else [*HOP, "sole"]
    keep = ["walk_id", "start", "k", "src", "at", *(["target"] if weighted else [])]
    front = front.withColumn("walk_id", walk_number_of(walk_number)).withColumn("src", F.col("start"))
    front = _drawn(front, seed, 0, weighted, hashing).select(*keep)
    hops = []
    for step in range(depth):
        # before the first step each start has the same number of walks; later many may have drawn the same position
        hop = skew.join_by_key(front, table, F.col("at"), F.col("pos"), spread=[F.col("walk_id")]) if step else front.join(table, F.col("at") == F.col("pos"))
        if weighted:
            hop = hop.where((F.col("run") - F.col("w") <= F.col("target")) & (F.col("target") < F.col("run")))
        hop = hop.withColumn("step", F.lit(step)).withColumnRenamed("object", "dst").select(*columns, "start", "k", *[F.col(f"next_{c}").alias(c) for c in here if carried])
        if carried:
            hop = _drawn(hop, seed, step + 1, weighted, hashing).select(*columns, *[c for c in keep if c not in columns])
        hop = written(hop, f"hops-{step}")
        hops.append(hop.select(*columns))
        if step + 1 == depth:
            break
        front = (hop.where("at IS NOT NULL") if carried else hop).drop("src").withColumnRenamed("dst", "src")
        if not carried:
            front = skew.join_by_key(front.select("walk_id", "start", "k", "src"), v, F.col("src"), F.col("v"), spread=[F.col("walk_id")])
            front = written(_drawn(front, seed, step + 1, weighted, hashing).select(*keep), f"front-{step}")
        front = front.select(*keep)
    out = reduce(DataFrame.unionByName, hops)
    if multi_edge == "sample":
        return out.select(*HOP)
    if weighted:
        return _all_edges(out.drop("predicate"), edges, multi_edge)
    # most edges have no parallel ones: their hops need no join
    several = _all_edges(out.where("NOT sole").drop("predicate", "sole"), table.where("NOT sole"), multi_edge)
    alone = out.where("sole").select(*HOP)
    if multi_edge == "counted":
        one = F.lit(1).cast("bigint").alias("n")
        alone = alone.select("walk_id", "step", "src", "dst", F.array(F.struct("predicate", one)).alias("predicates"), one)
    return several.unionByName(alone)


def walk_number_of(walk_number: int) -> Column:
    return F.col("start").cast("bigint") * walk_number + F.col("k")


def _drawn(front: DataFrame, seed: int, step: int, weighted: bool, hashing: str) -> DataFrame:
    """Adds the position `at` that the step draws, weighted also the place `target` in the running sum of weights."""
    f = front.withColumn("h", draw32(F.lit(seed), F.col("start"), F.col("k"), F.lit(step), method=hashing))
    if not weighted:
        return f.withColumn("at", F.col("first") + F.pmod("h", F.col("deg")))
    f = f.withColumn("__t", F.expr("CAST(h AS DECIMAL(19,0)) * CAST(tot AS DECIMAL(19,0)) DIV CAST(4294967296 AS DECIMAL(10,0))"))
    slot = F.expr("CAST(__t AS DECIMAL(19,0)) * CAST(deg AS DECIMAL(19,0)) DIV CAST(tot AS DECIMAL(19,0))")
    return f.withColumn("at", F.col("first") + slot).withColumn("target", F.col("base") + F.col("__t"))


def fanned_out(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """Hops (walk_id, step, src, dst) with a row for each edge between src and dst. Heavy pairs of vertices are split over the tasks."""
    key = lambda a, b: F.xxhash64(a, b)
    e = edges.select(F.col("subject").alias("__s"), "predicate", F.col("object").alias("__o"))
    j = skew.join_by_key(hops, e, key("src", "dst"), key("__s", "__o"), spread=[F.col("walk_id"), F.col("step")])
    return j.where("src = __s AND dst = __o").select(*HOP)


def counted(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """(walk_id, step, src, dst, predicates, n): each hop once, however many edges run between its vertices.

    `predicates` has (predicate, n) for each predicate between src and dst, and
    `n` is the number of all these edges: the rows that `fanned_out` has.
    """
    key = lambda a, b: F.xxhash64(a, b)
    met = hops.select(F.col("src").alias("__a"), F.col("dst").alias("__b")).distinct()
    e = edges.select(F.col("subject").alias("__s"), F.col("object").alias("__o"), "predicate")
    # only edges that a walk took are counted
    e = skew.join_by_key(e, met, key("__s", "__o"), key("__a", "__b"), spread=[F.col("predicate")]).where("__s = __a AND __o = __b")
    e = e.groupBy("__s", "__o", "predicate").agg(F.count("*").alias("n"))
    e = e.groupBy("__s", "__o").agg(F.collect_list(F.struct("predicate", "n")).alias("predicates"), F.sum("n").alias("n"))
    j = skew.join_by_key(hops, e, key("src", "dst"), key("__s", "__o"), spread=[F.col("walk_id"), F.col("step")])
    return j.where("src = __s AND dst = __o").select("walk_id", "step", "src", "dst", "predicates", "n")


def _all_edges(hops: DataFrame, edges: DataFrame, multi_edge: str) -> DataFrame:
    return counted(hops, edges) if multi_edge == "counted" else fanned_out(hops, edges)


START_BLOCK = 1000


def _leaves(levels: list[DataFrame]) -> DataFrame:
    """(start, leaf, parent, depth): the vertices of breadth-first trees that are no other's parent."""
    tree = reduce(DataFrame.unionByName, [lv.withColumn("depth", F.lit(d)) for d, lv in enumerate(levels)])
    inner = tree.where("parent IS NOT NULL").select(F.col("start").alias("__s"), F.col("parent").alias("__p")).distinct()
    return tree.join(inner, (F.col("start") == F.col("__s")) & (F.col("v") == F.col("__p")), "left_anti").select("start", F.col("v").alias("leaf"), "parent", "depth")


def _blocks(edges: DataFrame, starts: DataFrame | None, depth: int, starts_a_block: int | None, make: Callable[[list[DataFrame]], DataFrame], schema: str) -> DataFrame:
    """What `make` gives of the breadth-first trees of each block of starts, together; a block's trees are removed when it is written."""
    g = graph.SimpleGraph.of(edges)
    out = None
    for block in graph.start_blocks(graph.vertices(edges) if starts is None else starts, starts_a_block or START_BLOCK):
        point = mark()
        part = written(make(graph.bfs_levels(g, block, depth)), "bfs-block")
        release_since(point, part)
        out = part if out is None else out.unionByName(part)
    return edges.sparkSession.createDataFrame([], schema) if out is None else out


def bfs_leaves(edges: DataFrame, starts: DataFrame | None = None, depth: int = 4, starts_a_block: int | None = None) -> DataFrame:
    """(start, leaf, depth): the leaves of each start's breadth-first tree. A start without edges is its own leaf."""
    v = edges.schema["subject"].dataType.simpleString()
    return _blocks(edges, starts, depth, starts_a_block, lambda levels: _leaves(levels).select("start", "leaf", "depth"), f"start {v}, leaf {v}, depth int")


def _tree_hops(levels: list[DataFrame]) -> DataFrame:
    """(start, leaf, step, src, dst): the hops from start to each leaf, collected from the leaves up.

    Near the start many leaves share a vertex; such keys are split by estimated
    load.
    """
    leaves = written(_leaves(levels), "leaves")
    up, hops = None, []
    for d in range(len(levels) - 1, 0, -1):
        here = leaves.where(F.col("depth") == d).select("start", "leaf", F.col("leaf").alias("v"), "parent")
        if up is not None:
            lv = levels[d].select(F.col("start").alias("__s"), F.col("v").alias("__v"), "parent")
            met = skew.join_by_key(up, lv, F.xxhash64("start", "v"), F.xxhash64("__s", "__v"), spread=[F.col("leaf")])
            here = here.unionByName(met.where("start = __s AND v = __v").select("start", "leaf", "v", "parent"))
        here = written(here, f"up-{d}")
        hops.append(here.select("start", "leaf", F.lit(d - 1).alias("step"), F.col("parent").alias("src"), F.col("v").alias("dst")))
        up = here.select("start", "leaf", F.col("parent").alias("v"))
    if not hops:
        return leaves.limit(0).select("start", "leaf", F.lit(0).alias("step"), F.col("parent").alias("src"), F.col("leaf").alias("dst"))
    return reduce(DataFrame.unionByName, hops)


def bfs_walks(edges: DataFrame, starts: DataFrame | None = None, depth: int = 4, order: str = "path", starts_a_block: int | None = None, multi_edge: str = "fanout") -> DataFrame:
    """(walk_id, step, src, predicate, dst): one walk for each leaf of each start's breadth-first tree, with a row for each parallel edge.

    With `multi_edge="counted"` a hop has one row that counts these edges (`counted`).

    walk_id is start * 2^31 + leaf. Hops are numbered from the start, or with
    `order="subject"` by the token of their source. Starts are taken in blocks
    of `starts_a_block` (by default 1000), which bounds the state to a block's
    trees. A start without edges has no walk.
    """
    if order not in ("path", "subject"):
        raise ValueError("order must be path or subject")
    if multi_edge not in ("fanout", "counted"):
        raise ValueError("multi_edge must be fanout or counted")
    v = edges.schema["subject"].dataType.simpleString()
    h = _blocks(edges, starts, depth, starts_a_block, _tree_hops, f"start {v}, leaf {v}, step int, src {v}, dst {v}")
    hops = h.select((F.col("start").cast("bigint") * (1 << 31) + F.col("leaf")).alias("walk_id"), "step", "src", "dst")
    if order == "subject":  # a walk has at most `depth` hops
        hops = hops.withColumn("step", F.row_number().over(Window.partitionBy("walk_id").orderBy("src", "dst")) - 1)
    return _all_edges(hops, edges, multi_edge)


def from_sequences(visits: DataFrame, walk: str = "walk_id", pos: str = "pos", vertex: str = "vertex") -> DataFrame:
    """(walk_id, step, src, dst) of imported vertex sequences: each visit with the next of its own walk.

    Null and negative vertices are padding. A walk's last visit has no hop, and
    a hop never leads into another walk.
    """
    v = visits.where(f"{vertex} >= 0").select(F.col(walk).alias("walk_id"), F.col(pos).alias("__p"), F.col(vertex).alias("src"))
    own = Window.partitionBy("walk_id").orderBy("__p", "src")
    h = v.withColumn("step", (F.row_number().over(own) - 1).cast("int")).withColumn("dst", F.lead("src").over(own))
    return h.where("dst IS NOT NULL").select("walk_id", "step", "src", "dst")
