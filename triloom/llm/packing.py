"""Packing items into containers of fixed capacity: large items are matched in pairs, small ones fill the gaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 20_000


def pack(sizes: list[int], capacity: int) -> list[int]:
    """For each item the number of its bin; every size is at most the capacity.

    Items above a third of the capacity are large: at most two share a bin, so
    they are matched. From the largest down, each takes as partner the largest
    one left that fits beside it. The small items then go, largest first, into
    the bin with the smallest gap that holds them, or open a bin. Ties go to
    the item that comes first.
    """
    bins = [-1] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    cut = next((k for k, i in enumerate(order) if 3 * sizes[i] <= capacity), len(order))
    free: dict[int, list[int]] = {}
    sizes_free = 0  # bit s: a large item of size s is still alone
    for i in reversed(order[:cut]):
        free.setdefault(sizes[i], []).append(i)
        sizes_free |= 1 << sizes[i]
    gaps: dict[int, list[int]] = {}
    gap_bits, n = 0, 0  # bit g: there is a bin with gap g

    def take(s: int) -> int:
        nonlocal sizes_free
        i = free[s].pop()
        if not free[s]:
            sizes_free ^= 1 << s
        return i

    def leave(b: int, gap: int) -> None:
        nonlocal gap_bits
        gaps.setdefault(gap, []).append(b)
        gap_bits |= 1 << gap

    for i in order[:cut]:
        if bins[i] >= 0:
            continue
        take(sizes[i])  # the largest left, and the first of its size
        bins[i], room = n, capacity - sizes[i]
        fitting = sizes_free & ((1 << (room + 1)) - 1)
        if fitting:
            j = take(fitting.bit_length() - 1)
            bins[j], room = n, room - sizes[j]
        leave(n, room)
        n += 1
    for i in order[cut:]:
        s = sizes[i]
        above = gap_bits >> s
        if above:
            g = s + (above & -above).bit_length() - 1
            b = gaps[g].pop()
            if not gaps[g]:
                gap_bits ^= 1 << g
        else:
            b, g, n = n, capacity, n + 1
        bins[i] = b
        leave(b, g - s)
    return bins


def packed(sizes: DataFrame, containers: DataFrame, item: str = "doc_id", size: str = "tokens", container: str = "container", capacity: str = "capacity_tokens", group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container, bin_id, item, piece, size_from, size_to, size): all items packed once for each kind of container.

    An item larger than the container is split: pieces of the full capacity,
    each in a container of its own, and a rest that is packed as an item. No
    other item is split. Items without size (empty texts) go where there is a
    gap. Items are dealt by hash into groups of about `group_items`, each
    packed by one task; with so many items a group's waste is that of the
    whole. Containers whose capacity isn't positive, and rows with a null item,
    are left out. Other columns are ignored.
    """
    items = sizes.where(F.col(item).isNotNull()).select(F.col(item).alias("i"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    groups = max(1, -(-items.count() // group_items))
    kinds = containers.where(F.col(capacity) > 0).select(F.col(container).alias("c"), F.col(capacity).cast("bigint").alias("cap")).collect()  # a few fixed rows
    kind_i, kind_c = sizes.schema[item].dataType.simpleString(), containers.schema[container].dataType.simpleString()
    if not kinds:
        return sizes.sparkSession.createDataFrame([], f"{container} {kind_c}, bin_id string, {item} {kind_i}, piece int, size_from bigint, size_to bigint, {size} bigint")
    kind = F.explode(F.array(*[F.struct(F.lit(r["c"]).cast(kind_c).alias("c"), F.lit(r["cap"]).cast("bigint").alias("cap")) for r in kinds]))
    each = items.withColumn("kind", kind).select("i", "n", "kind.c", "kind.cap")
    each = each.withColumn("full", F.floor((F.col("n") - 1) / F.col("cap")).cast("bigint")).withColumn("full", F.greatest("full", F.lit(0)))
    full = each.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))))
    full = full.select("c", F.concat(F.lit("s"), F.col("i").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin_id"), "i", "piece", (F.col("piece") * F.col("cap")).alias("size_from"), ((F.col("piece") + 1) * F.col("cap")).alias("size_to"), F.col("cap").alias("n"))
    rest = each.select("c", "cap", "i", F.col("full").cast("int").alias("piece"), (F.col("n") - F.col("full") * F.col("cap")).alias("n"), F.pmod(F.xxhash64("i"), F.lit(groups)).cast("int").alias("g"))

    def solve(t: pa.Table) -> pa.Table:
        cap, g = t.column("cap")[0].as_py(), t.column("g")[0].as_py()
        t = t.sort_by([("i", "ascending"), ("piece", "ascending")])  # the same result in whatever order rows arrive
        n, piece = t.column("n").to_numpy(), t.column("piece").to_numpy()
        bins = pack(n.tolist(), cap)
        begin = piece.astype(np.int64) * cap
        cols = [t.column("c"), pa.array([f"g{g}-{b}" for b in bins]), t.column("i"), t.column("piece"), pa.array(begin), pa.array(begin + n), t.column("n")]
        return pa.table(cols, names=["c", "bin_id", "i", "piece", "size_from", "size_to", "n"])

    solved = rest.groupBy("c", "g").applyInArrow(solve, f"c {kind_c}, bin_id string, i {kind_i}, piece int, size_from bigint, size_to bigint, n bigint")
    out = full.select("c", "bin_id", "i", "piece", "size_from", "size_to", "n").unionByName(solved)
    return out.select(F.col("c").alias(container), "bin_id", F.col("i").alias(item), "piece", "size_from", "size_to", F.col("n").alias(size))


def fill(packing: DataFrame, containers: DataFrame, container: str = "container", capacity: str = "capacity_tokens", size: str = "tokens") -> DataFrame:
    """(container, bins, used, unused, filled): how full the containers of each kind are."""
    per_bin = packing.groupBy(container, "bin_id").agg(F.sum(size).alias("n"))
    total = per_bin.groupBy(container).agg(F.count("*").alias("bins"), F.sum("n").alias("used"))
    room = F.col("bins") * F.col(capacity)
    return total.join(containers, container).select(container, "bins", "used", (room - F.col("used")).alias("unused"), (F.col("used") / room).alias("filled"))
