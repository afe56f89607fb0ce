"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

# Groups scheduled by one task, and rows numbered by one task.
BUCKET_GROUPS = 20_000
NUMBERED_ROWS = 50_000
# A group of at least 1 / (this * shards) of all bytes is placed before the others;
# there can be no more than this * shards of them.
HEAVY_PARTS = 16


def schedule(sizes: Iterable[float], loads: list[float]) -> list[int]:
    """The shard of each size: largest first, each to the least loaded shard.

    ``loads`` are what the shards hold at the start. Ties of size keep their order,
    ties of load go to the lower shard.
    """
    sizes = list(sizes)
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, shard = heap[0]
        placed[i] = shard
        heapq.heapreplace(heap, (load + sizes[i], shard))
    return placed


def shard_groups(groups: DataFrame, shards: int, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(group, shard) for a stored table of distinct (group, bytes), near equal bytes a shard.

    Heavy groups, whose number is bounded by the number of shards, are scheduled first
    in one heap. The others go to random buckets of bounded size; every bucket has a
    heap of its own that starts with the bucket's share of the heavy loads, so that all
    buckets fill up what the heavy groups left uneven, and adds an unevenness of about
    its smallest group. A group over ``1 / shards`` of all bytes cannot be evened out.
    """
    total, count = groups.agg(F.sum("bytes"), F.count("*")).first()
    least = (total or 0) / (HEAVY_PARTS * shards)
    # the group of null, if there is one, is placed with them
    is_heavy = (F.col("bytes") >= F.lit(float(max(least, 1)))) | F.col("group").isNull()
    heavy = sorted(groups.where(is_heavy).collect(), key=lambda r: (-r["bytes"], r["group"] is None, r["group"]))
    loads = [0.0] * shards
    placed = schedule([r["bytes"] for r in heavy], loads)
    for r, s in zip(heavy, placed):
        loads[s] += r["bytes"]
    light = float((total or 0) - sum(loads))
    buckets = max(1, -(-(count or 0) // bucket_groups))
    kind = groups.schema["group"].dataType.simpleString()

    def fill(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["bytes", "group"], ascending=[False, True], kind="stable")
        sizes = bucket["bytes"].to_numpy(np.float64)
        share = sizes.sum() / light if light else 0.0
        # what the heavy loads are above the lowest one matters, no more
        begin = [(load - min(loads)) * share for load in loads]
        return pd.DataFrame({"group": bucket["group"].to_numpy(), "shard": schedule(sizes, begin)})

    schema = f"group {kind}, shard int"
    rest = groups.where(~is_heavy).withColumn("_bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    filled = rest.groupBy("_bucket").applyInPandas(fill, schema)
    first = groups.sparkSession.createDataFrame([(r["group"], s) for r, s in zip(heavy, placed)], schema)
    return filled.unionByName(first)


def with_slots(rows: DataFrame, shard: str = "shard", numbered_rows: int = NUMBERED_ROWS) -> DataFrame:
    """Add ``slot``: 0, 1, ... without gaps in every shard. ``rows`` is a stored table with
    a column ``_row`` of distinct numbers.

    Rows of a shard are dealt to parts of bounded size; each part is numbered by itself,
    and the sizes of the parts before it are added.
    """
    shards, count = rows.agg(F.count_distinct(shard), F.count("*")).first()
    parts = max(1, -(-count // (max(1, shards) * numbered_rows)))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)))
    sizes = dealt.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(shard, "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard, "_part").orderBy("_row")
    numbered = dealt.withColumn("_nth", F.row_number().over(inside) - 1)
    return numbered.join(before, [shard, "_part"]).withColumn(
        "slot", (F.col("_before") + F.col("_nth")).cast("long")
    ).drop("_part", "_nth", "_before")


def shard_rows(rows: DataFrame, size: Column, group: Column, shards: int) -> DataFrame:
    """All columns of ``rows`` plus ``shard`` and ``slot``: near equal sums of ``size``.

    Rows of the same ``group`` share a shard; those of a null group are one group, like any
    other. Repeated rows count each; a null size counts as 0. Columns named ``shard`` or ``slot`` are replaced. An empty table
    gives an empty table. The rows are written once, which fixes their numbers for tasks
    that run again; keep them narrow.
    """
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    named = stored(
        rows.select(
            F.struct(*[rows[c] for c in own]).alias("_in"), group.alias("group"),
            F.coalesce(size, F.lit(0)).alias("bytes"), F.monotonically_increasing_id().alias("_row"),
        )
    )
    groups = stored(named.groupBy("group").agg(F.sum("bytes").alias("bytes")))
    shard_of = shard_groups(groups, shards).withColumnRenamed("group", "_group")
    placed = stored(named.join(shard_of, F.col("group").eqNullSafe(F.col("_group"))).drop("_group"))
    return with_slots(placed).select("_in.*", "shard", "slot")
