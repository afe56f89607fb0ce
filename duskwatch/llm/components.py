"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and its neighbours v.

    The least is aggregated before the join, so that a node with a great many
    neighbours is one row per task in the aggregate; the join may split it.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    told = _with_least(down)
    return told.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        told.select("u", F.col("m").alias("v"))
    )


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two columns of ids).

    ``component`` is the smallest id reachable. Links to oneself, repeated links and
    links in both directions are allowed; nodes without a link to another are not
    returned; rows with a null are ignored. Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    named = links.toDF("u", "v").where("u is not null and v is not null")
    edges = stored(_clean(named))
    seen = None
    while True:
        edges = stored(_clean(_small_star(_clean(_large_star(edges)))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
