"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("small").alias("big"), F.col("big").alias("small")))


def _state(edges: DataFrame) -> tuple:
    """(edges in both directions, their checksum, most edges of a node)."""
    nodes = _both(edges).groupBy("big").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("sum")
    )
    n, checksum, most = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("sum"), F.coalesce(F.max("n"), F.lit(0))).first()
    return n, checksum, most


def _pointed(edges: DataFrame, limit: int | None) -> DataFrame:
    """``edges`` (big, small) with ``least``: the smallest of ``big`` and all its neighbours.

    Given a ``limit``, nodes of more edges are broadcast with what they point to: there can
    only be few.  The edges of all others are joined by a shuffle.
    """
    least = edges.groupBy("big").agg(F.least("big", F.min("small")).alias("least"), F.count("*").alias("n"))
    if limit is None:
        return edges.join(least.drop("n"), "big")
    hubs = F.broadcast(least.where(F.col("n") > limit).drop("n"))
    rest = edges.join(hubs.select("big"), "big", "left_anti").join(least.where(F.col("n") <= limit).drop("n"), "big")
    return edges.join(hubs, "big").unionByName(rest)


def components(edges: DataFrame, *, least_hub: int = 1_000, most_hubs: int = 1_000) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns u, v); component: its smallest node.

    Edges to or from null are ignored, loops and repeated edges do no harm, no edges give
    an empty table.  Every step is a shuffle of edges with partial aggregation.  Where a node has
    more than ``least_hub`` edges and more than a share of 1 / ``most_hubs`` of all, its edges do not
    meet in one task.  Nothing is gathered in one place but counts and a checksum.
    """
    now = stash(
        edges.where("u <> v").select(F.greatest("u", "v").alias("big"), F.least("u", "v").alias("small")).distinct(),
        "edges",
    )
    seen = _state(now)
    while True:
        n, _, most = seen
        bound = max(least_hub, -(-n // most_hubs))
        limit = bound if most > bound else None
        large = (
            _pointed(_both(now), limit)
            .where("small > big")
            .select(F.col("small").alias("big"), F.col("least").alias("small"))
            .distinct()
        )
        if limit is not None:  # read several times below
            large = stash(large, "edges")
        linked = _pointed(large, limit)
        star = linked.select("big", F.col("least").alias("small"))
        moved = linked.where("small <> least").select(F.col("small").alias("big"), F.col("least").alias("small"))
        now = stash(star.unionByName(moved).distinct(), "edges")
        before, seen = seen, _state(now)
        if before == seen:
            break
    stars = now.select(F.col("big").alias("node"), F.col("small").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
