"""Connected components of an edge table by alternating large and small stars.

Every round hangs each vertex's larger neighbours, then its smaller ones, on its
least neighbour; after a few rounds each component is one star around its least
vertex. All steps are joins and combinable aggregates over (u, v) rows, each round
is written to shared scratch, and only two numbers a round reach the driver.

The middle of a large star would be one join key with all the star's edges. A vertex
with over one edge in ``HOT`` is one of fewer than ``HOT``, so the least neighbours
of those are broadcast and their edges are never dealt out by vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.scratch import drop, materialize

HOT = 1000


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least neighbour of u, from ``least`` (w, m, degree)."""
    hot, other = (least.where(F.coalesce(F.col("degree"), F.lit(0)) > n // HOT), least.where(F.coalesce(F.col("degree"), F.lit(0)) <= n // HOT))
    by_hot = edges.join(F.broadcast(hot), F.col("u") == F.col("w")).select("u", "v", "m")
    rest = edges.join(F.broadcast(hot.select("w")), F.col("u") == F.col("w"), "left_anti")
    return by_hot.unionByName(rest.join(other, F.col("u") == F.col("w")).select("u", "v", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (u long, v long) that is not the least of its component.

    Loops, repeated edges and both directions are allowed; edges with a null end
    are left out; an empty table gives an empty result.
    """
    lower, higher = F.least("u", "v"), F.greatest("u", "v")
    stars = materialize(edges.where("u <> v").select(higher.alias("u"), lower.alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return stars.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = mark
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy(F.col("u").alias("w")).agg(F.least(F.col("w"), F.min("v")).alias("m"), F.count("*").alias("degree")), "least")
        large = _with_least(both.where("v > u"), least, mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("degree")), "low")
        moved = _with_least(large, low, mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(low.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(moved).distinct(), "small")
        drop(stars, least, large, low)
        stars = after
