"""The continuous query under interchangeable partitionings; all give the same answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.boxes import box, intersects
from driftgrid.operators import blocks, joins, layouts, trajectories
from driftgrid.params import Params

FRAMES = ("grid", "random", "str", "quad", "theta")


def prepare(points: DataFrame, p: Params, fields: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments and queries of the points; pairing and numbering are done once, and stored. ``fields``: of the segments' columns, only these and what searches need."""
    segs = trajectories.segments(points, p)
    if fields is not None:
        segs = segs.select(*dict.fromkeys((*fields, "seq", "ts2", "x2", "y2", "win", *blocks.SIDES)))
    segs = trajectories.numbered(segs, "seq")
    return segs.drop("nth"), trajectories.range_queries(segs, p)


def pairs(frame: str, points: DataFrame, p: Params, prepared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(qid, segment) pairs under a frame, of what :func:`prepare` made of the points."""
    segs, queries = prepared or prepare(points, p)
    if frame == "grid":
        return joins.range_pairs(queries, segs, p)
    if frame == "theta":
        return joins.theta_pairs(queries, segs, p)
    if frame == "random":  # segments dealt out evenly, queries copied to every part: each part answers alone
        n = F.lit(p.partitions)
        dealt = segs.withColumn("part", F.pmod("seq", n))
        copied = joins.to_windows(queries, p).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.partitions - 1).cast("long"))))
        return copied.join(dealt, ["win", "part"]).where(intersects(box("q"), box(), p.eps)).drop("win", "part")
    if frame == "str":
        return joins.leaf_pairs(queries, segs, str_leaves(points, p), p)
    if frame == "quad":
        return quad_pairs(queries, segs, p)
    raise ValueError(f"frame must be one of {FRAMES}, not {frame!r}")


def str_leaves(points: DataFrame, p: Params) -> list[tuple]:
    """Sort-tile leaves of the first cycle's points."""
    first = points.agg(F.min("ts")).first()[0] or 0
    return layouts.str_layout(points.where(F.col("ts") < F.lit(first) + p.cycle_ms), p)


def quad_pairs(queries: DataFrame, segs: DataFrame, p: Params) -> DataFrame:
    """The join under adaptive layouts: each query is answered under its own cycle's layout.

    A segment is visible in at most two cycles and goes to its leaves in each; both
    sides meet on (window, cycle, leaf). The layouts are a table with a row for each
    cycle, joined by cycle, and sent whole to the tasks only while Spark finds it small.
    """
    found = layouts.cycle_table(segs.sparkSession, layouts.fold_layouts(trajectories.density(segs, p), p), p)
    cycle = lambda c: F.ceil(c / F.lit(p.cycle_ms)).cast("long")
    last = F.col("win") + F.lit((p.logical_windows - 1) * p.window_ms)
    q = queries.select("qid", "win", "qxlo", "qylo", "qxhi", "qyhi").withColumn("cycle", cycle(F.col("win")))
    q = q.join(found, "cycle").withColumn("ql", joins.leaf_set(F.col("leaves"), "q", p.eps)).drop("leaves")
    s = segs.withColumn("cycle", F.explode(F.array_distinct(F.array(cycle(F.col("win")), cycle(last)))))
    s = s.join(found, "cycle").withColumn("sl", joins.leaf_set(F.col("leaves"), "", p.eps)).drop("leaves")
    return joins.pairs_by_leaf(joins.to_windows(q, p), s, p, ["win", "cycle"])


def run(frame: str, points: DataFrame, p: Params) -> DataFrame:
    """One row per query with the segments it finds."""
    prepared = prepare(points, p)
    if frame == "grid":
        return blocks.answers(prepared[1], prepared[0], p)
    return joins.merge(pairs(frame, points, p, prepared), prepared[1], p)
