"""From points to segments, queries and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.boxes import near, window_start
from driftgrid.params import Params
from driftgrid.scratch import materialize


def pair_points(points: DataFrame) -> DataFrame:
    """Each point with the one before it of its trajectory, in order of arrival."""
    before = Window.partitionBy("tid").orderBy("seq")
    return points.select("*", *[F.lag(c).over(before).alias(f"{c}0") for c in ("ts", "x", "y")])


def cut_by_sweeps(paired: DataFrame, gap: int) -> DataFrame:
    """``paired`` points with ``swept``: whether their trajectory had been dropped as idle before they came.

    Idle trajectories are dropped in sweeps, and only the arrival of a trajectory that
    is not known, over ``gap`` after the last sweep, makes one. Whether a trajectory is
    known depends on the sweeps before, so this is a fold in order of arrival, with one
    number for its state, over the points that can matter: a trajectory's first and
    those after a gap. These few go through one task, row by row.
    """
    some = paired.where(F.col("ts0").isNull() | (F.col("ts") - F.col("ts0") > gap)).select("seq", "ts", "ts0")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            swept = []
            for ts, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = before is not None and last - before > gap
                if (gone or before is None) and ts - last > gap:
                    last = ts
                swept.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(swept, pa.bool_())], names=["seq", "swept"])

    told = some.repartition(1).sortWithinPartitions("seq").mapInArrow(fold, "seq long, swept boolean").where("swept")
    return paired.join(told, "seq", "left").withColumn("swept", F.coalesce("swept", F.lit(False)))


def segments(points: DataFrame, p: Params) -> DataFrame:
    """(seq, tid, ts1, x1, y1, ts2, x2, y2, bounds, win): moves that are neither stationary nor jumps.

    Ends are ordered by time, a tie keeps the order of arrival. A pair that is left
    out still moves the trajectory's last point on.
    """
    ok = F.col("ts0").isNotNull() & ~(near(F.col("x"), F.col("x0"), p.eps) & near(F.col("y"), F.col("y0"), p.eps))
    ok = ok & (F.abs(F.col("x") - F.col("x0")) <= p.max_segment) & (F.abs(F.col("y") - F.col("y0")) <= p.max_segment)
    paired = pair_points(points)
    if p.inactivity_ms is not None and p.eviction == "exact":
        paired = cut_by_sweeps(paired, p.inactivity_ms)
        ok = ok & ~F.col("swept")
    elif p.inactivity_ms is not None:
        ok = ok & (F.col("ts") - F.col("ts0") <= p.inactivity_ms)
    late = F.col("ts") >= F.col("ts0")
    ends = [e for c in ("ts", "x", "y") for e in (F.when(late, F.col(f"{c}0")).otherwise(F.col(c)).alias(f"{c}1"), F.when(late, F.col(c)).otherwise(F.col(f"{c}0")).alias(f"{c}2"))]
    sides = [F.least("x", "x0").alias("xlo"), F.least("y", "y0").alias("ylo"), F.greatest("x", "x0").alias("xhi"), F.greatest("y", "y0").alias("yhi")]
    out = paired.where(ok).select("seq", "tid", *ends, *sides)
    return out.withColumn("win", window_start(F.col("ts2"), p.window_ms))


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows``, stored, with ``nth``: their number from 0 on in the order of the columns.

    Rows are dealt out by ranges of the order and numbered within; what goes before is a
    sum over the ranges, so no task sees all rows, nor a number that grows with them.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = materialize(dealt.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part, inner = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))  # as Spark makes these ids
    sizes = stored.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = F.broadcast(sizes.select("__p", before.alias("__base")))
    return stored.join(starts, part == F.col("__p")).withColumn("nth", F.col("__base") + inner).drop("__m", "__p", "__base")


def sample(rows: DataFrame, n: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Every n-th row in order of ``seq``, from the first on, as ``qid``; rows that are numbered already keep their ``nth`` as the order."""
    known = rows if "nth" in rows.columns else numbered(rows, "seq")
    return known.where(F.col("nth") % n == 0).withColumn("qid", (F.expr(f"nth div {n}") * parts + part).cast("long")).drop("nth")


def range_queries(segs: DataFrame, p: Params) -> DataFrame:
    """(qid, ts, win, qxlo..qyhi): a square around the later end of every ``ratio``-th segment."""
    r = p.radius
    sides = [(F.col("x2") - r).alias("qxlo"), (F.col("y2") - r).alias("qylo"), (F.col("x2") + r).alias("qxhi"), (F.col("y2") + r).alias("qyhi")]
    return sample(segs, p.ratio).select("qid", F.col("ts2").alias("ts"), "win", *sides)


def window_counts(segs: DataFrame, queries: DataFrame, width: int = 600_000) -> DataFrame:
    """Segments and queries per tumbling window."""
    both = segs.select(F.col("ts2").alias("ts"), F.lit(1).alias("s"), F.lit(0).alias("q")).unionByName(queries.select("ts", F.lit(0).alias("s"), F.lit(1).alias("q")))
    return both.groupBy(window_start(F.col("ts"), width).alias("win")).agg(F.sum("s").alias("n_segments"), F.sum("q").alias("n_queries"))


def retained(segs: DataFrame, p: Params) -> DataFrame:
    """(win, n, retained): segments of each pane and of the logical window that it closes."""
    band = Window.orderBy("win").rangeBetween(-(p.logical_windows - 1) * p.window_ms, 0)
    panes = segs.groupBy("win").agg(F.count("*").alias("n"))
    return panes.withColumn("retained", F.sum("n").over(band))


def density(segs: DataFrame, p: Params) -> DataFrame:
    """(cycle, gx, gy, cnt): segment centers per grid cell and cycle; a boundary window closes its cycle."""
    from driftgrid.functions.boxes import box, center, density_cell

    cx, cy = center(box())
    x0, y0, x1, y1 = p.region
    cycle = F.ceil(F.col("win") / F.lit(p.cycle_ms)).cast("long")
    return segs.groupBy(cycle.alias("cycle"), density_cell(cx, x0, x1, p.grid).alias("gx"), density_cell(cy, y0, y1, p.grid).alias("gy")).agg(F.count("*").alias("cnt"))


def prefix_threshold(marginal: DataFrame, bound: int, axis: str = "gx") -> DataFrame:
    """The least place on an axis where the running sum reaches ``bound``; a marginal has at most the grid's rows."""
    running = F.sum("cnt").over(Window.orderBy(axis).rowsBetween(Window.unboundedPreceding, 0))
    return marginal.withColumn("__s", running).where(F.col("__s") >= bound).agg(F.min(axis).alias("place"))


def result_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (qid, seq) that only one of two results has, with its side."""
    pairs = lambda d: d.select("qid", "seq")
    return pairs(a).exceptAll(pairs(b)).withColumn("side", F.lit("left")).unionByName(pairs(b).exceptAll(pairs(a)).withColumn("side", F.lit("right")))
