"""The continuous query over a stream of points.

:func:`answer` runs it by ``foreachBatch`` over a store of panes on shared storage. A
batch pairs its points with the last point of each trajectory, numbers the new segments
on from a running count, and adds segments and queries to the panes of their windows.
The windows that the newest point has closed are then answered by the batch join over the
last panes, and panes, snapshots and marks that no later batch can need are deleted. A
batch reads the state of the batch before and the panes of one logical window, however
long the stream has run. What a batch writes is named by its epoch and its mark is written
last, so a repeated batch or a restart writes the same again.

Late rows: a segment or query of a window that is answered already is left out and
counted in the mark; its point is still its trajectory's last one. ``lateness_ms`` holds
windows open for longer.

:func:`pair_stream` is the declarative alternative for pairing alone, one keyed state per
trajectory; :func:`window_counts_stream` and :func:`window_totals_stream` count points in
tumbling windows and in windows of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftgrid.operators import joins, trajectories
from driftgrid.params import Params
from driftgrid.scratch import delete, drop, materialize


def with_event_time(points: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Adds ``at``, the event time, with a watermark."""
    return points.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)


def pair_stream(points: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Each streamed point with its trajectory's last one; one state (ts, x, y) per trajectory.

    With ``idle_ms`` a trajectory whose last point lies further behind the watermark
    is forgotten, and its next point begins it anew.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        last = state.get if state.exists else (None, None, None)
        before = pd.DataFrame([last, *rows[["ts", "x", "y"]].itertuples(index=False, name=None)][:-1], columns=["ts0", "x0", "y0"])
        state.update(tuple(rows[["ts", "x", "y"]].iloc[-1].tolist()))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1]) + idle_ms, state.getCurrentWatermarkMs() + 1))
        out = pd.concat([rows[["seq", "tid", "ts", "x", "y"]].reset_index(drop=True), before], axis=1)
        yield out[out["ts0"].notna()].astype({"ts0": "int64"})

    timed = points if idle_ms is None else with_event_time(points)
    return timed.groupBy("tid").applyInPandasWithState(
        step, "seq long, tid long, ts long, x double, y double, ts0 long, x0 double, y0 double", "ts double, x double, y double", "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout,
    )


def window_counts_stream(points: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Points per tumbling window, appended as the watermark closes it."""
    return with_event_time(points).groupBy(F.window("at", width)).agg(F.count("*").alias("n_points"))


def window_totals_stream(points: DataFrame, width: str = "10 minutes", wider: str = "1 hour") -> DataFrame:
    """The same windows' counts in windows of their own: how many had points, and the most in one."""
    return window_counts_stream(points, width).groupBy(F.window(F.window_time("window"), wider)).agg(F.count("*").alias("n_windows"), F.max("n_points").alias("most"))


MARK = "epoch long, segments long, newest long, edge long, late long"
LAST = "tid long, seq long, ts long, x double, y double"


class Panes:
    """The store: panes and open queries by (epoch, win), each batch's last points and its mark by epoch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folders(self, pattern: str) -> list[str]:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
        return [str(f.getPath()) for f in found or []]

    def mark(self, epoch: int):
        """The mark before ``epoch``, or None."""
        if not self._folders("mark/epoch=*"):
            return None
        marks = self.spark.read.schema(MARK).parquet(f"{self.path}/mark")
        return marks.where(F.col("epoch") < epoch).orderBy(F.col("epoch").desc()).first()

    def write(self, kind: str, rows: DataFrame, epoch: int, by: str | None = None) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{kind}/epoch={epoch}")

    def read(self, kind: str, schema, low: int | None, high: int) -> DataFrame:
        """Rows of the windows from ``low`` up to before ``high``; other panes' folders are not read."""
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
        return rows.where((F.col("win") < high) & (F.col("win") >= low if low is not None else F.lit(True)))

    def retire(self, kind: str, before: int) -> None:
        for folder in self._folders(f"{kind}/epoch=*/win=*"):
            if int(folder.rsplit("=", 1)[1]) < before:
                delete(self.spark, folder)

    def forget(self, kind: str, before: int) -> None:
        for folder in self._folders(f"{kind}/epoch=*"):
            if int(folder.rsplit("=", 1)[1]) < before:
                delete(self.spark, folder)


def take_batch(rows: DataFrame, epoch: int, panes: Panes, out: str, p: Params, lateness_ms: int = 0) -> None:
    """One micro-batch of points (seq, tid, ts, x, y): see the module's text."""
    spark, mark = rows.sparkSession, panes.mark(epoch)
    rows = materialize(rows.select(F.col("tid").cast("long").alias("tid"), "seq", "ts", "x", "y"), "batch")
    newest = rows.agg(F.max("ts")).first()[0]
    if newest is None:
        return
    done, base = (mark.edge, mark.segments) if mark else (None, 0)
    newest = max(newest, mark.newest) if mark else newest
    edge = max(done or 0, (newest - lateness_ms) // p.window_ms * p.window_ms)  # windows that start before it are over
    points = rows.unionByName(spark.read.schema(LAST).parquet(f"{panes.path}/last/epoch={mark.epoch}")) if mark else rows
    every = trajectories.numbered(trajectories.segments(points, p), "seq").withColumn("nth", F.col("nth") + base)
    fresh = every if done is None else every.where(F.col("win") >= done)
    segs, queries = fresh.drop("nth"), trajectories.range_queries(fresh, p)
    counts = every.agg(F.count("*").alias("n"), F.count_if(F.col("win") < (done if done is not None else 0)).alias("late")).first()
    panes.write("panes", segs, epoch, "win")
    panes.write("queries", queries, epoch, "win")
    last = points.groupBy("tid").agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in ("ts", "x", "y")])
    if p.inactivity_ms is not None:  # the next point would be cut off from an older one anyway
        last = last.where(F.col("ts") >= newest - p.inactivity_ms)
    panes.write("last", last, epoch)
    reach = (p.logical_windows - 1) * p.window_ms
    asked = panes.read("queries", queries.schema, done, edge)
    seen = panes.read("panes", segs.schema, None if done is None else done - reach, edge)
    joins.merge(joins.range_pairs(asked, seen, p), asked, p).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    panes.write("mark", spark.createDataFrame([(base + counts.n, newest, edge, counts.late)], MARK.removeprefix("epoch long, ")), epoch)
    if done is not None:  # what a repetition of this batch reads stays
        panes.retire("panes", done - reach)
        panes.retire("queries", done)
        panes.forget("last", mark.epoch)
        panes.forget("mark", mark.epoch)
    drop(rows)


def answer(points: DataFrame, store: str, out: str, p: Params, checkpoint: str, trigger: dict | None = None, lateness_ms: int = 0):
    """Start the continuous query: results per closed window are appended to ``out``."""
    panes = Panes(points.sparkSession, store)
    writer = points.writeStream.foreachBatch(lambda rows, epoch: take_batch(rows, epoch, panes, out, p, lateness_ms)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
