"""The windowed spatial range join and its partitionings.

Queries are the small side: each is copied to the windows it sees and the cells
its square touches, segments to the cells they touch; both meet on (window, cell)
and a pair is kept only in the cell of its overlap's low corner, so there is
nothing to deduplicate. The join is an equality join, which Spark shuffles, splits
when skewed, or turns into a hash join when one side proves small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.boxes import Box, box, contains, contains_point, intersects
from driftgrid.params import Params


def _cells(lo: str, hi: str, size: float, slack: float):
    at = lambda c: F.floor(c / F.lit(size)).cast("int")
    return F.sequence(at(F.col(lo) - slack), at(F.col(hi) + slack))


def to_cells(rows: DataFrame, prefix: str, size: float, slack: float = 0.0) -> DataFrame:
    """One row per grid cell that a box touches."""
    out = rows.withColumn("gx", F.explode(_cells(f"{prefix}xlo", f"{prefix}xhi", size, slack)))
    return out.withColumn("gy", F.explode(_cells(f"{prefix}ylo", f"{prefix}yhi", size, slack)))


def to_windows(queries: DataFrame, p: Params) -> DataFrame:
    """One row per tumbling window that a query sees, its own included, as ``win``."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(p.logical_windows - 1)), lambda i: F.col("win") - i * F.lit(p.window_ms))
    return queries.withColumn("win", F.explode(steps))


def cell_size(boxes: DataFrame, p: Params, prefix: str = "") -> float:
    """The side of a grid cell for these boxes: ``p.cell`` if it is set, else a square's side plus the mean length of a box on its longer axis.

    A box of either kind then touches about four cells or fewer, however large the region is.
    """
    if p.cell is not None:
        return p.cell
    side = lambda a: F.avg(F.col(f"{prefix}{a}hi") - F.col(f"{prefix}{a}lo"))
    return 2 * p.radius + (boxes.agg(F.greatest(side("x"), side("y")).alias("m")).first().m or 0.0)


def range_pairs(queries: DataFrame, segs: DataFrame, p: Params, inside: bool = False) -> DataFrame:
    """All segment columns with ``qid``: segments that meet (or lie inside) each query's square in its windows."""
    slack, size = 2 * p.eps, cell_size(segs, p)
    q = to_cells(to_windows(queries.select("qid", "win", "qxlo", "qylo", "qxhi", "qyhi"), p), "q", size, slack)
    s = to_cells(segs, "", size)
    test = contains(box("q"), box(), p.eps) if inside else intersects(box("q"), box(), p.eps)
    corner = lambda a, b: F.floor(F.greatest(F.col(a) - F.lit(slack), F.col(b)) / F.lit(size)).cast("int")
    # A segment that ends short of the widened square by rounding alone still shares the square's first cell.
    first = (F.col("gx") == F.least(corner("qxlo", "xlo"), F.floor(F.col("xhi") / size).cast("int"))) & (F.col("gy") == F.least(corner("qylo", "ylo"), F.floor(F.col("yhi") / size).cast("int")))
    return q.join(s, ["win", "gx", "gy"]).where(test & first).drop("win", "gx", "gy")


def theta_pairs(queries: DataFrame, segs: DataFrame, p: Params) -> DataFrame:
    """The same pairs by an equality join on windows alone: for tests and small inputs."""
    return to_windows(queries, p).join(segs, "win").where(intersects(box("q"), box(), p.eps)).drop("win")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, eps: float = 1e-5) -> DataFrame:
    """Points (x, y) in boxes (qid, qxlo..qyhi)."""
    at = lambda c: F.floor(F.col(c) / F.lit(size)).cast("int")
    p = points.withColumns({"gx": at("x"), "gy": at("y")})
    return to_cells(boxes, "q", size, 2 * eps).join(p, ["gx", "gy"]).where(contains_point(box("q"), F.col("x"), F.col("y"), eps)).drop("gx", "gy")


def leaf_set(layout, prefix: str = "", eps: float = 1e-5):
    """The sorted leaves (Column) that a row's box meets: of a list (leaf, lxlo, lylo, lxhi, lyhi) or of an array column of such structs."""
    if isinstance(layout, list):
        names = ("lxlo", "lylo", "lxhi", "lyhi")
        layout = F.array(*[F.struct(F.lit(int(i)).alias("leaf"), *[F.lit(float(v)).alias(k) for k, v in zip(names, bounds, strict=True)]) for i, *bounds in layout])
    mine = box(prefix)
    met = F.filter(layout, lambda l: intersects(mine, Box(l["lxlo"], l["lylo"], l["lxhi"], l["lyhi"]), eps))
    return F.array_sort(F.transform(met, lambda l: l["leaf"]))


def assign(rows: DataFrame, layout, prefix: str = "", eps: float = 1e-5) -> DataFrame:
    """Each row once per leaf that its box meets; a layout (list of leaves and bounds) has at most a few hundred leaves."""
    return rows.withColumn("leaf", F.explode(leaf_set(layout, prefix, eps)))


def pairs_by_leaf(queries: DataFrame, segs: DataFrame, p: Params, keys: list[str]) -> DataFrame:
    """The range join of queries with their leaves ``ql`` and segments with their leaves ``sl``.

    Both sides go to their leaves and meet on ``keys`` and the leaf. Leaves share edges, so a
    pair may meet in several; it is kept in the least leaf that both touch.
    """
    left = queries.withColumn("leaf", F.explode("ql"))
    right = segs.withColumn("leaf", F.explode("sl"))
    least = F.array_min(F.array_intersect("ql", "sl"))
    return left.join(right, [*keys, "leaf"]).where(intersects(box("q"), box(), p.eps) & (F.col("leaf") == least)).drop(*keys, "leaf", "ql", "sl")


def leaf_pairs(queries: DataFrame, segs: DataFrame, layout: list[tuple], p: Params) -> DataFrame:
    """The range join over a layout's leaves."""
    q = queries.select("qid", "win", "qxlo", "qylo", "qxhi", "qyhi").withColumn("ql", leaf_set(layout, "q", p.eps))
    return pairs_by_leaf(to_windows(q, p), segs.withColumn("sl", leaf_set(layout, "", p.eps)), p, ["win"])


def holders(rows: DataFrame, assigned: DataFrame, key: str = "seq") -> DataFrame:
    """Element lookup: which leaves of ``assigned`` (key, leaf) hold each of ``rows``; one that none holds is not there."""
    return rows.select(key).join(assigned.select(key, "leaf"), key)


def merge(pairs: DataFrame, queries: DataFrame, p: Params) -> DataFrame:
    """One row per query: its distinct segments, and their number. Queries without hits have an empty list, or none.

    Queries that are stamped (:func:`stamp`) keep the first ``input_time``.
    """
    hit = F.struct("seq", "tid", "ts1", "x1", "y1", "ts2", "x2", "y2")
    out = pairs.groupBy("qid").agg(F.sort_array(F.collect_set(hit)).alias("segments"))
    how = "left" if p.emit_empty else "inner"
    stamped = [c for c in ("input_time",) if c in queries.columns]
    out = queries.select("qid", "win", *stamped).join(out, "qid", how)
    empty = F.coalesce("segments", F.array().cast(out.schema["segments"].dataType))
    return out.select("qid", "win", *stamped, empty.alias("segments")).withColumn("n", F.size("segments").cast("long"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Partial results (qid, input_time, segments) as one a query: the first input time and the union of the lists."""
    return parts.groupBy("qid").agg(F.min("input_time").alias("input_time"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("segments")))).alias("segments"))


def stamp(rows: DataFrame, name: str = "input_time") -> DataFrame:
    """Adds the wall clock in ms, as of the query that reads it."""
    return rows.withColumn(name, F.unix_millis(F.current_timestamp()))


def latency(results: DataFrame) -> DataFrame:
    """Results that have ``input_time``, with ``output_time`` and the ``latency_ms`` between them."""
    return stamp(results, "output_time").withColumn("latency_ms", F.col("output_time") - F.col("input_time"))
