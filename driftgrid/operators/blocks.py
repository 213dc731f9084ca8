"""Whole answers of the range query, made where the query is: pairs never leave a task.

A query sees far more segments than it has columns, so a shuffle of pairs outweighs the
input many times. Here each query has one block, a cycle and a tile, and segments are
copied to the blocks whose queries may see them: to two cycles at most, and to the tiles
that their box reaches when widened by a square. Rows of a block come sorted by window,
and a task holds the segments of one logical window of one block at a time. What it finds
leaves it as one list a query.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.functions.boxes import window_start
from driftgrid.operators.joins import cell_size
from driftgrid.params import Params

HIT = ("seq", "tid", "ts1", "x1", "y1", "ts2", "x2", "y2")
SIDES = ("xlo", "ylo", "xhi", "yhi")
#: Cells on a tile's side; box tests at once; hits in a batch that leaves a task; tasks for each shuffle partition.
TILE, TESTS, BATCH, TASKS = 5, 1 << 17, 1 << 18, 4

for _module in (__name__, Params.__module__):  # workers need not find this package
    cloudpickle.register_pickle_by_value(sys.modules[_module])


class Side(NamedTuple):
    """A result to compare: the leaves of a layout that are searched, or cells; whether segments lie inside or just meet; of which segments."""

    layout: list[tuple] | None = None
    inside: bool = False
    of: Column | None = None


def deal(queries: DataFrame, segs: DataFrame, p: Params, size: float, fields: tuple[str, ...] = ("seq",), more: dict[str, Column] | None = None) -> DataFrame:
    """Both kinds of rows in the blocks that need them, sorted by block, window and kind: segments (no ``qid``) before queries."""
    slack, tile = 2 * p.eps, F.lit(TILE * size)
    at = lambda a, c: F.floor((c - F.lit(p.region["xy".index(a)] - 2 * p.radius)) / tile)  # noqa: E731  squares at the region's low edges are in its first tiles
    cycle = lambda c: window_start(c, p.cycle_ms)
    middle = lambda a: (F.col(f"q{a}lo") + F.col(f"q{a}hi")) / 2.0
    reach = queries.agg(F.max(F.greatest(F.col("qxhi") - F.col("qxlo"), F.col("qyhi") - F.col("qylo")))).first()[0] or 0.0
    reach = F.lit(reach / 2 + slack)
    tiles = lambda a: F.explode(F.sequence(at(a, F.col(f"{a}lo") - reach), at(a, F.col(f"{a}hi") + reach)))
    kept = [*(F.col(c).alias(f"f_{c}") for c in fields), *(c.alias(f"m_{k}") for k, c in (more or {}).items())]
    s = segs.select("win", *SIDES, *kept)
    last = F.col("win") + F.lit((p.logical_windows - 1) * p.window_ms)
    s = s.withColumn("cycle", F.explode(F.array_distinct(F.array(cycle(F.col("win")), cycle(last)))))
    s = s.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))
    q = queries.select("qid", "win", *[F.col(f"q{c}").alias(c) for c in SIDES], cycle(F.col("win")).alias("cycle"), at("x", middle("x")).alias("tx"), at("y", middle("y")).alias("ty"))
    parts = TASKS * int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ("cycle", "tx", "ty")
    return s.unionByName(q, allowMissingColumns=True).repartition(parts, *block).sortWithinPartitions(*block, "win", F.col("qid").asc_nulls_first())


class Pane(NamedTuple):
    """Segments of a window: four bounds, and the columns that are kept."""

    win: int
    bounds: np.ndarray
    kept: pa.Table


def _bounds(rows: pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in SIDES])


def _distinct(bounds: np.ndarray, kept: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Sorted by what is kept, each row once."""
    names = [c for c in kept.column_names if c.startswith("f_")]
    order = pc.sort_indices(kept, sort_keys=[(c, "ascending") for c in names[:1]], null_placement="at_start").to_numpy()
    first = kept.column(names[0]).take(pa.array(order)).combine_chunks()
    if len(first) > 1 and (first.null_count > 1 or pc.any(pc.equal(first[1:], first[:-1])).as_py()):
        order = pc.sort_indices(kept, sort_keys=[(c, "ascending") for c in names], null_placement="at_start").to_numpy()
        rows = list(zip(*(kept.column(c).take(pa.array(order)).to_pylist() for c in names), strict=True))
        order = order[[k == 0 or rows[k] != rows[k - 1] for k in range(len(rows))]]
    return bounds[:, order], kept.take(pa.array(order)).combine_chunks()


def logical_windows(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[tuple[pa.Table, np.ndarray, pa.Table]]:
    """Queries of a window with the segments that they may see, as bounds and what is kept of them."""
    block, panes, seen = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = [rows.column(c).to_numpy() for c in ("cycle", "tx", "ty", "win")]
        asks = rows.column("qid").is_valid().to_numpy()
        new = np.any([k[1:] != k[:-1] for k in (*keys, asks)], axis=0)
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            *here, win = (int(k[a]) for k in keys)
            piece = rows.slice(a, b - a)
            if here != block:
                block, panes, seen = here, [], None
            if not asks[a]:
                panes = [x for x in panes if x.win > win - p.cycle_ms]
                panes.append(Pane(win, _bounds(piece), piece.select([c for c in piece.column_names if c[:2] in ("f_", "m_")])))
                seen = None
                continue
            if seen is None or seen[0] != win:
                panes = [x for x in panes if x.win > win - p.cycle_ms]
                if not panes:
                    seen = (win, None, None)
                else:
                    seen = (win, *_distinct(np.concatenate([x.bounds for x in panes], axis=1), pa.concat_tables([x.kept for x in panes])))
            yield piece, seen[1], seen[2]


def _meets(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which boxes of ``a`` (rows) meet which of ``b``, as :func:`driftgrid.functions.boxes.intersects` has it."""
    a = a[:, :, None]
    return (a[1] - b[3] <= eps) & (b[1] - a[3] <= eps) & (a[0] - b[2] <= eps) & (b[0] - a[2] <= eps)


def _holds(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    a = a[:, :, None]
    return (a[1] - b[1] <= eps) & (b[3] - a[3] <= eps) & (a[0] - b[0] <= eps) & (b[2] - a[2] <= eps)


class Cells:
    """Segments by the grid cells that their boxes touch."""

    def __init__(self, s: np.ndarray, size: float, eps: float):
        self.size, self.eps, self.first, self.last = size, eps, np.floor(s[:2] / size), np.floor(s[2:] / size)

    def keys(self, q: np.ndarray) -> np.ndarray:
        """A row for each query: the cells that it touches."""
        return np.floor(np.concatenate([q[:2] - 2 * self.eps, q[2:] + 2 * self.eps]) / self.size).T

    def near(self, k: np.ndarray) -> np.ndarray:
        """Which segments touch any of a key's cells."""
        return np.flatnonzero((self.first[0] <= k[2]) & (self.last[0] >= k[0]) & (self.first[1] <= k[3]) & (self.last[1] >= k[1]))


class Leaves:
    """The same by the leaves of a layout."""

    def __init__(self, s: np.ndarray, layout: list[tuple], eps: float):
        self.eps, self.leaves = eps, np.array([b for _, *b in layout], float).T.reshape(4, -1)
        self.touched = np.concatenate([_meets(self.leaves[:, [k]], s, eps) for k in range(self.leaves.shape[1])])

    def keys(self, q: np.ndarray) -> np.ndarray:
        return _meets(q, self.leaves, self.eps)

    def near(self, k: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.touched[k].any(axis=0))


class Index:
    """The segments of a logical window as a side's frame finds them."""

    def __init__(self, s: np.ndarray, side: Side, size: float, eps: float, picked: np.ndarray | None = None):
        self.s, self.eps, self.picked, self.test, self.last = s, eps, picked, _holds if side.inside else _meets, None
        self.parts = Cells(s, size, eps) if side.layout is None else Leaves(s, side.layout, eps)

    def near(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and bounds of the segments in a key's parts; those of the last key are kept."""
        if self.last is None or not np.array_equal(self.last[0], key):
            some = self.parts.near(key)
            if self.picked is not None:
                some = some[self.picked[some]]
            self.last = (key, some, self.s[:, some])
        return self.last[1:]

    def find(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of some queries, how many segments each finds, and which, in order: all queries come once."""
        groups, of = np.unique(self.parts.keys(q), axis=0, return_inverse=True)
        of = of.ravel()
        order, sizes = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(groups))
        ends = np.cumsum(sizes)
        for key, a, b in zip(groups, ends - sizes, ends, strict=True):
            some, bounds = self.near(key)
            step = max(1, TESTS // max(1, len(some)))
            for i in range(a, b, step):
                mine = order[i : min(i + step, b)]
                hit = self.test(q[:, mine], bounds, self.eps)
                yield mine, np.count_nonzero(hit, axis=1), some[np.nonzero(hit)[1]]


def _lists(counts: list[np.ndarray], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)), values)


def _answered(batches: Iterator[pa.RecordBatch], p: Params, size: float, inside: bool, render: Callable, whole: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of queries with what ``render`` makes of their hits' lengths and rows; ``whole``: also segments whose first field is null count."""
    ids, wins, counts, values, held, last = [], [], [], [], 0, None

    def batch() -> pa.RecordBatch:
        columns = {"qid": pa.concat_arrays(ids), "win": pa.concat_arrays(wins)} | render(counts, pa.concat_arrays(values))
        for x in (ids, wins, counts, values):
            x.clear()
        return pa.RecordBatch.from_pydict(columns)

    for asked, bounds, kept in logical_windows(batches, p):
        qid, win = asked.column("qid").combine_chunks(), asked.column("win").combine_chunks()
        if kept is None:
            kept = asked.select([c for c in asked.column_names if c.startswith("f_")]).slice(0, 0)
            bounds = np.zeros((4, 0))
        if bounds is not last:
            fields = {c[2:]: kept.column(c).combine_chunks() for c in kept.column_names}
            picked = None if whole else next(iter(fields.values())).is_valid().to_numpy(zero_copy_only=False)
            index, last = Index(bounds, Side(inside=inside), size, p.eps, picked), bounds
            rows = pa.StructArray.from_arrays(list(fields.values()), names=list(fields)) if whole else next(iter(fields.values())).cast(pa.string())
        for mine, n, which in index.find(_bounds(asked)):
            if not p.emit_empty:
                mine, n = mine[n > 0], n[n > 0]
            take = pa.array(mine)
            ids.append(qid.take(take))
            wins.append(win.take(take))
            counts.append(n)
            values.append(rows.take(pa.array(which)))
            held += len(which) + len(mine)
            if held >= BATCH:
                held = 0
                yield batch()
    if ids:
        yield batch()


def answers(queries: DataFrame, segs: DataFrame, p: Params, fields: tuple[str, ...] = HIT, inside: bool = False) -> DataFrame:
    """(qid, win, segments, n): what :func:`driftgrid.operators.joins.merge` makes of all pairs; ``fields`` are kept of a segment, the first orders the list."""
    size = cell_size(segs, p)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answered(batches, p, size, inside, lambda counts, rows: {"segments": _lists(counts, rows)})

    schema = T.StructType([queries.schema["qid"], queries.schema["win"], T.StructField("segments", T.ArrayType(T.StructType([segs.schema[c] for c in fields])))])
    return deal(queries, segs, p, size, fields).mapInArrow(answer, schema).withColumn("n", F.size("segments").cast("long"))


def texts(queries: DataFrame, segs: DataFrame, p: Params, inside: bool = False) -> DataFrame:
    """(qid, win, n, seqs): the same with the segments' numbers as a text, joined by commas."""
    size = cell_size(segs, p)

    def render(counts: list[np.ndarray], rows: pa.Array) -> dict[str, pa.Array]:
        return {"n": pa.array(np.concatenate(counts).astype(np.int64)), "seqs": pc.binary_join(_lists(counts, rows), ",")}

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answered(batches, p, size, inside, render, whole=False)

    schema = T.StructType([queries.schema["qid"], queries.schema["win"], T.StructField("n", T.LongType()), T.StructField("seqs", T.StringType())])
    return deal(queries, segs, p, size).mapInArrow(answer, schema)


def differences(queries: DataFrame, segs: DataFrame, p: Params, left: Side, right: Side) -> DataFrame:
    """(qid, seq, side): what only one of two results has, as :func:`driftgrid.operators.trajectories.result_diff` finds it from all pairs."""
    size = cell_size(segs, p)
    sides = tuple(x._replace(of=None) for x in (left, right))
    names = ("left", "right")
    more = {k: F.lit(True) if x.of is None else F.coalesce(x.of, F.lit(False)) for k, x in zip(names, (left, right), strict=True)}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, last = [], 0, None
        for asked, bounds, kept in logical_windows(batches, p):
            if kept is None:
                continue
            if bounds is not last:
                picked = [kept.column(f"m_{k}").combine_chunks().to_numpy(zero_copy_only=False) for k in names]
                indexes, last = [Index(bounds, side, size, p.eps, only) for side, only in zip(sides, picked, strict=True)], bounds
            q, seq, qid = _bounds(asked), kept.column("f_seq").combine_chunks(), asked.column("qid").combine_chunks()
            step = max(1, 16 * BATCH // len(seq))
            ordered = np.lexsort(np.floor(q[:2] / size))  # neighbours look at the same segments
            for a in range(0, len(ordered), step):
                some = ordered[a : a + step]
                seen = [np.zeros((len(some), len(seq)), bool) for _ in names]
                for index, marks in zip(indexes, seen, strict=True):
                    for mine, n, which in index.find(q[:, some]):
                        marks[np.repeat(mine, n), which] = True
                differ = seen[0] ^ seen[1]
                for name, marks in zip(names, seen, strict=True):
                    alone = marks & differ
                    whose, n = np.flatnonzero(alone.any(axis=1)), np.count_nonzero(alone, axis=1)
                    if len(whose):
                        out.append((qid.take(pa.array(some[whose])), pa.array([name] * len(whose)), n[whose], seq.take(pa.array(np.nonzero(alone)[1]))))
                        held += int(n.sum())
                if held >= BATCH:
                    yield _differing(out)
                    out, held = [], 0
        if out:
            yield _differing(out)

    schema = T.StructType([queries.schema["qid"], T.StructField("side", T.StringType()), T.StructField("seqs", T.ArrayType(segs.schema["seq"].dataType))])
    lists = deal(queries, segs, p, size, ("seq",), more).mapInArrow(compare, schema)
    return lists.select("qid", F.explode("seqs").alias("seq"), "side")


def _differing(out: list[tuple]) -> pa.RecordBatch:
    qids, names, counts, values = (list(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(qids), pa.concat_arrays(names), _lists(counts, pa.concat_arrays(values))], names=["qid", "side", "seqs"])
