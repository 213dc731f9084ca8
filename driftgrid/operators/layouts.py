"""Partition layouts: sort-tile rank cuts, adaptive quad cuts, leaf ids, migration.

A layout has at most ``partitions`` leaves, so it is worked out on the driver over a
density grid of fixed size, one cycle at a time; the data only ever meets the result, as
an expression or a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions.boxes import box, intersects
from driftgrid.operators.trajectories import numbered
from driftgrid.params import Params

LAYOUT = "leaf int, lxlo double, lylo double, lxhi double, lyhi double"


@dataclass(frozen=True)
class Leaf:
    """Inclusive cell ranges, items, and the path of quadrants from the root."""

    x0: int
    y0: int
    x1: int
    y1: int
    count: int
    path: tuple[int, ...]
    id: int = -1


def quadrants(p: Params) -> list[Leaf]:
    """The first layout: four equal quadrants with ids 0 to 3."""
    h, g = p.grid // 2, p.grid - 1
    spots = ((0, 0, h - 1, h - 1), (0, h, h - 1, g), (h, 0, g, h - 1), (h, h, g, g))
    return [Leaf(*s, count=0, path=(i,), id=i) for i, s in enumerate(spots)]


def least_prefix(line: np.ndarray, bound: float) -> int:
    """The first place at which the running sum reaches ``bound``; the last but one if it never does, so that something is left beside it."""
    return min(int(np.searchsorted(np.cumsum(line), bound)), len(line) - 2)


def split(leaf: Leaf, grid: np.ndarray, targets: tuple[float, float, float]) -> list[Leaf]:
    """Four leaves: x is cut where the first two targets are reached, then y on each side on its own; a side one cell wide is not cut.

    Leaf 0 has low x and low y, 1 low x and high y, 2 high x and low y, 3 high x and high y.
    """
    part = grid[leaf.x0 : leaf.x1 + 1, leaf.y0 : leaf.y1 + 1]
    xs = [(leaf.x0, leaf.x1)]
    if leaf.x1 > leaf.x0:
        c = leaf.x0 + least_prefix(part.sum(axis=1), targets[0] + targets[1])
        xs = [(leaf.x0, c), (c + 1, leaf.x1)]
    out = []
    for i, (x0, x1) in enumerate(xs):
        ys = [(leaf.y0, leaf.y1)]
        if leaf.y1 > leaf.y0:
            c = leaf.y0 + least_prefix(grid[x0 : x1 + 1, leaf.y0 : leaf.y1 + 1].sum(axis=0), targets[2 * i])
            ys = [(leaf.y0, c), (c + 1, leaf.y1)]
        out += [Leaf(x0, y0, x1, y1, int(grid[x0 : x1 + 1, y0 : y1 + 1].sum()), (*leaf.path, 2 * i + j)) for j, (y0, y1) in enumerate(ys)]
    return out


#: How a region is split by its items. Units: a quarter of the items, the bound, the fill (1.5 bounds),
#: what is left beside two targets or beside a fill. Each row: up to how many units (included or not), the three targets
#: as shares of units, and which of the four leaves are split on.
QUARTER, BOUND, FILL, HALF_REST, THIRD_REST = "quarter", "bound", "fill", "half of the rest", "third of the rest"
SCHEDULE = (
    (3, FILL, True, ((0.85, QUARTER), (0.9, QUARTER), (0.9, QUARTER)), ()),
    (4, FILL, True, ((0.8, QUARTER), (0.85, QUARTER), (0.9, QUARTER)), ()),
    (5, FILL, False, ((0.95, QUARTER), (0.9, QUARTER), (0.98, QUARTER)), ()),
    (7, FILL, False, ((0.95, BOUND), (1.0, BOUND), (0.85, BOUND)), (3,)),
    (8, FILL, False, ((0.85, FILL), (0.75, FILL), (0.9, FILL)), (3,)),
    (8.5, FILL, False, ((1.2, FILL), (1.0, FILL), (1.1, FILL)), (3,)),
    (11, FILL, False, ((1.2, BOUND), (1.2, BOUND), (1.0, HALF_REST)), (2, 3)),
    (15, FILL, False, ((0.9, FILL), (0.9, THIRD_REST), (0.9, THIRD_REST)), (1, 2, 3)),
    (float("inf"), FILL, False, ((1.0, QUARTER), (0.9, QUARTER), (1.0, QUARTER)), (0, 1, 2, 3)),
)
#: In bounds, below which a region is one leaf, from which a leaf is split by itself, and the share of an even load that is the bound.
WHOLE, SPLIT, LOAD = 2.2, 4.5, 0.8


def grow(leaf: Leaf, grid: np.ndarray, bound: int) -> list[Leaf]:
    """The leaves that a region becomes under the schedule; the root always becomes four at least."""
    n, fill = leaf.count, int(bound * 1.5)
    if n < max(WHOLE * bound, 1) and leaf.path or (leaf.x0, leaf.y0) == (leaf.x1, leaf.y1):
        return [leaf]
    units = {QUARTER: n / 4, BOUND: bound, FILL: fill, HALF_REST: (n - 2 * int(1.2 * bound)) / 2, THIRD_REST: (n - fill) / 3}
    if n < WHOLE * bound:
        targets, again = SCHEDULE[-1][3], ()
    else:
        targets, again = next((t, k) for most, unit, included, t, k in SCHEDULE if n < most * units[unit] or included and n == most * units[unit])
    out = []
    for x in split(leaf, grid, tuple(int(share * units[unit]) for share, unit in targets)):
        out += grow(x, grid, bound) if x.path[-1] in again else [x]
    return out


def picks(leaves: list[Leaf], bound: int) -> list[tuple[int, ...]]:
    """Paths of the regions to be made anew: of each leaf with too many or too few items the least region around it that can hold leaves of the right size."""
    counts: dict[tuple[int, ...], int] = {}
    for x in leaves:
        for k in range(len(x.path) + 1):
            counts[x.path[:k]] = counts.get(x.path[:k], 0) + x.count
    only_root = all(len(x.path) == 1 for x in leaves)
    found = set()
    for x in leaves:
        if x.count > 2 * bound or x.count < bound and not only_root:
            at = x.path
            if x.count < SPLIT * bound:
                at = at[:-1]
                while at and not (bound <= counts[at] <= 2 * bound or counts[at] >= SPLIT * bound):
                    at = at[:-1]
            found.add(at)
    return sorted(p for p in found if not any(p[:k] in found for k in range(len(p))))


def adapt(old: list[Leaf], grid: np.ndarray, p: Params) -> list[Leaf]:
    """The next layout for a density grid, a pure function of the old one.

    The bound is ``LOAD`` of an even load. Regions with leaves beyond it are made
    anew by the schedule; while that gives more leaves than partitions the bound is
    raised by factors of 1.1, 1.2 and so on. An empty or tiny cycle (bound zero) keeps the
    layout. Leaves that stay keep their ids; new ones get the ids that save most items
    from moving.
    """
    leaves = [replace(x, count=int(grid[x.x0 : x.x1 + 1, x.y0 : x.y1 + 1].sum())) for x in old]
    items = int(grid.sum())
    bound, factor = int(items // p.partitions * LOAD), 1.0
    while 0 < bound <= items:
        new, made = leaves, picks(leaves, bound)
        for at in made:
            group = [x for x in leaves if x.path[: len(at)] == at]
            region = Leaf(min(x.x0 for x in group), min(x.y0 for x in group), max(x.x1 for x in group), max(x.y1 for x in group), sum(x.count for x in group), at)
            new = [x for x in new if x.path[: len(at)] != at] + grow(region, grid, bound)
        if len(new) <= p.partitions:
            return relabel(old, sorted(new, key=lambda x: x.path), grid, p.partitions) if made else leaves
        factor += 0.1
        bound = max(bound + 1, int(factor * bound))
    return leaves


def fullest(leaves: list[Leaf]) -> Leaf:
    """The first leaf with most items."""
    return max(leaves, key=lambda x: x.count)


def by_count(leaves: list[Leaf]) -> list[Leaf]:
    """Leaves from the fewest items to the most; equal ones keep their order."""
    return sorted(leaves, key=lambda x: x.count)


def overlap(new: list[Leaf], old: list[Leaf], grid: np.ndarray) -> np.ndarray:
    """Items common to each new and each old leaf."""
    cell = lambda a, b: grid[max(a.x0, b.x0) : min(a.x1, b.x1) + 1, max(a.y0, b.y0) : min(a.y1, b.y1) + 1]
    meet = lambda a, b: a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1
    return np.array([[int(cell(a, b).sum()) if meet(a, b) else 0 for b in old] for a in new], dtype=np.int64).reshape(len(new), len(old))


def min_cost_assignment(cost: np.ndarray) -> list[int]:
    """For each row a column, each column once, at least total cost; rows left over get -1.

    Shortest augmenting paths with potentials over the square padded with zeros.
    """
    n, m = cost.shape
    size = max(n, m)
    if not size:
        return []
    c = np.zeros((size, size))
    c[:n, :m] = cost
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    owner, way = np.zeros(size + 1, int), np.zeros(size + 1, int)
    for row in range(1, size + 1):
        owner[0], j = row, 0
        dist, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while owner[j]:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            step = c[owner[j] - 1, free - 1] - u[owner[j]] - v[free]
            better = step < dist[free]
            dist[free[better]], way[free[better]] = step[better], j
            nxt = free[np.argmin(dist[free])]
            delta = dist[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            dist[~used] -= delta
            j = nxt
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    out = [-1] * n
    for j in range(1, size + 1):
        if owner[j] - 1 < n and j - 1 < m:
            out[owner[j] - 1] = j - 1
    return out


def relabel(old: list[Leaf], new: list[Leaf], grid: np.ndarray, partitions: int) -> list[Leaf]:
    """Ids 0 to partitions - 1, each once: those of the old leaves that share most items, then free ones."""
    shared = overlap(new, old, grid)
    chosen = min_cost_assignment(shared.max(initial=0) - shared)
    free = [i for i in range(partitions) if i not in {x.id for x in old}]
    spare = sorted({x.id for k, x in enumerate(old) if k not in chosen} | set(free))
    return [replace(x, id=old[c].id if c >= 0 else spare.pop(0)) for x, c in zip(new, chosen, strict=True)]


def to_boxes(leaves: Iterable[Leaf], p: Params) -> list[tuple]:
    """(leaf, bounds) in region units; the outermost leaves reach beyond the region."""
    x0, y0, x1, y1 = p.region
    sx, sy, far, g = (x1 - x0) / p.grid, (y1 - y0) / p.grid, 1.5 * (x1 - x0), p.grid - 1
    lo = lambda c, o, s: o - far if c == 0 else o + c * s
    hi = lambda c, o, s: o + (c + 1) * s + (far if c == g else 0)
    return [(x.id, lo(x.x0, x0, sx), lo(x.y0, y0, sy), hi(x.x1, x0, sx), hi(x.y1, y0, sy)) for x in leaves]


def layout_table(spark: SparkSession, boxes: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(int(i), *map(float, b)) for i, *b in boxes], LAYOUT)


def by_cycle(density: DataFrame, p: Params) -> Iterator[tuple[int, np.ndarray]]:
    """(cycle, density grid) in order; the driver holds one cycle's cells at a time, at most grid x grid."""
    last, grid = None, None
    for r in density.repartitionByRange("cycle").sortWithinPartitions("cycle").toLocalIterator():
        if r.cycle != last:
            if last is not None:
                yield last, grid
            last, grid = r.cycle, np.zeros((p.grid, p.grid), np.int64)
        grid[r.gx, r.gy] = r.cnt
    if last is not None:
        yield last, grid


def fold_layouts(density: DataFrame, p: Params) -> dict[int, list[Leaf]]:
    """The layout in force in each cycle that has items or follows one that has: made from the density of the cycle before.

    A cycle without items keeps the layout, so cycles between are not listed.
    """
    layout, out = quadrants(p), {}
    for cycle, grid in by_cycle(density, p):
        out.setdefault(cycle, layout)
        layout = adapt(layout, grid, p)
        out[cycle + 1] = layout
    return out


def cycle_table(spark: SparkSession, layouts: dict[int, list[Leaf]], p: Params) -> DataFrame:
    """(cycle, leaves): one row a cycle with its leaves' bounds, to be joined by cycle."""
    rows = [(int(c), [(int(i), *map(float, b)) for i, *b in to_boxes(leaves, p)]) for c, leaves in layouts.items()]
    return spark.createDataFrame(rows, f"cycle long, leaves array<struct<{LAYOUT.replace(' ', ': ').replace(',:', ',')}>>")


def leaf_of_cell(cells: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """Each cell (gx, gy) with the ``leaf`` that holds it; leaves tile the grid, so there is one."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in (("leaf", x.id), ("x0", x.x0), ("y0", x.y0), ("x1", x.x1), ("y1", x.y1))]) for x in leaves])
    inside = lambda b: (F.col("gx") >= b["x0"]) & (F.col("gx") <= b["x1"]) & (F.col("gy") >= b["y0"]) & (F.col("gy") <= b["y1"])
    return cells.withColumn("leaf", F.get(F.filter(rows, inside), 0)["leaf"])


def overlap_table(density: DataFrame, new: list[Leaf], old: list[Leaf]) -> DataFrame:
    """(new_leaf, old_leaf, cnt): items common to each new and old leaf, from (gx, gy, cnt)."""
    both = leaf_of_cell(leaf_of_cell(density, new).withColumnRenamed("leaf", "new_leaf"), old).withColumnRenamed("leaf", "old_leaf")
    return both.groupBy("new_leaf", "old_leaf").agg(F.sum("cnt").alias("cnt"))


def str_cuts(points: DataFrame, partitions: int) -> list[tuple[float, list[float]]]:
    """Rows from the top: (y of the cut below, x of the cuts between columns), at exact ranks.

    Row i ends before rank floor(n i / rows) of the points by falling y, ties by
    arrival; its columns are cut alike by rising x. Only the points at cuts reach the
    driver, fewer than partitions.
    """
    rows = int(partitions**0.5)
    n = points.count()
    ranked = numbered(points, F.col("y").desc(), "seq")
    ends = [int(i / rows * n) for i in range(1, rows)]
    low = {r.nth: r.y for r in ranked.where(F.col("nth").isin(ends or [-1])).select("nth", "y").collect()}
    line = F.lit(0)
    for e in ends:
        line = line + (F.col("nth") >= e).cast("int")
    placed = numbered(ranked.withColumn("line", line).withColumnRenamed("nth", "place"), "line", "x", "place")
    edges = [0, *ends, n]
    sizes = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    columns = [partitions // rows + (r < partitions % rows) for r in range(rows)]
    at = [[edges[r] + int(j / columns[r] * sizes[r]) for j in range(1, columns[r])] for r in range(rows)]
    found = {r.nth: r.x for r in placed.where(F.col("nth").isin([k for ks in at for k in ks] or [-1])).select("nth", "x").collect()}
    return [(low.get(ends[r]) if r < rows - 1 else None, [found.get(k) for k in at[r]]) for r in range(rows)]


def str_layout(points: DataFrame, p: Params) -> list[tuple]:
    """Sort-tile-recursive leaves of points (seq, x, y): rows at rank cuts of y from the top, columns at rank cuts of x; the outermost reach beyond the region."""
    far = 1.5 * (p.region[2] - p.region[0])
    left, low, right, high = p.region[0] - far, p.region[1] - far, p.region[2] + far, p.region[3] + far
    top, out = high, []
    for bottom, cuts in str_cuts(points, p.partitions):
        bottom, xs = low if bottom is None else bottom, [left, *(left if c is None else c for c in cuts), right]
        out += [(len(out) + c, xs[c], bottom, xs[c + 1], top) for c in range(len(xs) - 1)]
        top = bottom
    return out


def migration(spark: SparkSession, old: list[tuple], new: list[tuple]) -> DataFrame:
    """(leaf, out, from, region): what each leaf sends to and gets from which others; a retired leaf has no region."""
    a = layout_table(spark, old).withColumnsRenamed({c: f"o{c}" for c in ("leaf", "lxlo", "lylo", "lxhi", "lyhi")})
    b = layout_table(spark, new)
    meet = a.join(F.broadcast(b), intersects(box("ol"), box("l"), -1e-9)).where("oleaf <> leaf")
    region = F.struct("lxlo", "lylo", "lxhi", "lyhi")
    out = meet.groupBy(F.col("oleaf").alias("leaf")).agg(F.array_sort(F.collect_list(F.struct(F.col("leaf").alias("to"), region.alias("region")))).alias("out"))
    into = meet.groupBy("leaf").agg(F.array_sort(F.collect_list("oleaf")).alias("from"))
    every = a.select(F.col("oleaf").alias("leaf")).join(b.select("leaf", region.alias("region")), "leaf", "full")
    return every.join(out, "leaf", "left").join(into, "leaf", "left").select("leaf", "out", "from", "region")
