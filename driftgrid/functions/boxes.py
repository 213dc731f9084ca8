"""Box algebra, grid cells and map projection as Columns: no user functions, all inside code generation."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5


class Box(NamedTuple):
    """Four columns: a closed box."""

    xlo: Column
    ylo: Column
    xhi: Column
    yhi: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + c) for c in ("xlo", "ylo", "xhi", "yhi")))


def near(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.abs(a - b) < F.lit(eps)


def intersects(a: Box, b: Box, eps: float = EPS) -> Column:
    """No axis with a gap over eps."""
    return (a.xlo - b.xhi <= eps) & (b.xlo - a.xhi <= eps) & (a.ylo - b.yhi <= eps) & (b.ylo - a.yhi <= eps)


def contains(a: Box, b: Box, eps: float = EPS) -> Column:
    return (a.xlo - b.xlo <= eps) & (b.xhi - a.xhi <= eps) & (a.ylo - b.ylo <= eps) & (b.yhi - a.yhi <= eps)


def contains_point(a: Box, x: Column, y: Column, eps: float = EPS) -> Column:
    return (a.xlo - x <= eps) & (x - a.xhi <= eps) & (a.ylo - y <= eps) & (y - a.yhi <= eps)


def same(a: Box, b: Box, eps: float = EPS) -> Column:
    """Tolerant equality; two null boxes are the same."""
    out = F.lit(True)
    for p, q in zip(a, b, strict=True):
        out = out & (p.eqNullSafe(q) | F.coalesce(near(p, q, eps), F.lit(False)))
    return out


def edge_overlap(a: Box, b: Box, eps: float = EPS) -> Column:
    """a contains b and they share an edge line."""
    return contains(a, b, eps) & (near(a.xlo, b.xlo, eps) | near(a.xhi, b.xhi, eps) | near(a.ylo, b.ylo, eps) | near(a.yhi, b.yhi, eps))


def not_on_edge_lines(a: Box, x: Column, y: Column, eps: float = EPS) -> Column:
    return ~(near(a.xlo, x, eps) | near(a.xhi, x, eps) | near(a.ylo, y, eps) | near(a.yhi, y, eps))


def bounds_change(whole: Box, old: Box, new: Box, eps: float = EPS) -> Column:
    """Would putting ``new`` in the place of ``old`` change the bounds ``whole``?"""
    touched = near(whole.xlo, old.xlo, eps) | near(whole.ylo, old.ylo, eps) | near(whole.xhi, old.xhi, eps) | near(whole.yhi, old.yhi, eps)
    return touched | ~contains(whole, new, eps)


def center(a: Box) -> tuple[Column, Column]:
    return (a.xlo + a.xhi) / 2.0, (a.ylo + a.yhi) / 2.0


def area(a: Box) -> Column:
    return (a.xhi - a.xlo) * (a.yhi - a.ylo)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.xlo, b.xlo), F.least(a.ylo, b.ylo), F.greatest(a.xhi, b.xhi), F.greatest(a.yhi, b.yhi))


def grow_to(a: Box, x: Column, y: Column) -> Box:
    return Box(F.least(a.xlo, x), F.least(a.ylo, y), F.greatest(a.xhi, x), F.greatest(a.yhi, y))


def grows(a: Box, x: Column, y: Column) -> Column:
    """Whether :func:`grow_to` moves a side."""
    return (x < a.xlo) | (y < a.ylo) | (x > a.xhi) | (y > a.yhi)


def overlap_area(a: Box, b: Box, eps: float = EPS) -> Column:
    side = lambda lo1, hi1, lo2, hi2: F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))
    size = side(a.xlo, a.xhi, b.xlo, b.xhi) * side(a.ylo, a.yhi, b.ylo, b.yhi)
    return F.when(size < eps, 0.0).otherwise(size)


def fixed(x: Column) -> Column:
    """Fixed point with four decimals."""
    return F.floor(x * 10000.0 + 0.5).cast("long")


def unfixed(x: Column) -> Column:
    return x / 10000.0


def overlap(a: Box, b: Box) -> Box:
    """The common box in fixed-point steps; null columns if there is none."""
    lows = [F.greatest(fixed(p), fixed(q)) for p, q in zip(a[:2], b[:2], strict=True)]
    highs = [F.least(fixed(p), fixed(q)) for p, q in zip(a[2:], b[2:], strict=True)]
    meet = (lows[0] <= highs[0]) & (lows[1] <= highs[1])
    return Box(*(F.when(meet, unfixed(c)) for c in (*lows, *highs)))


def extend(a: Box, d) -> Box:
    return Box(a.xlo - d, a.ylo - d, a.xhi + d, a.yhi + d)


def extend_multiple(a: Box, k: float, least: int = 20) -> Box:
    """Each side out by a whole share of its length; by ``least`` on all sides if a share is smaller."""
    dx, dy = ((hi - lo) * k for lo, hi in ((a.xlo, a.xhi), (a.ylo, a.yhi)))
    dx, dy = dx.cast("int"), dy.cast("int")
    small = (dx < least) | (dy < least)
    ex, ey = F.when(small, F.lit(least)).otherwise(dx), F.when(small, F.lit(least)).otherwise(dy)
    return Box(a.xlo - ex, a.ylo - ey, a.xhi + ex, a.yhi + ey)


def extend_int(a: Box) -> Box:
    return Box(F.floor(a.xlo).cast("double"), F.floor(a.ylo).cast("double"), F.ceil(a.xhi).cast("double"), F.ceil(a.yhi).cast("double"))


def extend_big(a: Box, region: tuple[float, float, float, float], eps: float = EPS) -> Box:
    """Sides on the region's edge go out by one and a half region widths."""
    far = 1.5 * (region[2] - region[0])
    return Box(*(F.when(near(c, F.lit(r), eps), c + sign * far).otherwise(c) for c, r, sign in zip(a, region, (-1, -1, 1, 1), strict=True)))


def segment_hits(a: Box, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Exact line test: the part of the segment between the box's slabs is not empty."""
    dx, dy = x2 - x1, y2 - y1
    def slab(d, p, lo, hi):
        t1, t2 = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        inside = (p >= lo) & (p <= hi)
        enter = F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(t1, t2))
        leave = F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(t1, t2))
        return enter, leave
    ex, lx = slab(dx, x1, a.xlo, a.xhi)
    ey, ly = slab(dy, y1, a.ylo, a.yhi)
    return F.greatest(ex, ey, F.lit(0.0)) <= F.least(lx, ly, F.lit(1.0))


def grid_floor(x: Column, high: float, cells: int) -> Column:
    return F.floor(x / F.lit(high / cells)).cast("int")


def grid_ceil(x: Column, high: float, cells: int) -> Column:
    return F.ceil(x / F.lit(high / cells)).cast("int")


def cell_corner(g: Column, high: float, cells: int, upper: bool = False) -> Column:
    return (g + (1 if upper else 0)) * F.lit(high / cells)


class Cells(NamedTuple):
    """Four integer columns: a box of grid cells, both ends included."""

    gx0: Column
    gy0: Column
    gx1: Column
    gy1: Column


def cells_of(a: Box, high: tuple[float, float], cells: int) -> Cells:
    """The cells of a box: from the floor of its low corner to the ceiling of its high one."""
    return Cells(grid_floor(a.xlo, high[0], cells), grid_floor(a.ylo, high[1], cells), grid_ceil(a.xhi, high[0], cells), grid_ceil(a.yhi, high[1], cells))


def cells_box(c: Cells, high: tuple[float, float], cells: int) -> Box:
    """From the lower corner of the low cell to the upper corner of the high one."""
    return Box(cell_corner(c.gx0, high[0], cells), cell_corner(c.gy0, high[1], cells), cell_corner(c.gx1, high[0], cells, True), cell_corner(c.gy1, high[1], cells, True))


def cells_hold(c: Cells, gx: Column, gy: Column) -> Column:
    return (c.gx0 <= gx) & (gx <= c.gx1) & (c.gy0 <= gy) & (gy <= c.gy1)


def cells_meet(a: Cells, b: Cells) -> Column:
    return (a.gx0 <= b.gx1) & (b.gx0 <= a.gx1) & (a.gy0 <= b.gy1) & (b.gy0 <= a.gy1)


def cells_same(a: Cells, b: Cells) -> Column:
    """Equality; two boxes of nulls are the same."""
    out = F.lit(True)
    for p, q in zip(a, b, strict=True):
        out = out & p.eqNullSafe(q)
    return out


def density_cell(c: Column, low: float, high: float, cells: int) -> Column:
    """The grid cell of a center, clamped into the grid."""
    return F.least(F.greatest(F.floor((c - low) / (high - low) * float(cells)).cast("int"), F.lit(0)), F.lit(cells - 1))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def window_start(ts: Column, width: int) -> Column:
    return ts - F.pmod(ts, F.lit(width))


#: Ellipsoid axes in km, standard latitude and origin longitude in degrees.
AXIS_A, AXIS_B, STANDARD_LAT, ORIGIN_LON = 6378.137, 6356.752314, 30.0, 104.0


def mercator(lon: Column, lat: Column, standard_lat: float = STANDARD_LAT, origin_lon: float = ORIGIN_LON) -> tuple[Column, Column]:
    """Ellipsoidal Mercator in metres; coordinates out of range give (0, 0)."""
    e = math.sqrt(1 - (AXIS_B / AXIS_A) ** 2)
    b0 = math.radians(standard_lat)
    second = (AXIS_A / AXIS_B) ** 2 - 1
    k = AXIS_A**2 / AXIS_B / math.sqrt(1 + second * math.cos(b0) ** 2) * math.cos(b0) * 1000.0
    stretch = lambda s, t: F.log(t * F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2)))
    b = F.radians(lat)
    y0 = math.log(math.tan(math.pi / 4 + b0 / 2) * ((1 - e * math.sin(b0)) / (1 + e * math.sin(b0))) ** (e / 2))
    ok = (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    x, y = k * (F.radians(lon) - math.radians(origin_lon)), k * (stretch(F.sin(b), F.tan(math.pi / 4 + b / 2)) - y0)
    return F.when(ok, x).otherwise(0.0), F.when(ok, y).otherwise(0.0)


def fixed_text(x: Column, decimals: int = 5) -> Column:
    """Decimal text without a leading zero."""
    return F.regexp_replace(F.format_string(f"%.{decimals}f", x), r"^(-?)0\.", "$1.")


def date_text(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch milliseconds as text in the session's time zone; ``hh`` for twelve hours."""
    return F.date_format(F.timestamp_millis(ts), pattern)


def path_code(path: Column) -> Column:
    """A tree path (array of quadrants) as one long, three bits a level behind a leading one."""
    return F.aggregate(path, F.lit(1).cast("long"), lambda acc, q: acc * 8 + q)


def same_way(a: Column, b: Column) -> Column:
    """Tree paths as arrays: 1 if a leads to b, -1 if b leads to a, else 0."""
    return F.when(F.slice(b, 1, F.greatest(F.size(a), F.lit(0))) == a, 1).when(F.slice(a, 1, F.size(b)) == b, -1).otherwise(0)
