"""All queries over the test tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions import boxes as B
from driftgrid.functions import collections as K
from driftgrid.operators import blocks, joins, layouts, trajectories
from driftgrid.params import FIXTURE as P
from driftgrid.plans import frames
from driftgrid.sources import points as S

W, L, R, M, E, N = P.window_ms, P.logical_windows, P.radius, P.max_segment, P.eps, P.ratio

PTS = "pts AS (SELECT event_id AS seq, user_id AS tid, epoch_us(ts) // 1000 AS ts, value * 15.0 AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 88.0 AS y FROM events)"
LG = "lg AS (SELECT *, lag(ts) OVER t AS ts0, lag(x) OVER t AS x0, lag(y) OVER t AS y0 FROM pts WINDOW t AS (PARTITION BY tid ORDER BY seq))"
OK = f"ts0 IS NOT NULL AND NOT (abs(x - x0) < {E} AND abs(y - y0) < {E}) AND abs(x - x0) <= {M} AND abs(y - y0) <= {M}"
SEG = f"""seg AS (SELECT seq, tid, CASE WHEN ts >= ts0 THEN ts0 ELSE ts END AS ts1, CASE WHEN ts >= ts0 THEN ts ELSE ts0 END AS ts2,
  CASE WHEN ts >= ts0 THEN x0 ELSE x END AS x1, CASE WHEN ts >= ts0 THEN x ELSE x0 END AS x2, CASE WHEN ts >= ts0 THEN y0 ELSE y END AS y1, CASE WHEN ts >= ts0 THEN y ELSE y0 END AS y2,
  least(x, x0) AS xlo, greatest(x, x0) AS xhi, least(y, y0) AS ylo, greatest(y, y0) AS yhi FROM lg WHERE {OK})"""
SEGW = f"segw AS (SELECT *, ts2 - ts2 % {W} AS win FROM seg)"
Q = f"q AS (SELECT rn // {N} AS qid, ts2 AS ts, win, x2 - {R} AS qxlo, y2 - {R} AS qylo, x2 + {R} AS qxhi, y2 + {R} AS qyhi FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS rn FROM segw) WHERE rn % {N} = 0)"
BASE = f"WITH {PTS}, {LG}, {SEG}, {SEGW}, {Q} "
HIT = f"qxlo - xhi <= {E} AND xlo - qxhi <= {E} AND qylo - yhi <= {E} AND ylo - qyhi <= {E}"
BAND = f"s.win <= q.win AND s.win > q.win - {L * W}"
COUNTS = f"{BASE}SELECT q.qid, count(s.seq) AS n_hits, CAST(coalesce(sum(s.seq), 0) AS BIGINT) AS seq_sum FROM q LEFT JOIN segw s ON {BAND} AND {HIT} GROUP BY q.qid"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _points(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return S.event_points(spark, d)


def _segments(spark, d):
    return trajectories.segments(_points(spark, d), P)


def _queries(spark, d):
    return trajectories.range_queries(_segments(spark, d), P)


def _summed(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Number of hits and sum of their ids for each query."""
    out = pairs.groupBy("qid").agg(F.count("*").alias("n"), F.sum("seq").alias("s"))
    return queries.select("qid").join(out, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("s", F.lit(0)).cast("long").alias("seq_sum"))


query("parse_points", f"WITH {PTS} SELECT * FROM pts")(_points)
query("segments", f"WITH {PTS}, {LG}, {SEG}, {SEGW} SELECT seq, tid, ts1, ts2, x1, x2, y1, y2, xlo, ylo, xhi, yhi, win FROM segw")(_segments)
query("range_queries", f"{BASE}SELECT * FROM q")(_queries)


@query("pair_points", f"WITH {PTS}, {LG} SELECT * FROM lg")
def pair_points(spark, d):
    return trajectories.pair_points(_points(spark, d))


_STILL = 150.0


@query("stationary_filter", f"WITH {PTS}, {LG} SELECT seq, abs(x - x0) < {_STILL} AND abs(y - y0) < {_STILL} AS wide, abs(x - x0) < {E} AND abs(y - y0) < {E} AS still FROM lg WHERE ts0 IS NOT NULL")
def stationary_filter(spark, d):
    """Which moves are stationary: by the usual tolerance, by which none of the test tables is, and by a wide one."""
    still = lambda eps: B.near(F.col("x"), F.col("x0"), eps) & B.near(F.col("y"), F.col("y0"), eps)
    return trajectories.pair_points(_points(spark, d)).where("ts0 IS NOT NULL").select("seq", still(_STILL).alias("wide"), still(E).alias("still"))


@query("jump_filter", f"WITH {PTS}, {LG} SELECT seq FROM lg WHERE abs(x - x0) > {M} OR abs(y - y0) > {M}")
def jump_filter(spark, d):
    return trajectories.pair_points(_points(spark, d)).where((F.abs(F.col("x") - F.col("x0")) > M) | (F.abs(F.col("y") - F.col("y0")) > M)).select("seq")


@query("gap_cut_segments", f"WITH {PTS}, {LG}, {SEG} SELECT seq, tid FROM seg WHERE ts2 - ts1 <= 86400000")
def gap_cut_segments(spark, d):
    from dataclasses import replace

    return trajectories.segments(_points(spark, d), replace(P, inactivity_ms=86_400_000)).select("seq", "tid")


@query("window_start", f"WITH {PTS} SELECT seq, ts - ts % {W} AS win FROM pts")
def window_start(spark, d):
    return _points(spark, d).select("seq", B.window_start(F.col("ts"), W).alias("win"))


def _frame(name: str):
    def f(spark, d):
        pts = _points(spark, d)
        prepared = frames.prepare(pts, P)
        return _summed(frames.pairs(name, pts, P, prepared), prepared[1])

    return f


for _name in frames.FRAMES:
    query("range_join_intersects" if _name == "grid" else f"frame_{_name}", COUNTS)(_frame(_name))


@query("range_join_contains", f"{BASE}SELECT q.qid, count(s.seq) AS n_hits, CAST(coalesce(sum(s.seq), 0) AS BIGINT) AS seq_sum FROM q LEFT JOIN segw s ON {BAND} AND qxlo - xlo <= {E} AND xhi - qxhi <= {E} AND qylo - ylo <= {E} AND yhi - qyhi <= {E} GROUP BY q.qid")
def range_join_contains(spark, d):
    segs = _segments(spark, d)
    queries = trajectories.range_queries(segs, P)
    return _summed(joins.range_pairs(queries, segs, P, inside=True), queries)


@query("point_in_rect", f"{BASE}SELECT q.qid, count(p.seq) AS n_points, CAST(coalesce(sum(p.seq), 0) AS BIGINT) AS seq_sum FROM q LEFT JOIN pts p ON qxlo - x <= {E} AND x - qxhi <= {E} AND qylo - y <= {E} AND y - qyhi <= {E} GROUP BY q.qid")
def point_in_rect(spark, d):
    """All query squares against all points."""
    queries = _queries(spark, d)
    pairs = joins.points_in_boxes(_points(spark, d), queries.select("qid", "qxlo", "qylo", "qxhi", "qyhi"), 2 * P.radius, P.eps)
    return _summed(pairs, queries).withColumnRenamed("n_hits", "n_points")


@query("result_merge", f"{BASE}SELECT q.qid, q.win, CAST(len(list_distinct(list(s.seq) FILTER (s.seq IS NOT NULL))) AS BIGINT) AS n, array_to_string(list_sort(list(s.seq) FILTER (s.seq IS NOT NULL)), ',') AS seqs FROM q LEFT JOIN segw s ON {BAND} AND {HIT} GROUP BY q.qid, q.win")
def result_merge(spark, d):
    segs, queries = frames.prepare(_points(spark, d), P, ("seq",))
    return blocks.texts(queries, segs, P)


_IN = f"qxlo - xlo <= {E} AND xhi - qxhi <= {E} AND qylo - ylo <= {E} AND yhi - qyhi <= {E}"


@query("diff_frames", f"{BASE}SELECT q.qid, s.seq, CASE WHEN {_IN} THEN 'right' ELSE 'left' END AS side FROM q JOIN segw s ON {BAND} WHERE ({HIT}) AND s.seq % 2 = 0 AND NOT ({_IN}) OR s.seq % 2 = 1 AND {_IN}")
def diff_frames(spark, d):
    """Segments of even number that meet a square, under sort-tile leaves, against all that lie inside one, under the grid: what only one side has."""
    pts = _points(spark, d)
    segs, queries = frames.prepare(pts, P, ("seq",))
    meet = blocks.Side(frames.str_leaves(pts, P), of=F.col("seq") % 2 == 0)
    return blocks.differences(queries, segs, P, meet, blocks.Side(inside=True))


_G, (_X0, _Y0, _X1, _Y1) = P.grid, P.region
_CELL = lambda c, lo, hi: f"CAST(least(greatest(floor(({c} - {lo}) / ({hi} - {lo}) * {float(_G)}), 0), {_G - 1}) AS INT)"
DENS = f"dens AS (SELECT CAST(ceil(win / CAST({W * L} AS DOUBLE)) AS BIGINT) AS cycle, {_CELL('((xlo + xhi) / 2.0)', _X0, _X1)} AS gx, {_CELL('((ylo + yhi) / 2.0)', _Y0, _Y1)} AS gy, count(*) AS cnt FROM segw GROUP BY ALL)"
DBASE = f"WITH {PTS}, {LG}, {SEG}, {SEGW}, {DENS} "


def _density(spark, d):
    return trajectories.density(_segments(spark, d), P)


query("density_cycle", f"{DBASE}SELECT * FROM dens")(_density)


@query("density_grid", f"{DBASE}SELECT gx, gy, CAST(sum(cnt) AS BIGINT) AS cnt FROM dens GROUP BY gx, gy")
def density_grid(spark, d):
    return _density(spark, d).groupBy("gx", "gy").agg(F.sum("cnt").alias("cnt"))


@query("grid_box_sum", f"{DBASE}SELECT CAST(sum(cnt) AS BIGINT) AS total FROM dens WHERE gx BETWEEN 0 AND 31 AND gy BETWEEN 16 AND 95")
def grid_box_sum(spark, d):
    return _density(spark, d).where("gx BETWEEN 0 AND 31 AND gy BETWEEN 16 AND 95").agg(F.sum("cnt").alias("total"))


def _marginal(axis: str):
    def f(spark, d):
        return _density(spark, d).groupBy(axis).agg(F.sum("cnt").alias("cnt"))

    return query(f"marginal_{axis[1]}", f"{DBASE}SELECT {axis}, CAST(sum(cnt) AS BIGINT) AS cnt FROM dens GROUP BY {axis}")(f)


_marginal("gx")
_marginal("gy")


@query("prefix_threshold", f"{DBASE}, m AS (SELECT gx, sum(cnt) AS c FROM dens GROUP BY gx), r AS (SELECT gx, sum(c) OVER (ORDER BY gx) AS s FROM m) SELECT min(gx) AS place FROM r WHERE s >= 300")
def prefix_threshold(spark, d):
    return trajectories.prefix_threshold(_density(spark, d).groupBy("gx").agg(F.sum("cnt").alias("cnt")), 300)


@query("argmax_cell", f"{DBASE}, g AS (SELECT gx, gy, CAST(sum(cnt) AS BIGINT) AS cnt FROM dens GROUP BY gx, gy) SELECT * FROM g ORDER BY cnt DESC, gx, gy LIMIT 1")
def argmax_cell(spark, d):
    return density_grid(spark, d).orderBy(F.col("cnt").desc(), "gx", "gy").limit(1)


@query("matrix_add", f"{DBASE}SELECT gx, gy, CAST(sum(CASE WHEN cycle % 2 = 0 THEN cnt ELSE -cnt END) AS BIGINT) AS diff FROM dens GROUP BY gx, gy")
def matrix_add(spark, d):
    dens = _density(spark, d)
    even, odd = dens.where("cycle % 2 = 0"), dens.where("cycle % 2 <> 0").withColumn("cnt", -F.col("cnt"))
    return even.unionByName(odd).groupBy("gx", "gy").agg(F.sum("cnt").alias("diff"))


@query("tree_rollup", f"{DBASE}SELECT gx // 64 AS qx, gy // 64 AS qy, CAST(sum(cnt) AS BIGINT) AS cnt FROM dens GROUP BY ROLLUP (qx, qy)")
def tree_rollup(spark, d):
    return _density(spark, d).withColumns({"qx": F.expr("CAST(gx div 64 AS INT)"), "qy": F.expr("CAST(gy div 64 AS INT)")}).rollup("qx", "qy").agg(F.sum("cnt").alias("cnt"))


@query("mbr_segments", f"WITH {PTS}, {LG}, {SEG} SELECT tid, min(xlo) AS xlo, min(ylo) AS ylo, max(xhi) AS xhi, max(yhi) AS yhi FROM seg GROUP BY tid")
def mbr_segments(spark, d):
    return _segments(spark, d).groupBy("tid").agg(F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"))


@query("mbr_points", f"WITH {PTS} SELECT tid, min(x) AS xlo, min(y) AS ylo, max(x) AS xhi, max(y) AS yhi FROM pts GROUP BY tid")
def mbr_points(spark, d):
    return _points(spark, d).groupBy("tid").agg(F.min("x").alias("xlo"), F.min("y").alias("ylo"), F.max("x").alias("xhi"), F.max("y").alias("yhi"))


@query("window_counts", f"{BASE}, b AS (SELECT ts2 AS ts, 1 AS s, 0 AS q FROM segw UNION ALL SELECT ts, 0, 1 FROM q) SELECT ts - ts % 600000 AS win, CAST(sum(s) AS BIGINT) AS n_segments, CAST(sum(q) AS BIGINT) AS n_queries FROM b GROUP BY 1")
def window_counts(spark, d):
    segs = _segments(spark, d)
    return trajectories.window_counts(segs, trajectories.range_queries(segs, P))


@query("point_counts", f"WITH {PTS} SELECT ts - ts % 600000 AS win, count(*) AS n FROM pts GROUP BY 1")
def point_counts(spark, d):
    return _points(spark, d).groupBy(B.window_start(F.col("ts"), 600_000).alias("win")).agg(F.count("*").alias("n"))


# Box functions over each segment's bounds (a) and its query-like square (b).
SB = f"WITH {PTS}, {LG}, {SEG}, ab AS (SELECT seq, xlo AS axlo, ylo AS aylo, xhi AS axhi, yhi AS ayhi, x2 - seq % 300 AS bxlo, y2 - seq % 200 AS bylo, x2 + seq % 100 AS bxhi, y2 + seq % 50 AS byhi, x1, y1, x2, y2 FROM seg) "


def _ab(spark, d):
    s, m = _segments(spark, d), lambda k: F.col("seq") % k
    return s.select("seq", *[F.col(c).alias("a" + c) for c in ("xlo", "ylo", "xhi", "yhi")], (F.col("x2") - m(300)).alias("bxlo"), (F.col("y2") - m(200)).alias("bylo"), (F.col("x2") + m(100)).alias("bxhi"), (F.col("y2") + m(50)).alias("byhi"), "x1", "y1", "x2", "y2")


def _scalar(name: str, columns: dict, sql: dict):
    query(name, SB + "SELECT seq, " + ", ".join(f"{v} AS {k}" for k, v in sql.items()) + " FROM ab")(lambda spark, d: _ab(spark, d).select("seq", *[c.alias(k) for k, c in columns().items()]))


_a, _b = lambda: B.box("a"), lambda: B.box("b")
_x, _y = lambda: F.col("x2"), lambda: F.col("y2")
_sides = lambda f: lambda: dict(zip(("rxlo", "rylo", "rxhi", "ryhi"), f(), strict=True))
_four = lambda *s: dict(zip(("rxlo", "rylo", "rxhi", "ryhi"), s, strict=True))
_near = lambda p, q: f"abs({p} - {q}) < {E}"
_CONT = f"(axlo - bxlo <= {E} AND bxhi - axhi <= {E} AND aylo - bylo <= {E} AND byhi - ayhi <= {E})"
_fix = lambda c: f"CAST(floor({c} * 10000.0 + 0.5) AS BIGINT)"

_scalar("rect_intersects", lambda: {"r": B.intersects(_a(), _b())}, {"r": f"axlo - bxhi <= {E} AND bxlo - axhi <= {E} AND aylo - byhi <= {E} AND bylo - ayhi <= {E}"})
_scalar("rect_contains", lambda: {"r": B.contains(_a(), _b()), "p": B.contains_point(_a(), _x(), _y())}, {"r": _CONT, "p": f"axlo - x2 <= {E} AND x2 - axhi <= {E} AND aylo - y2 <= {E} AND y2 - ayhi <= {E}"})
_scalar("rect_edge_overlap", lambda: {"r": B.edge_overlap(_a(), _b()), "off": B.not_on_edge_lines(_b(), _x(), _y())}, {"r": f"{_CONT} AND ({_near('axlo', 'bxlo')} OR {_near('axhi', 'bxhi')} OR {_near('aylo', 'bylo')} OR {_near('ayhi', 'byhi')})", "off": f"NOT ({_near('bxlo', 'x2')} OR {_near('bxhi', 'x2')} OR {_near('bylo', 'y2')} OR {_near('byhi', 'y2')})"})
_scalar("rect_same", lambda: {"r": B.same(_a(), _b())}, {"r": " AND ".join(_near(f"a{c}", f"b{c}") for c in ("xlo", "ylo", "xhi", "yhi"))})
_scalar("rect_center", lambda: dict(zip(("cx", "cy"), B.center(_a()), strict=True)), {"cx": "(axlo + axhi) / 2.0", "cy": "(aylo + ayhi) / 2.0"})
_scalar("rect_area", lambda: {"r": B.area(_a())}, {"r": "(axhi - axlo) * (ayhi - aylo)"})
_ov = "greatest(0.0, least(axhi, bxhi) - greatest(axlo, bxlo)) * greatest(0.0, least(ayhi, byhi) - greatest(aylo, bylo))"
_scalar("rect_intersection_area", lambda: {"r": B.overlap_area(_a(), _b())}, {"r": f"CASE WHEN {_ov} < {E} THEN 0.0 ELSE {_ov} END"})
_lo, _hi = [f"greatest({_fix('a' + c)}, {_fix('b' + c)})" for c in ("xlo", "ylo")], [f"least({_fix('a' + c)}, {_fix('b' + c)})" for c in ("xhi", "yhi")]
_scalar("rect_intersection_box", _sides(lambda: B.overlap(_a(), _b())), _four(*[f"CASE WHEN {_lo[0]} <= {_hi[0]} AND {_lo[1]} <= {_hi[1]} THEN {c} / 10000.0 END" for c in _lo + _hi]))
_scalar("rect_union", _sides(lambda: B.union(_a(), _b())), _four("least(axlo, bxlo)", "least(aylo, bylo)", "greatest(axhi, bxhi)", "greatest(ayhi, byhi)"))
_scalar("rect_grow", lambda: _sides(lambda: B.grow_to(_b(), F.col("x1"), F.col("y1")))() | {"changed": B.grows(_b(), F.col("x1"), F.col("y1"))}, _four("least(bxlo, x1)", "least(bylo, y1)", "greatest(bxhi, x1)", "greatest(byhi, y1)") | {"changed": "NOT (x1 BETWEEN bxlo AND bxhi AND y1 BETWEEN bylo AND byhi)"})
_scalar("rect_extend", _sides(lambda: B.extend(_a(), 7.5)), _four("axlo - 7.5", "aylo - 7.5", "axhi + 7.5", "ayhi + 7.5"))
_dx, _dy = "CAST(trunc((axhi - axlo) * 0.25) AS INT)", "CAST(trunc((ayhi - aylo) * 0.25) AS INT)"
_ex, _ey = (f"CASE WHEN {_dx} < 20 OR {_dy} < 20 THEN 20 ELSE {v} END" for v in (_dx, _dy))
_scalar("rect_extend_multiple", _sides(lambda: B.extend_multiple(_a(), 0.25)), _four(f"axlo - {_ex}", f"aylo - {_ey}", f"axhi + {_ex}", f"ayhi + {_ey}"))
_scalar("rect_extend_int", _sides(lambda: B.extend_int(_a())), _four("floor(axlo)", "floor(aylo)", "ceil(axhi)", "ceil(ayhi)"))
_far = 1.5 * (_X1 - _X0)
_scalar("rect_extend_big", _sides(lambda: B.extend_big(_a(), P.region)), _four(*[f"CASE WHEN {_near(c, r)} THEN {c} {s} {_far} ELSE {c} END" for c, r, s in (("axlo", _X0, "-"), ("aylo", _Y0, "-"), ("axhi", _X1, "+"), ("ayhi", _Y1, "+"))]))
_scalar("grid_cell", lambda: {"f": B.grid_floor(_x(), _X1, _G), "c": B.grid_ceil(_y(), _Y1, _G)}, {"f": f"CAST(floor(x2 / {_X1 / _G}) AS INT)", "c": f"CAST(ceil(y2 / {_Y1 / _G}) AS INT)"})
_scalar("grid_to_rect", lambda: {"lo": B.cell_corner(B.grid_floor(_x(), _X1, _G), _X1, _G), "hi": B.cell_corner(B.grid_floor(_x(), _X1, _G), _X1, _G, True)}, {"lo": f"CAST(floor(x2 / {_X1 / _G}) AS INT) * CAST({_X1 / _G} AS DOUBLE)", "hi": f"(CAST(floor(x2 / {_X1 / _G}) AS INT) + 1) * CAST({_X1 / _G} AS DOUBLE)"})
_scalar("distance", lambda: {"r": F.round(B.distance(F.col("x1"), F.col("y1"), _x(), _y()), 6)}, {"r": "round(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)), 6)"})
_scalar("fixed_text", lambda: {"t": B.fixed_text(_x() - F.floor(_x()), 4)}, {"t": "regexp_replace(printf('%.4f', x2 - floor(x2)), '^(-?)0[.]', '\\1.')"})


def _mercator_sql() -> str:
    import math

    e, b0, k2 = math.sqrt(1 - (B.AXIS_B / B.AXIS_A) ** 2), math.radians(B.STANDARD_LAT), (B.AXIS_A / B.AXIS_B) ** 2 - 1
    k = B.AXIS_A**2 / B.AXIS_B / math.sqrt(1 + k2 * math.cos(b0) ** 2) * math.cos(b0) * 1000.0
    y0 = math.log(math.tan(math.pi / 4 + b0 / 2) * ((1 - e * math.sin(b0)) / (1 + e * math.sin(b0))) ** (e / 2))
    lon, lat = "(100.0 + x2 / 1000.0)", "(y2 / 100.0)"
    ok, s = f"abs({lon}) <= 180 AND abs({lat}) <= 90", f"sin(radians({lat}))"
    return SB + f"SELECT seq, round(CASE WHEN {ok} THEN {k} * (radians({lon}) - {math.radians(B.ORIGIN_LON)}) ELSE 0.0 END, 3) AS mx, round(CASE WHEN {ok} THEN {k} * (ln(tan({math.pi / 4} + radians({lat}) / 2) * pow((1 - {e} * {s}) / (1 + {e} * {s}), {e / 2})) - {y0}) ELSE 0.0 END, 3) AS my FROM ab"


@query("mercator", _mercator_sql())
def mercator(spark, d):
    x, y = B.mercator(100.0 + F.col("x2") / 1000.0, F.col("y2") / 100.0)
    return _ab(spark, d).select("seq", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


# Boxes beside each segment's middle that hold neither end, and three boxes that differ.
_HALF, _MX, _MY = "(seq % 300 + 0.5)", "((x1 + x2) / 2.0 + (seq % 41 - 20) * 10.0)", "((y1 + y2) / 2.0 + (seq % 37 - 18) * 10.0)"
_LINE = f"WITH {PTS}, {LG}, {SEG}, mid AS (SELECT seq, x1, y1, x2, y2, xlo, ylo, xhi, yhi, {_MX} - CAST({_HALF} AS DOUBLE) AS cxlo, {_MY} - CAST({_HALF} AS DOUBLE) AS cylo, {_MX} + CAST({_HALF} AS DOUBLE) AS cxhi, {_MY} + CAST({_HALF} AS DOUBLE) AS cyhi FROM seg)"
_HOLDS = lambda k: f"(x{k} BETWEEN cxlo AND cxhi AND y{k} BETWEEN cylo AND cyhi)"
_SIDE = lambda x, y: f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)"
_SIDES = ", ".join(_SIDE(x, y) for x in ("cxlo", "cxhi") for y in ("cylo", "cyhi"))
_MEET = "(xlo <= cxhi AND cxlo <= xhi AND ylo <= cyhi AND cylo <= yhi)"


@query("segment_exact_refine", f"{_LINE} SELECT seq, {_MEET} AS meets, {_MEET} AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0 AS hit FROM mid WHERE NOT {_HOLDS(1)} AND NOT {_HOLDS(2)}")
def segment_exact_refine(spark, d):
    """Bounds test and exact line test of each segment against a box that holds no end of it; the SQL tests on which side of the line the corners are."""
    half = F.col("seq") % 300 + 0.5
    mx, my = (F.col("x1") + F.col("x2")) / 2.0 + (F.col("seq") % 41 - 20) * 10.0, (F.col("y1") + F.col("y2")) / 2.0 + (F.col("seq") % 37 - 18) * 10.0
    s = _segments(spark, d).withColumns({"cxlo": mx - half, "cylo": my - half, "cxhi": mx + half, "cyhi": my + half})
    c, ends = B.box("c"), ((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    s = s.where(~B.contains_point(c, *ends[0], 0.0) & ~B.contains_point(c, *ends[1], 0.0))
    return s.select("seq", B.intersects(B.box(), c, 0.0).alias("meets"), B.segment_hits(c, *ends[0], *ends[1]).alias("hit"))


_wide = lambda: B.extend(_a(), F.col("seq") % 3 * 150.0)
_WIDE = [f"(a{c} {o} seq % 3 * CAST(150 AS DOUBLE))" for c, o in (("xlo", "-"), ("ylo", "-"), ("xhi", "+"), ("yhi", "+"))]
_touch = " OR ".join(_near(w, f"a{c}") for w, c in zip(_WIDE, ("xlo", "ylo", "xhi", "yhi"), strict=True))
_scalar("rect_bounds_change", lambda: {"r": B.bounds_change(_wide(), _a(), _b())}, {"r": f"{_touch} OR NOT ({_WIDE[0]} - bxlo <= {E} AND {_WIDE[1]} - bylo <= {E} AND bxhi - {_WIDE[2]} <= {E} AND byhi - {_WIDE[3]} <= {E})"})


@query("order_points", f"WITH {PTS} SELECT seq, row_number() OVER (PARTITION BY tid ORDER BY ts, seq) AS place FROM pts")
def order_points(spark, d):
    from pyspark.sql import Window

    return _points(spark, d).select("seq", F.row_number().over(Window.partitionBy("tid").orderBy("ts", "seq")).cast("long").alias("place"))


@query("round_robin_split", f"WITH {PTS} SELECT seq % 7 AS part, count(*) AS n FROM pts GROUP BY 1")
def round_robin_split(spark, d):
    return _points(spark, d).groupBy(F.pmod("seq", F.lit(7)).alias("part")).agg(F.count("*").alias("n"))


@query("assign_random", f"WITH {PTS}, {LG}, {SEG} SELECT seq % 16 AS part, count(*) AS n FROM seg GROUP BY 1")
def assign_random(spark, d):
    return _segments(spark, d).groupBy(F.pmod("seq", F.lit(16)).alias("part")).agg(F.count("*").alias("n"))


_BOXES = layouts.to_boxes(layouts.quadrants(P), P)
_LV = "lay(leaf, lxlo, lylo, lxhi, lyhi) AS (VALUES " + ", ".join("(" + ", ".join(f"CAST({v} AS DOUBLE)" if k else str(v) for k, v in enumerate(b)) + ")" for b in _BOXES) + ")"


_MEETS = f"lxlo - xhi <= {E} AND xlo - lxhi <= {E} AND lylo - yhi <= {E} AND ylo - lyhi <= {E}"


@query("assign_quad0", f"WITH {PTS}, {LG}, {SEG}, {_LV} SELECT seq, leaf FROM seg JOIN lay ON {_MEETS}")
def assign_quad0(spark, d):
    return joins.assign(_segments(spark, d), _BOXES).select("seq", "leaf")


@query("element_lookup", f"WITH {PTS}, {LG}, {SEG}, {_LV} SELECT seq, count(*) AS n_leaves, min(leaf) AS first_leaf FROM seg JOIN lay ON {_MEETS} GROUP BY seq")
def element_lookup(spark, d):
    """In which leaves each segment is found; those on a border are in several."""
    found = joins.holders(_segments(spark, d), assign_quad0(spark, d))
    return found.groupBy("seq").agg(F.count("*").alias("n_leaves"), F.min("leaf").alias("first_leaf"))


_HALVES = [layouts.Leaf(0, 0, 31, 127, 0, (0,), 0), layouts.Leaf(32, 0, 127, 100, 0, (1,), 1), layouts.Leaf(32, 101, 127, 127, 0, (2,), 2)]
_tiles = lambda name, leaves: f"{name}(leaf, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({x.id}, {x.x0}, {x.y0}, {x.x1}, {x.y1})" for x in leaves) + ")"
_TILES = f"{_tiles('told', layouts.quadrants(P))}, {_tiles('tnew', _HALVES)}"
_IN_TILE = "gx BETWEEN {0}.x0 AND {0}.x1 AND gy BETWEEN {0}.y0 AND {0}.y1"


@query("cell_leaf", f"{DBASE[:-1]}, {_TILES} SELECT DISTINCT gx, gy, tnew.leaf FROM dens JOIN tnew ON {_IN_TILE.format('tnew')}")
def cell_leaf(spark, d):
    return layouts.leaf_of_cell(_density(spark, d).select("gx", "gy").distinct(), _HALVES)


@query("leaf_overlap", f"{DBASE[:-1]}, {_TILES} SELECT tnew.leaf AS new_leaf, told.leaf AS old_leaf, CAST(sum(cnt) AS BIGINT) AS cnt FROM dens JOIN told ON {_IN_TILE.format('told')} JOIN tnew ON {_IN_TILE.format('tnew')} GROUP BY 1, 2")
def leaf_overlap(spark, d):
    """Items common to each leaf of a new layout and each of the old one."""
    return layouts.overlap_table(_density(spark, d), _HALVES, layouts.quadrants(P))


_LEAF_COUNTS = f"{DBASE[:-1]}, {_TILES}, lc AS (SELECT told.leaf, CAST(sum(cnt) AS BIGINT) AS n FROM dens JOIN told ON {_IN_TILE.format('told')} GROUP BY 1)"


def _leaf_counts(spark, d):
    return layouts.leaf_of_cell(_density(spark, d), layouts.quadrants(P)).groupBy("leaf").agg(F.sum("cnt").alias("n"))


query("leaf_totals", f"{_LEAF_COUNTS} SELECT leaf, n FROM lc")(_leaf_counts)


@query("argmax_leaf", f"{_LEAF_COUNTS} SELECT leaf, n FROM lc ORDER BY n DESC, leaf LIMIT 1")
def argmax_leaf(spark, d):
    return _leaf_counts(spark, d).agg(F.max_by(F.struct("leaf", "n"), F.struct("n", -F.col("leaf"))).alias("m")).select("m.leaf", "m.n")


@query("leaf_order", f"{_LEAF_COUNTS} SELECT leaf, row_number() OVER (ORDER BY n, leaf) AS place FROM lc")
def leaf_order(spark, d):
    """Leaves from the fewest items to the most; a layout has few leaves."""
    from pyspark.sql import Window

    return _leaf_counts(spark, d).select("leaf", F.row_number().over(Window.orderBy("n", "leaf")).cast("long").alias("place"))


@query("index_size", f"WITH {PTS}, {LG}, {SEG}, {SEGW}, w AS (SELECT win, count(*) AS n FROM segw GROUP BY win) SELECT a.win, a.n, CAST(sum(b.n) AS BIGINT) AS retained FROM w a JOIN w b ON b.win <= a.win AND b.win > a.win - {L * W} GROUP BY a.win, a.n")
def index_size(spark, d):
    """Segments of each pane, and of all panes that are kept while it is the newest; a row for each pane."""
    return trajectories.retained(_segments(spark, d), P)


@query("matrix_equal", f"{DBASE}, e AS (SELECT gx, gy, sum(cnt) AS c FROM dens WHERE cycle % 2 = 0 GROUP BY gx, gy), o AS (SELECT gx, gy, sum(cnt) AS c FROM dens WHERE cycle % 2 <> 0 GROUP BY gx, gy) SELECT gx, gy, coalesce(e.c, 0) = coalesce(o.c, 0) AS same FROM e FULL JOIN o USING (gx, gy)")
def matrix_equal(spark, d):
    """Cell by cell, whether even and odd cycles have the same density."""
    sums = lambda cond, name: _density(spark, d).where(cond).groupBy("gx", "gy").agg(F.sum("cnt").alias(name))
    both = sums("cycle % 2 = 0", "e").join(sums("cycle % 2 <> 0", "o"), ["gx", "gy"], "full")
    return both.select("gx", "gy", (F.coalesce("e", F.lit(0)) == F.coalesce("o", F.lit(0))).alias("same"))


_HIGH = (_X1, _Y1)
_gf, _gc = lambda c, h: f"CAST(floor({c} / {h / _G}) AS INT)", lambda c, h: f"CAST(ceil({c} / {h / _G}) AS INT)"
_cells_sql = lambda p: (_gf(f"{p}xlo", _X1), _gf(f"{p}ylo", _Y1), _gc(f"{p}xhi", _X1), _gc(f"{p}yhi", _Y1))
_ca, _cb = _cells_sql("a"), _cells_sql("b")


def _grid_boxes():
    a, b = B.cells_of(_a(), _HIGH, _G), B.cells_of(_b(), _HIGH, _G)
    back = B.cells_box(a, _HIGH, _G)
    gx, gy = B.grid_floor(_x(), _X1, _G), B.grid_floor(_y(), _Y1, _G)
    return dict(zip(("gx0", "gy0", "gx1", "gy1"), a, strict=True)) | dict(zip(("xlo", "ylo", "xhi", "yhi"), back, strict=True)) | {"holds": B.cells_hold(b, gx, gy), "meets": B.cells_meet(a, b), "same": B.cells_same(a, b)}


_scalar("grid_box", _grid_boxes, dict(zip(("gx0", "gy0", "gx1", "gy1"), _ca, strict=True)) | {
    "xlo": f"{_ca[0]} * CAST({_X1 / _G} AS DOUBLE)", "ylo": f"{_ca[1]} * CAST({_Y1 / _G} AS DOUBLE)", "xhi": f"({_ca[2]} + 1) * CAST({_X1 / _G} AS DOUBLE)", "yhi": f"({_ca[3]} + 1) * CAST({_Y1 / _G} AS DOUBLE)",
    "holds": f"{_gf('x2', _X1)} BETWEEN {_cb[0]} AND {_cb[2]} AND {_gf('y2', _Y1)} BETWEEN {_cb[1]} AND {_cb[3]}",
    "meets": f"{_ca[0]} <= {_cb[2]} AND {_cb[0]} <= {_ca[2]} AND {_ca[1]} <= {_cb[3]} AND {_cb[1]} <= {_ca[3]}",
    "same": " AND ".join(f"{p} = {q}" for p, q in zip(_ca, _cb, strict=True)),
})
_PA, _PB = "CASE WHEN seq % 2 = 1 THEN [seq // 4 % 4, seq % 4] ELSE [seq // 4 % 4] END", "CASE WHEN seq % 5 < 2 THEN [seq // 16 % 4] ELSE [seq // 16 % 4, seq // 64 % 2] END"


def _paths():
    """Paths of one or two levels."""
    a, b = F.array(F.expr("seq div 4 % 4"), F.expr("seq % 4")), F.array(F.expr("seq div 16 % 4"), F.expr("seq div 64 % 2"))
    return F.slice(a, F.lit(1), (1 + F.col("seq") % 2).cast("int")), F.slice(b, F.lit(1), F.when(F.col("seq") % 5 < 2, 1).otherwise(2))


_scalar("path_relation", lambda: {"r": B.same_way(*_paths()), "code": B.path_code(_paths()[0])}, {"r": f"CASE WHEN ({_PB})[1:len({_PA})] = ({_PA}) THEN 1 WHEN ({_PA})[1:len({_PB})] = ({_PB}) THEN -1 ELSE 0 END", "code": "CASE WHEN seq % 2 = 1 THEN (8 + seq // 4 % 4) * 8 + seq % 4 ELSE 8 + seq // 4 % 4 END"})


@query("routing_keys", f"WITH {PTS}, {LG}, {SEG}, {SEGW}, {Q} SELECT 'segment' AS kind, seq AS id, CAST(tid % 16 AS INT) AS part FROM segw UNION ALL SELECT 'query', qid, CAST(qid % 16 AS INT) FROM q")
def routing_keys(spark, d):
    segs = _segments(spark, d)
    part = lambda c: F.pmod(F.col(c), F.lit(16)).cast("int").alias("part")
    return segs.select(F.lit("segment").alias("kind"), F.col("seq").alias("id"), part("tid")).unionByName(trajectories.range_queries(segs, P).select(F.lit("query").alias("kind"), F.col("qid").alias("id"), part("qid")))


@query("date_text", f"WITH {PTS} SELECT seq, strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S') AS day, strftime(make_timestamp(ts * 1000), '%I:%M') AS clock FROM pts")
def date_text(spark, d):
    return _points(spark, d).select("seq", B.date_text(F.col("ts")).alias("day"), B.date_text(F.col("ts"), "hh:mm").alias("clock"))


@query("parse_point_lines", f"WITH {PTS} SELECT seq, CAST(tid AS INT) AS tid, ts, x, y FROM pts")
def parse_point_lines(spark, d):
    """Points written as tab-separated lines and parsed again."""
    lines = _points(spark, d).select("seq", F.concat_ws("\t", *[F.col(c).cast("string") for c in ("tid", "ts", "x", "y")]).alias("value"))
    return S.parse_points(lines)


@query("parse_gps_lines", f"WITH {PTS} SELECT CAST(tid AS INT) AS tid, ts // 1000 * 1000 AS ts, count(*) AS n FROM pts WHERE seq % 5 <> 0 GROUP BY ALL")
def parse_gps_lines(spark, d):
    """Raw lines of both forms, seconds cut off; a fifth of them, without a longitude, is malformed and has x = 0."""
    when, lon, lat = B.date_text(F.col("ts")), (100.0 + F.col("x") / 1000.0).cast("string"), (F.col("y") / 100.0).cast("string")
    line = F.when(F.col("seq") % 5 == 0, F.concat_ws(",", "tid", when, lat)).when(F.col("seq") % 2 == 0, F.concat_ws(",", "tid", when, lon, lat)).otherwise(F.concat_ws("\t", "tid", F.substring(when, 1, 10), F.substring(when, 12, 8), lon, lat))
    return S.parse_gps(_points(spark, d).select(line.alias("value"))).where("x <> 0").groupBy("tid", "ts").agg(F.count("*").alias("n"))


@query("sample_scan", f"WITH {PTS}, lim AS (SELECT min(ts) + {L * W} AS e FROM pts) SELECT seq FROM pts, lim WHERE ts < e UNION ALL SELECT * FROM (SELECT seq FROM pts, lim WHERE ts >= e ORDER BY ts, seq LIMIT 1)")
def sample_scan(spark, d):
    pts = _points(spark, d)
    return S.sample_until(pts, pts.agg(F.min("ts")).first()[0] or 0, P.cycle_ms).select("seq")


_LISTS = f"WITH {PTS}, {LG}, {SEG}, {SEGW}, t AS (SELECT tid, list(win ORDER BY win) FILTER (seq % 2 = 0) AS a, list(win ORDER BY win) FILTER (seq % 2 = 1) AS b, min(win) AS lo, max(win) AS hi FROM segw GROUP BY tid)"


def _lists(spark, d):
    kept = lambda k: F.collect_list(F.when(F.col("seq") % 2 == k, F.col("win")))
    empty = lambda c: F.when(F.size(c) > 0, F.array_sort(c))
    out = _segments(spark, d).groupBy("tid").agg(kept(0).alias("a"), kept(1).alias("b"), F.min("win").alias("lo"), F.max("win").alias("hi"))
    return out.withColumns({"a": empty(F.col("a")), "b": empty(F.col("b"))})


@query("same_sets", f"{_LISTS} SELECT tid, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE list_sort(list_distinct(a)) = list_sort(list_distinct(b)) END AS sets, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE len(a) % 3 = len(b) % 3 END AS maps FROM t")
def same_sets(spark, d):
    """Whether even and odd segments of a trajectory fall into the same windows, and maps of one entry are equal."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.create_map(F.lit("n"), F.size(c) % 3))
    return _lists(spark, d).select("tid", K.same_set(F.col("a"), F.col("b")).alias("sets"), K.same_map(one("a"), one("b")).alias("maps"))


@query("sorted_lists", f"{_LISTS}, c AS (SELECT tid, coalesce(a, []) AS a, (lo + hi) // 2 AS m, lo FROM t) SELECT tid, len(list_filter(a, lambda e: e <= m)) AS kept, len(list_filter(a, lambda e: e > m)) AS gone, CAST(list_position(list_sort(list_append(a, m)), m) - 1 AS BIGINT) AS place, CAST(len(a) - CASE WHEN list_contains(a, lo) THEN 1 ELSE 0 END AS BIGINT) AS n_without, array_to_string(list_transform(a, lambda e: e // {W}), ',') AS panes FROM c")
def sorted_lists(spark, d):
    a, m = F.coalesce(F.col("a"), F.array().cast("array<bigint>")), F.expr("(lo + hi) div 2")
    t = _lists(spark, d).select("tid", a.alias("a"), m.alias("m"), "lo")
    a, m = F.col("a"), F.col("m")
    panes = F.array_join(K.map_elements(a, lambda e: F.floor(e / F.lit(W)).cast("string")), ",")
    return t.select("tid", F.size(K.up_to(a, m)).cast("long").alias("kept"), F.size(K.bigger(a, m)).cast("long").alias("gone"), K.place_of(K.sorted_add(a, m), m).alias("place"), F.size(K.sorted_remove(a, F.col("lo"))).cast("long").alias("n_without"), panes.alias("panes"))


@query("set_union_segments", f"WITH {PTS}, {LG}, {SEG}, {SEGW} SELECT DISTINCT tid, win FROM segw")
def set_union_segments(spark, d):
    s = _segments(spark, d)
    parts = [s.where(f"seq % 2 = {i}").select("tid", "win") for i in (0, 1)]
    return parts[0].unionByName(parts[1]).distinct()


_FAR = 1.5 * (_X1 - _X0)
_STR = f"""r AS (SELECT seq, x, y, row_number() OVER (ORDER BY y DESC, seq) - 1 AS k, count(*) OVER () AS n FROM pts),
  ln AS (SELECT *, (k >= CAST(floor(1 / 4 * n) AS BIGINT))::INT + (k >= CAST(floor(2 / 4 * n) AS BIGINT))::INT + (k >= CAST(floor(3 / 4 * n) AS BIGINT))::INT AS line FROM r),
  co AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY x, k) - 1 AS j, count(*) OVER (PARTITION BY line) AS m FROM ln),
  yc AS (SELECT i, y FROM range(1, 4) g(i) JOIN r ON k = CAST(floor(i / 4 * n) AS BIGINT)),
  xc AS (SELECT line, c, x FROM range(1, 4) g(c) JOIN co ON j = CAST(floor(c / 4 * m) AS BIGINT)),
  lay AS (SELECT CAST(l.l * 4 + c.c AS INT) AS leaf, coalesce(x0.x, CAST({_X0 - _FAR} AS DOUBLE)) AS lxlo, coalesce(y1.y, CAST({_Y0 - _FAR} AS DOUBLE)) AS lylo, coalesce(x1.x, CAST({_X1 + _FAR} AS DOUBLE)) AS lxhi, coalesce(y0.y, CAST({_Y1 + _FAR} AS DOUBLE)) AS lyhi
    FROM range(4) l(l) CROSS JOIN range(4) c(c) LEFT JOIN yc y0 ON y0.i = l.l LEFT JOIN yc y1 ON y1.i = l.l + 1
    LEFT JOIN xc x0 ON x0.line = l.l AND x0.c = c.c LEFT JOIN xc x1 ON x1.line = l.l AND x1.c = c.c + 1)"""


@query("str_layout", f"WITH {PTS}, {_STR} SELECT * FROM lay")
def str_layout(spark, d):
    return layouts.layout_table(spark, layouts.str_layout(_points(spark, d), P))


@query("assign_str", f"WITH {PTS}, {LG}, {SEG}, {_STR} SELECT leaf, count(*) AS n FROM seg JOIN lay ON {_MEETS} GROUP BY leaf")
def assign_str(spark, d):
    return joins.assign(_segments(spark, d), layouts.str_layout(_points(spark, d), P)).groupBy("leaf").agg(F.count("*").alias("n"))


@query("adaptive_layout")
def adaptive_layout(spark, d):
    rows = [(int(c), x.id, x.x0, x.y0, x.x1, x.y1, x.count) for c, leaves in layouts.fold_layouts(_density(spark, d), P).items() for x in leaves]
    return spark.createDataFrame(rows, "cycle long, leaf int, gx0 int, gy0 int, gx1 int, gy1 int, n long")


@query("migration_plan")
def migration_plan(spark, d):
    found = layouts.fold_layouts(_density(spark, d), P)
    cycles = sorted(found)
    old, new = (found[cycles[-3]], found[cycles[-1]]) if len(cycles) > 2 else (layouts.quadrants(P), layouts.quadrants(P))
    return layouts.migration(spark, layouts.to_boxes(old, P), layouts.to_boxes(new, P))
