"""The range query: micro fixtures, layouts, and every catalog query against DuckDB."""

from dataclasses import replace
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.functions import boxes as B
from driftgrid.operators import blocks, joins, layouts, trajectories
from driftgrid.params import FIXTURE, Params, read_properties
from driftgrid.plans import catalog, frames
from driftgrid.sources import points as S

SF = "/root/testdata/sf0.001"
POINTS = "seq long, tid int, ts long, x double, y double"
SMALL = Params(window_ms=10, logical_windows=8, ratio=3, radius=5.0, cell=20.0)


def _rows(df):
    return sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in (r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_catalog_matches_duckdb(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in (r[names.index(c)] for c in sorted(names))) for r in cur.fetchall())
    assert _rows(got) == want


def test_point_in_rect_answers_every_square(spark):
    """All squares, by brute force over the points; a query without points counts 0."""
    pts = np.array([(r.seq, r.x, r.y) for r in S.event_points(spark, SF).select("seq", "x", "y").collect()])
    want = {}
    for q in catalog.QUERIES["range_queries"](spark, SF).collect():
        inside = (q.qxlo - pts[:, 1] <= FIXTURE.eps) & (pts[:, 1] - q.qxhi <= FIXTURE.eps) & (q.qylo - pts[:, 2] <= FIXTURE.eps) & (pts[:, 2] - q.qyhi <= FIXTURE.eps)
        want[q.qid] = (int(inside.sum()), int(pts[inside, 0].sum()))
    got = {r.qid: (r.n_points, r.seq_sum) for r in catalog.QUERIES["point_in_rect"](spark, SF).collect()}
    assert got == want and sorted(got) == list(range(len(got))) and len(got) > 60


def test_verdicts_go_both_ways(spark):
    """The line test and the change of bounds are asked where the answer is not always the same."""
    rows = catalog.QUERIES["segment_exact_refine"](spark, SF).collect()
    assert {(r.meets, r.hit) for r in rows} == {(False, False), (True, False), (True, True)} and len(rows) > 300
    assert {(r.seq % 3 > 0, r.r) for r in catalog.QUERIES["rect_bounds_change"](spark, SF).collect()} == {(False, True), (True, True), (True, False)}


def test_pairing(spark):
    rows = [(0, 1, 0, 0.0, 0.0), (1, 2, 0, 50.0, 0.0), (2, 1, 5, 400.0, 0.0), (3, 1, 6, 800.0001, 0.0), (4, 1, 7, 800.0001 + 0.9e-5, 0.0), (5, 1, 4, 801.0, 0.0)]
    got = {r.seq: r for r in trajectories.segments(spark.createDataFrame(rows, POINTS), SMALL).collect()}
    assert sorted(got) == [2, 5]  # 400 stays, 400.0001 and the stationary move go, both still move the last point on
    assert (got[5].ts1, got[5].ts2, got[5].x1, got[5].x2) == (4, 7, 801.0, 800.0001 + 0.9e-5)


def test_sampler(spark):
    out = trajectories.sample(spark.createDataFrame([(i * 70_000,) for i in range(7)], "seq long"), 3)
    assert sorted((r.seq // 70_000, r.qid) for r in out.collect()) == [(0, 0), (3, 1), (6, 2)]


def test_window_band_and_edges(spark):
    segs = [(i, 0.0, 0.0, 1.0, 1.0, w) for i, w in enumerate((0, 10, 80, 90))] + [(9, 6.0 + 0.9e-5, 0.0, 7.0, 1.0, 80), (10, 6.0 + 1.2e-5, 0.0, 7.0, 1.0, 80)]
    s = spark.createDataFrame(segs, "seq long, xlo double, ylo double, xhi double, yhi double, win long")
    q = spark.createDataFrame([(0, 80, -4.0, -4.0, 6.0, 6.0)], "qid long, win long, qxlo double, qylo double, qxhi double, qyhi double")
    for f in (joins.range_pairs, joins.theta_pairs):
        assert sorted(r.seq for r in f(q, s, SMALL).collect()) == [1, 2, 9]


@pytest.mark.parametrize("frame", frames.FRAMES)
def test_frames_agree(spark, frame):
    pts = S.event_points(spark, SF)
    pairs = lambda f: sorted((r.qid, r.seq) for r in frames.pairs(f, pts, replace(FIXTURE, partitions=7)).select("qid", "seq").collect())
    assert pairs(frame) == pairs("theta")


def test_layouts_tile_the_grid():
    rng, p = np.random.default_rng(1), Params()
    layout = layouts.quadrants(p)
    for k in range(6):
        grid = rng.poisson(3 * np.exp(-np.arange(p.grid) / (5 + 20 * k)), (p.grid, p.grid)) if k % 3 else np.zeros((p.grid, p.grid), int)
        layout = layouts.adapt(layout, grid, p)
        seen = np.zeros((p.grid, p.grid), int)
        for x in layout:
            seen[x.x0 : x.x1 + 1, x.y0 : x.y1 + 1] += 1
        assert (seen == 1).all() and sum(x.count for x in layout) == grid.sum() and len(layout) <= p.partitions
        assert len({x.id for x in layout}) == len(layout) and all(0 <= x.id < p.partitions for x in layout)


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (4, 2), (2, 4), (5, 5), (1, 1), (6, 6)):
        cost = rng.integers(0, 20, (n, m))
        got = layouts.min_cost_assignment(cost)
        size = max(n, m)
        full = np.zeros((size, size), int)
        full[:n, :m] = cost
        assert sum(cost[i, j] for i, j in enumerate(got) if j >= 0) == min(sum(full[i, s[i]] for i in range(size)) for s in permutations(range(size)))


def test_parser(spark):
    lines = ["7\t2014-05-01\t00:00:07\t104.0\t30.0", "8,2014-05-01 00:00:08,105.5,31", "9,2014-05-01 00:00:09,x,31", "bad", "3,2014-05-01 00:00:09,300,31"]
    got = S.parse_gps(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (got[0].tid, got[0].x, round(got[0].y, 6), got[0].ts) == (7, 0.0, 0.0, 1398902407000)
    assert got[1].x > 100_000 and got[2].x == got[3].x == got[4].x == 0.0


def test_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("1\t5\t1.5\t2.5\n")
    assert [tuple(r) for r in S.read_points(spark, str(tmp_path / "p.tsv")).collect()] == [(1, 5, 1.5, 2.5)]
    S.split_round_robin(spark.createDataFrame([(i, str(i)) for i in range(5)], "seq long, value string"), 2, str(tmp_path / "s"))
    assert {r.value: r.part for r in spark.read.text(str(tmp_path / "s")).collect()} == {str(i): i % 2 for i in range(5)}
    got = read_properties(["# x", "radius = 7.5", "ratio=3", "other=1", "cell=250", "inactivity_ms=9", "eviction = exact"])
    assert (got.radius, got.ratio, got.cell, got.inactivity_ms, got.eviction) == (7.5, 3, 250.0, 9, "exact")


def test_streaming_equals_batch(spark, tmp_path):
    from driftgrid.streaming import continuous

    pts = S.event_points(spark, SF).withColumn("tid", F.col("tid").cast("long"))
    pts.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    continuous.answer(stream, str(tmp_path / "store"), str(tmp_path / "out"), FIXTURE, str(tmp_path / "cp")).awaitTermination()
    last = pts.agg(F.max("ts")).first()[0]
    want = {r.qid: r.n for r in frames.run("grid", pts, FIXTURE).where(F.col("win") < last - last % FIXTURE.window_ms).collect()}
    assert {r.qid: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want and want
    q = continuous.pair_stream(stream).writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("paired").count() == trajectories.pair_points(pts).where("ts0 IS NOT NULL").count()


def test_streaming_goes_on_after_a_restart(spark, tmp_path):
    from driftgrid.streaming import continuous

    pts = S.event_points(spark, SF).withColumn("tid", F.col("tid").cast("long"))
    cut = pts.agg(F.max("seq")).first()[0] // 2
    for part in (pts.where(F.col("seq") <= cut), pts.where(F.col("seq") > cut)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
        continuous.answer(stream, str(tmp_path / "store"), str(tmp_path / "out"), FIXTURE, str(tmp_path / "cp")).awaitTermination()
    last = pts.agg(F.max("ts")).first()[0]
    want = sorted((r.qid, r.n) for r in frames.run("grid", pts, FIXTURE).where(F.col("win") < last - last % FIXTURE.window_ms).collect())
    assert sorted((r.qid, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    assert spark.read.parquet(str(tmp_path / "out")).select("epoch").distinct().count() == 2


def _batches(spark, tmp_path, parts, p, **more):
    """Each part as a batch of its own; results by query, and the store's folders after each batch."""
    from driftgrid.streaming import continuous

    panes, folders = continuous.Panes(spark, str(tmp_path / "store")), []
    for epoch, part in enumerate(parts):
        continuous.take_batch(spark.createDataFrame(part, "seq long, tid long, ts long, x double, y double"), epoch, panes, str(tmp_path / "out"), p, **more)
        folders.append({(int(f.parent.name[6:]), int(f.name[4:])) for f in (tmp_path / "store/panes").glob("epoch=*/win=*")})
    return {r.qid: (r.win, sorted(s.seq for s in r.segments)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}, folders, panes


def test_stream_in_small_batches(spark, tmp_path):
    """Batches that cut windows and trajectories anywhere give the batch's answers; a repeated batch changes nothing; old panes go."""
    from driftgrid.streaming import continuous

    rng = np.random.default_rng(9)
    p = Params(window_ms=10, logical_windows=3, ratio=3, radius=5.0, cell=20.0)
    rows = [(i, int(rng.integers(0, 4)), int(i * 1.5), float(rng.uniform(0, 30)), float(rng.uniform(0, 30))) for i in range(120)]
    got, folders, panes = _batches(spark, tmp_path, [rows[a : a + 17] for a in range(0, 120, 17)], p)
    want = {r.qid: (r.win, sorted(s.seq for s in r.segments)) for r in frames.run("theta", spark.createDataFrame(rows, POINTS), p).collect()}
    edge = rows[-1][2] // 10 * 10
    assert got == {q: v for q, v in want.items() if v[0] < edge} and len(got) > 20
    assert all(min(w for _, w in f) >= max(w for _, w in f) - 3 * 10 - 30 for f in folders[2:]) and max(map(len, folders)) <= 14
    before = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("qid", "win", "n").collect())
    continuous.take_batch(spark.createDataFrame(rows[119:], "seq long, tid long, ts long, x double, y double"), 7, panes, str(tmp_path / "out"), p)
    assert before == sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("qid", "win", "n").collect())


def test_stream_late_rows(spark, tmp_path):
    """A late segment is left out of answered windows and counted; with lateness allowed it is there."""
    p = Params(window_ms=10, logical_windows=3, ratio=1, radius=50.0, cell=20.0)
    first = [(0, 1, 1, 0.0, 0.0), (1, 1, 5, 1.0, 1.0), (2, 2, 3, 0.0, 0.0), (3, 1, 25, 2.0, 2.0)]
    late = [(4, 2, 8, 5.0, 5.0), (5, 1, 41, 3.0, 3.0)]
    got, _, panes = _batches(spark, tmp_path / "a", [first, late], p)
    assert got == {0: (0, [1]), 1: (20, [1, 3])} and panes.mark(9).late == 1
    got, _, panes = _batches(spark, tmp_path / "b", [first, late], p, lateness_ms=20)
    assert got == {0: (0, [1, 4]), 2: (0, [1, 4])} and panes.mark(9).late == 0


def test_declarative_streams(spark, tmp_path):
    """Windows, windows of windows, and pairing that forgets idle trajectories."""
    from driftgrid.streaming import continuous

    rows = [(0, 1, 0, 0.0, 0.0), (1, 2, 100, 0.0, 0.0), (2, 1, 700_000, 1.0, 1.0), (3, 3, 9_000_000, 0.0, 0.0), (4, 1, 9_100_000, 2.0, 2.0), (5, 9, 90_000_000, 0.0, 0.0)]
    rows = [(seq, tid, 3_600_000 + ts, x, y) for seq, tid, ts, x, y in rows]  # a first watermark is zero
    schema = "seq long, tid long, ts long, x double, y double"

    def run(make, name):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / name))
        for k in range(0, 6, 2):
            spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            q = make(spark.readStream.schema(schema).parquet(str(tmp_path / name))).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        return spark.read.parquet(str(tmp_path / f"{name}-out")).collect()

    assert sorted(r.n_points for r in run(continuous.window_counts_stream, "counts")) == [1, 2, 2]
    totals = {int(r.window.start.timestamp()) // 3600: (r.n_windows, r.most) for r in run(continuous.window_totals_stream, "totals")}
    assert totals[1] == (2, 2)
    assert {r.seq for r in run(continuous.pair_stream, "all")} == {2, 4}
    assert {r.seq for r in run(lambda s: continuous.pair_stream(s, 3_600_000), "idle")} == {2}


def test_exact_eviction(spark):
    """Against the loop over all points: a trajectory is cut where a sweep came between, not at every gap."""
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for i in range(400):
        at += int(rng.exponential(400))
        rows.append((i, int(rng.integers(0, 12 + i // 20)), at, float(i), 0.0))
    known, swept, want = {}, 0, set()
    for seq, tid, ts, _, _ in rows:
        if tid in known:
            want.add(seq)
        elif ts - swept > 3000:
            known = {t: v for t, v in known.items() if ts - v <= 3000}
            swept = ts
        known[tid] = ts
    p = replace(SMALL, max_segment=1e9, inactivity_ms=3000, eviction="exact")
    got = {r.seq for r in trajectories.segments(spark.createDataFrame(rows, POINTS), p).collect()}
    gaps = {r.seq for r in trajectories.segments(spark.createDataFrame(rows, POINTS), replace(p, eviction="gap")).collect()}
    assert got == want and gaps < got


def test_schedule():
    """Which regions are made anew, and how a region is split by its items."""
    p = Params()
    grid = np.full((128, 128), 10)
    whole = layouts.Leaf(0, 0, 127, 127, 163840, ())
    for bound, n in ((100_000, 4), (60_000, 4), (25_000, 5), (10_000, 10)):
        leaves = layouts.grow(whole, grid, bound)
        assert sum(x.count for x in leaves) == 163840 and len(leaves) >= n - 1, bound
    assert layouts.grow(replace(whole, path=(1,)), grid, 80_000) == [replace(whole, path=(1,))]  # below 2.2 bounds
    four = layouts.split(whole, grid, (40960, 36864, 40960))
    assert [(x.x0, x.x1, x.y0, x.y1) for x in four] == [(0, 60, 0, 67), (0, 60, 68, 127), (61, 127, 0, 61), (61, 127, 62, 127)]
    leaf = lambda path, n: layouts.Leaf(0, 0, 1, 1, n, path)
    flat = [leaf((i,), 100) for i in range(4)]
    assert layouts.picks(flat, 100) == layouts.picks(flat, 500) == [] and layouts.picks([*flat[:3], leaf((3,), 300)], 100) == [()] and layouts.picks([*flat[:3], leaf((3,), 450)], 100) == [(3,)]
    deep = [*flat[:3], *(leaf((3, i), n) for i, n in enumerate((20, 30, 40, 60)))]
    assert layouts.picks(deep, 100) == [(3,)]  # too few each, right together
    assert layouts.picks([*flat[:3], *(leaf((3, i), n) for i, n in enumerate((20, 30, 40, 900)))], 100) == [(3,)]
    assert layouts.fullest(deep).path == (0,) and [x.count for x in layouts.by_count(deep)][:2] == [20, 30]
    skewed = np.zeros((128, 128), int)
    skewed[3, 3], skewed[5, 7] = 5000, 200  # all in two cells
    layout = layouts.adapt(layouts.quadrants(p), skewed, p)
    assert sum(x.count for x in layout) == 5200 and len(layout) <= p.partitions
    assert layouts.adapt(layout, np.zeros((128, 128), int), p) == [replace(x, count=0) for x in layout]


def test_layouts_of_cycles(spark):
    """Layouts follow the density of the cycle before; the plan of moves between two layouts against all pairs of leaves."""
    dens = catalog.QUERIES["density_cycle"](spark, SF)
    found = layouts.fold_layouts(dens, FIXTURE)
    cycles = sorted({r.cycle for r in dens.select("cycle").distinct().collect()})
    assert set(found) == set(cycles) | {c + 1 for c in cycles} and found[cycles[0]] == layouts.quadrants(FIXTURE)
    cells = {c: {(r.gx, r.gy): r.cnt for r in dens.where(F.col("cycle") == c).collect()} for c in cycles[:3]}
    for c in cycles[:3]:
        seen = np.zeros((128, 128), int)
        for x in found[c + 1]:
            seen[x.x0 : x.x1 + 1, x.y0 : x.y1 + 1] += 1
            assert x.count == sum(n for (gx, gy), n in cells[c].items() if x.x0 <= gx <= x.x1 and x.y0 <= gy <= x.y1)
        assert (seen == 1).all()
    old, new = layouts.to_boxes(found[cycles[2]], FIXTURE), layouts.to_boxes(found[cycles[-1] + 1], FIXTURE)
    meet = lambda a, b: a[1] < b[3] - 1e-6 and b[1] < a[3] - 1e-6 and a[2] < b[4] - 1e-6 and b[2] < a[4] - 1e-6
    plan = {r.leaf: ([o.to for o in r.out or []], list(r["from"] or []), r.region is None) for r in layouts.migration(spark, old, new).collect()}
    ids = {b[0] for b in old} | {b[0] for b in new}
    assert plan == {i: (sorted(b[0] for a in old if a[0] == i for b in new if b[0] != i and meet(a, b)), sorted(a[0] for b in new if b[0] == i for a in old if a[0] != i and meet(a, b)), all(b[0] != i for b in new)) for i in ids}


def test_sources_and_results(spark, tmp_path):
    lines = [f"{i}\t{i * 10}\t{i}.5\t{i}.25" for i in range(50)]
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/part{k}.txt").write_text("\n".join(lines[25 * k : 25 * k + 25]) + "\n")
    read = S.read_lines(spark, str(tmp_path / "in"))
    assert [r.value for r in read.orderBy("seq").collect()] == lines and read.select("seq").distinct().count() == 50
    pts = S.parse_points(read.unionByName(spark.createDataFrame([(-1, "x\t1\t2")], "seq long, value string")))
    assert {(r.tid, r.ts, r.x, r.y) for r in pts.collect()} == {(i, i * 10, i + 0.5, i + 0.25) for i in range(50)} | {(None, 1, 2.0, None)}
    queries = joins.stamp(catalog.QUERIES["range_queries"](spark, SF))
    segs = catalog.QUERIES["segments"](spark, SF)
    S.write_results(joins.merge(joins.range_pairs(queries, segs, FIXTURE), queries, FIXTURE), str(tmp_path / "res"))
    S.write_results(S.read_results(spark, str(tmp_path / "res")), str(tmp_path / "res2"))
    back = joins.latency(S.read_results(spark, str(tmp_path / "res2")))
    assert back.count() == queries.count() and back.where("latency_ms < 0 OR input_time IS NULL").count() == 0
    halves = [back.select("qid", (F.col("input_time") + k).alias("input_time"), F.expr(f"filter(segments, s -> s.seq % 3 <> {k})").alias("segments")) for k in range(2)]
    whole = joins.merge_parts(halves[0].unionByName(halves[1]))
    assert {(r.qid, r.input_time, len(r.segments)) for r in whole.collect()} == {(r.qid, r.input_time, r.n) for r in back.collect()}
    text = spark.readStream.text(str(tmp_path / "in"))
    q = S.console(text).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and q.lastProgress["sink"]["description"].lower().startswith("org.apache.spark.sql.execution.streaming.console")


def _shuffled(df):
    """Bytes that a result's exchanges have moved, by what they are dealt out by."""
    moved, plans = {}, [df._jdf.queryExecution().executedPlan()]
    df._jdf.queryExecution().toRdd().count()
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        if kind == "ShuffleExchangeExec":
            moved[plan.outputPartitioning().toString()] = plan.metrics().apply("dataSize").value()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return moved


def _crowd(spark, n=600):
    """Points of few trajectories in little space and time, low and negative: most queries see most segments."""
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 9)), int(i // 4), float(rng.uniform(-12, 25)), float(rng.uniform(-12, 25))) for i in range(n)]
    return spark.createDataFrame(rows, POINTS)


def test_merged_pairs_stay_in_their_tasks(spark):
    """what is moved to merge the hits follows the segments, not the pairs."""
    p = replace(SMALL, ratio=1, radius=20.0, window_ms=20)
    segs, queries = frames.prepare(_crowd(spark), p)
    out = frames.run("grid", _crowd(spark), p)
    moved, pairs = _shuffled(out), sum(r.n for r in out.collect())
    assert pairs > 40 * segs.count() and moved and max(moved.values()) < 10 * pairs, moved  # a pair has 8 bytes at least, a hit's row 64


@pytest.mark.parametrize("cell", (None, 1.0, 300.0))
def test_blocks_merge_like_pairs(spark, cell):
    """Blocks of many tiles and cycles, or of one; queries that see nothing; lists with all columns."""
    p = replace(SMALL, cell=cell, logical_windows=3)
    pts = _crowd(spark)
    segs, queries = frames.prepare(pts, p)
    queries = queries.unionByName(queries.where("qid < 3").withColumns({"qid": F.col("qid") + 10_000, "win": F.col("win") + 10**6})).unionByName(queries.where("qid < 3").withColumns({"qid": F.col("qid") + 20_000, "qxlo": F.col("qxlo") - 1e4, "qxhi": F.col("qxhi") - 1e4}))
    for empty in (True, False):
        q = replace(p, emit_empty=empty)
        got, want = blocks.answers(queries, segs, q), joins.merge(joins.theta_pairs(queries.drop("ts"), segs, q).select("qid", *blocks.HIT), queries, q)
        assert got.schema["segments"].dataType.simpleString() == want.schema["segments"].dataType.simpleString()
        rows = lambda d: {r.qid: (r.win, r.n, r.segments) for r in d.collect()}
        assert rows(got) == rows(want) and got.count() == len(rows(got)) and (20_000 in rows(got)) == empty
        assert {r.qid: (r.win, r.n, r.seqs) for r in blocks.texts(queries, segs, q).collect()} == {k: (w, n, ",".join(str(s.seq) for s in x)) for k, (w, n, x) in rows(want).items()}
    inside = joins.range_pairs(queries, segs, p, inside=True).groupBy("qid").count()
    assert {r.qid: r.n for r in blocks.answers(queries, segs, replace(p, emit_empty=False), inside=True).collect()} == {r.qid: r["count"] for r in inside.collect()}


def test_differences_stay_in_their_tasks(spark):
    """what two frames find differently, against the pairs of both; what is moved follows the segments, not the pairs."""
    p = replace(SMALL, ratio=1, radius=20.0, window_ms=20)
    segs, queries = frames.prepare(_crowd(spark), p)
    layout = frames.str_leaves(_crowd(spark), p)
    even = F.col("seq") % 2 == 0
    out = blocks.differences(queries, segs, p, blocks.Side(layout, of=even), blocks.Side(inside=True))
    moved, got = _shuffled(out), out.collect()
    assert len(got) > 20 * segs.count() and moved and max(moved.values()) < 10 * len(got), moved
    want = trajectories.result_diff(joins.leaf_pairs(queries, segs.where(even), layout, p), joins.range_pairs(queries, segs, p, inside=True))
    assert sorted(map(tuple, got)) == sorted((r.qid, r.seq, r.side) for r in want.collect()) and {r.side for r in got} == {"left", "right"}
    small = replace(p, cell=1.0, radius=3.0)
    segs, queries = frames.prepare(_crowd(spark, 200), small)
    assert blocks.differences(queries, segs, small, blocks.Side(layout), blocks.Side()).count() == 0
