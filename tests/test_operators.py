"""Columns and operators on fixtures small enough to compute by hand, or against plain Python."""

import difflib
import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.functions import columns as X
from gridweave.functions import special
from gridweave.operators import agreement, features, inference, plan, polygons, regimes, sequences, spatial, transit
from gridweave.plans import registry


def one(spark, column, ddl, *values):
    return spark.createDataFrame([values], ddl).select(column.alias("r")).first().r


def test_masked_counts(spark):
    df = spark.createDataFrame([("*",), ("",), (" 4 ",), ("7",), (None,)], "v string")
    assert [r.r for r in df.select(X.masked_number(F.col("v")).alias("r")).collect()] == [None, None, 4.0, 7.0, None]


def test_bins(spark):
    df = spark.createDataFrame([(h,) for h in range(24)], "h int").select(X.time_bin(F.col("h")).alias("b")).withColumn("r", X.bin_rank(F.col("b")))
    assert [r.r for r in df.collect()] == [0] * 6 + list(range(1, 19))
    with pytest.raises(Exception, match="unknown code"):
        one(spark, X.bin_rank(F.col("b")), "b string", "05")


def test_compositions(spark):
    p = [0.5, 0.5, 0.0, 0.0]
    got = one(spark, X.clr(F.col("p")), "p array<double>", p)
    d = C.ZERO_REPLACEMENT
    q = np.array([0.5 * (1 - 2 * d)] * 2 + [d] * 2)
    want = np.log(q / q.sum()) - np.log(q / q.sum()).mean()
    assert got == pytest.approx(want) and sum(got) == pytest.approx(0)
    assert one(spark, X.inverse_clr(F.col("p")), "p array<double>", got) == pytest.approx(q / q.sum())
    assert one(spark, X.arg_max(F.col("p")), "p array<double>", [1.0, 3.0, 3.0]) == 1
    assert one(spark, X.top_margin(F.col("p")), "p array<double>", [0.2, 0.5, 0.3]) == pytest.approx(0.2)
    assert one(spark, X.top_parts(["a", "b", "c", "d"], F.col("p")), "p array<double>", [0.1, 0.4, 0.1, 0.4]) == "b=0.40;d=0.40;a=0.10"
    assert one(spark, X.entropy(F.col("p"), 4), "p array<double>", [0.25] * 4) == pytest.approx(1)


@pytest.mark.parametrize(("name", "key"), [("서울역(1호선)", "서울"), ("역", "역"), (" 시청 ", "시청"), ("동대문 역사문화공원역", "동대문역사문화공원")])
def test_station_names(spark, name, key):
    assert one(spark, X.station_key(F.col("n")), "n string", name) == key


def test_projection(spark):
    x, y = X.korea_unified(F.col("lat"), F.col("lon"))
    df = spark.createDataFrame([(38.0, 127.5), (37.5665, 126.978), (35.0, 129.0)], "lat double, lon double").select(x.alias("x"), y.alias("y")).collect()
    assert (df[0].x, df[0].y) == pytest.approx((1e6, 2e6))
    # One degree of a meridian arc by numeric integration, and symmetry about the central meridian.
    a, e2 = 6378137.0, (1 / 298.257222101) * (2 - 1 / 298.257222101)
    phi = np.radians(np.linspace(37.0, 38.0, 20001))
    f = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = float(((f[1:] + f[:-1]) / 2 * np.diff(phi)).sum())
    p = spark.createDataFrame([(37.0, 127.5), (37.0, 126.5), (37.0, 128.5)], "lat double, lon double").select(x.alias("x"), y.alias("y")).collect()
    assert 2e6 - p[0].y == pytest.approx(0.9996 * arc, abs=1e-3)
    assert p[1].x + p[2].x == pytest.approx(2e6, abs=1e-3) and p[1].y == pytest.approx(p[2].y, abs=1e-3)


def test_tails():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.t_two_sided(0.0, 5) == pytest.approx(1)
    assert special.chi2_upper(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_upper(0.7107, 4) == pytest.approx(0.95, abs=1e-4)


def test_all_masked_dwell(spark):
    rows = [("c1", "2025-01-01", "07", c, None) for c in C.DWELL_CODES[:3]] + [("c2", "2025-01-01", "07", "000", 3.0), ("c2", "2025-01-01", "07", "240", 1.0)]
    got = {r.cell_id: r for r in features.dwell(spark.createDataFrame(rows, "cell_id string, date string, start_tz string, stay_dur string, total double")).collect()}
    assert got["c1"].dwell_share_000 is None and got["c1"].stay_vol_log is None and got["c1"].dwell_n_codes == 0 and got["c1"].dwell_heavy_masked
    assert (got["c2"].short_share, got["c2"].long_share, got["c2"].dwell_share_030) == (0.75, 0.25, 0.0) and got["c2"].stay_vol_log == pytest.approx(math.log(5))


def test_full_cycles(spark):
    rows = [("a", "d", b) for b in C.TIME_BINS] + [("b", "d", b) for b in C.TIME_BINS[:-1]]
    got = features.full_cycles(spark.createDataFrame(rows, "cell_id string, date string, time_bin string"))
    assert {r.cell_id for r in got.collect()} == {"a"} and got.count() == 19


def test_runs(spark):
    rows = [("s", i, x) for i, x in enumerate("AABBBA")]
    df = spark.createDataFrame(rows, "k string, t0 int, state string")
    r = sequences.runs(df, ["k"], "t0").orderBy("seg").collect()
    assert [(x.state, x.length, x.interior) for x in r] == [("A", 2, False), ("B", 3, True), ("A", 1, False)]
    assert sequences.coherence(df, ["k"], "t0").first().coherence == pytest.approx(3 / 5)


def test_agreement(spark):
    rng = random.Random(2)
    a = [rng.randrange(4) for _ in range(400)]
    df = spark.createDataFrame([(x, (x + 1) % 4, rng.randrange(4)) for x in a], "a int, renamed int, other int")
    assert agreement.adjusted_rand(df, "a", "renamed").first().ari == pytest.approx(1)
    assert agreement.normalized_mutual_information(df, "a", "renamed").first().nmi == pytest.approx(1)
    assert abs(agreement.adjusted_rand(df, "a", "other").first().ari) < 0.05


@pytest.mark.parametrize("shape", [(3, 3), (3, 5), (5, 5), (4, 4)])
def test_assignment(shape):
    rng = np.random.default_rng(shape[0] * 10 + shape[1])
    for _ in range(20):
        m = rng.integers(0, 9, shape)
        got = agreement.best_assignment(m)
        assert len(set(got.values())) == shape[0] and sum(m[i, j] for i, j in got.items()) == agreement.best_assignment_exhaustive(m)


def test_regressions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    x = np.column_stack([x, x.sum(1)])  # collinear
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, d double, y double")
    full = np.column_stack([np.ones(80), x])
    fit = full @ np.linalg.lstsq(full, y, rcond=None)[0]
    got = inference.multiple_r2(df, ["a", "b", "c", "d"], "y")
    assert got["r2"] == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-8)
    r = np.corrcoef(x[:, 0], y)[0, 1]
    assert inference.linear_regression(df, "a", "y").first().r == pytest.approx(r)
    assert 0 <= inference.regression_p(80, r) < 1e-6


def grid(spark, n, flag):
    return spark.createDataFrame([(f"c{i:02d}{j:02d}", i, j, *flag(i, j)) for i in range(n) for j in range(n)], "cell_id string, grid_ix int, grid_iy int, v double, kind string")


def test_moran(spark):
    half = grid(spark, 8, lambda i, j: (float(i < 4), "a" if i < 4 else "b"))
    e = spatial.queen_edges(half)
    rook = spatial.against_null(spatial.morans_i(half, e, "v", 39), "moran_i").first()
    assert rook.observed > 0.6 and rook.p == pytest.approx(1 / 40) and rook.n_replicates == 39
    assert spatial.same_category_share(half, e, "kind").first().same_share > 0.85
    line = grid(spark, 4, lambda i, j: (float((i + j) % 2), "x"))
    assert spatial.morans_i(line, spatial.queen_edges(line), "v").first().moran_i < 0


def test_isolates_count_in_the_mean(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 1, 2.0), ("c", 9, 9, 6.0)], "cell_id string, grid_ix int, grid_iy int, v double")
    z = np.array([1.0, 2.0, 6.0]) - 3
    assert spatial.morans_i(df, spatial.queen_edges(df), "v").first().moran_i == pytest.approx((z[0] * z[1] * 2) / (z @ z))
    assert spatial.degree_summary(df, spatial.queen_edges(df)).first().n_isolates == 1


def test_permutations_keep_the_values(spark):
    df = grid(spark, 4, lambda i, j: (float(4 * i + j), "x"))
    p = spatial.permuted(df, "v", 3).collect()
    by = {k: [r.v for r in sorted(p, key=lambda r: r.cell_id) if r.rep == k] for k in range(4)}
    assert by[0] == [float(x) for x in range(16)] and all(sorted(by[k]) == by[0] and by[k] != by[0] for k in (1, 2, 3))
    again = spatial.permuted(df.repartition(5), "v", 3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, p))


def test_a_shift_by_the_size_changes_nothing(spark):
    df = grid(spark, 6, lambda i, j: (0.0, "ab"[i // 3])).withColumn("unit", (F.col("grid_iy") / 2).cast("int"))
    same = spark.createDataFrame([(1, 6, -12)], "rep int, dx int, dy int")
    u = regimes.discordance(df, "unit", "kind").first()
    r = spatial.shift_purity(df, "unit", "kind", same).first()
    assert (r.overlap, r.mean_purity, r.mean_distinct) == (1.0, u.mean_purity, u.mean_distinct)


def test_connected_areas(spark):
    rng = random.Random(8)
    on = {(rng.randrange(14), rng.randrange(14)) for _ in range(75)}
    df = spark.createDataFrame([(f"c{i:02d}{j:02d}", i, j) for i, j in on], "cell_id string, grid_ix int, grid_iy int")
    seen, want = set(), []
    for s in sorted(on):
        if s not in seen:
            queue, own = deque([s]), []
            seen.add(s)
            while queue:
                a, b = queue.popleft()
                own.append((a, b))
                for n in ((a + x, b + y) for x in (-1, 0, 1) for y in (-1, 0, 1)):
                    if n in on and n not in seen:
                        seen.add(n)
                        queue.append(n)
            if len(own) >= 5:
                want += [(f"c{a:02d}{b:02d}", min(f"c{x:02d}{y:02d}" for x, y in own), len(own)) for a, b in own]
    assert sorted(map(tuple, spatial.connected_areas(df).collect())) == sorted(want)
    assert sorted(map(tuple, spatial.connected_areas(df, few=0).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["emergent_clusters", "hotspots"])
def test_areas_read_settled_cells(spark, sf, name):
    """The plan of the result holds what was settled, not the summary of all events once more for each time the cells are read."""
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "events.parquet" not in plan and "event_id" not in plan


def test_area_of_one_row_takes_few_plans(spark):
    """A long area, whose labels would take rounds, and cells without a neighbour."""
    df = spark.createDataFrame([(f"c{i:04d}", i, 0) for i in range(300)] + [("alone", 0, 9)], "cell_id string, grid_ix int, grid_iy int")
    rows = spatial.connected_areas(df, 1, most_rounds=0).collect()
    assert sorted(map(tuple, rows)) == [("alone", "alone", 1)] + [(f"c{i:04d}", "c0000", 300) for i in range(300)]


def test_polygons(spark):
    ring = lambda *p: [{"x": float(a), "y": float(b)} for a, b in (*p, p[0])]
    square, hole = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2))
    arrow = ring((10, 0), (14, 0), (14, 4), (12, 1), (10, 4))
    layer = spark.createDataFrame([(0, "s", [square, hole]), (1, "a", [arrow]), (2, "t", [square])], "ord int, label string, rings array<array<struct<x:double,y:double>>>")
    points = [("in", 3, 3), ("hole", 1.5, 1.5), ("edge", 4, 2), ("corner", 0, 0), ("out", 5, 5), ("notch", 12, 3), ("arm", 10.2, 3), ("level", 3, 1)]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in points], "k string, utm_x double, utm_y double")
    got = {r.k: (r.label, r.n_hits) for r in polygons.first_within(df, layer, "k", ["label"]).collect()}
    assert got == {"in": ("s", 2), "hole": ("t", 1), "edge": (None, 0), "corner": (None, 0), "out": (None, 0), "notch": (None, 0), "arm": ("a", 1), "level": ("s", 2)}


def test_scores(spark):
    rows = [("a", 8, 10.0, 2.0), ("a", 19, 1.0, 7.0), ("b", 12, 5.0, 5.0)]
    got = transit.commute_score(spark.createDataFrame(rows, "id string, hour int, board double, alight double"), ["id"]).collect()
    assert [(r.id, r.flow, r.res_score) for r in got] == [("a", 20.0, pytest.approx((17 - 3) / 20))]


@pytest.mark.parametrize("few", [100, 0])
def test_fuzzy(spark, monkeypatch, few):
    monkeypatch.setattr(transit, "FUZZY_KEYS", few)
    keys = ["신도림", "구로디지털단지", "가산디지털단지", "총신대입구", "서울대입구"]
    names = ["구로디지털단", "총신대입", "없는역이름", "신도림동"]
    got = {r.name: r.match for r in transit.fuzzy_matches(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(k,) for k in keys], "k string")).collect()}
    want = {n: m[0] for n in names if (m := difflib.get_close_matches(n, keys, 1, 0.8))}
    assert got == want and len(want) == 3


def test_geocoding(spark):
    x, y = X.korea_unified(F.lit(37.5665), F.lit(126.978))
    at = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    ix, iy = round((at.x - C.GRID_X0) / 250), round((at.y - C.GRID_Y0) / 250)
    cells = spark.createDataFrame([("c1", ix, iy)], "cell_id string, grid_ix int, grid_iy int")
    master = spark.createDataFrame([("시청역", 37.5665, 126.978), ("시청(2)", 37.5665, 126.978), ("먼곳", 35.0, 128.0)], "st_name string, lat double, lon double")
    names = spark.createDataFrame([("시청",), ("먼곳역",), ("없음",)], "station_name string")
    got = {r.station_name: r.cell_id for r in transit.geocode_stations(names, master, cells).collect()}
    assert got == {"시청": "c1", "먼곳": None} or got == {"시청": "c1", "먼곳역": None}
    stops = spark.createDataFrame([("1", "a"), ("2", "b")], "stop_id string, stop_name string")
    m2 = spark.createDataFrame([("1", 37.5665, 126.978)], "stop_id string, lat double, lon double")
    assert [r.cell_id for r in transit.geocode_stops(stops, m2, cells).collect()] == ["c1"]


def test_patches(spark):
    df = grid(spark, 6, lambda i, j: (0.0, "a" if i < 3 else "b")).withColumn("unit", F.concat(F.lit("u"), (F.col("grid_ix") / 2).cast("int").cast("string")))
    got = spatial.patch_purity(df, "unit", "kind", 10).orderBy("unit").collect()
    assert [(r.unit, r.purity, r.n_cells) for r in got] == [("u0", 1.0, 12), ("u1", 0.5, 12), ("u2", 1.0, 12)] and all(0.5 <= r.null_mean <= 1 for r in got)


def test_tiers(spark):
    df = spark.createDataFrame([("x", C.TIERS[0], 0.9, "activity_A"), ("x", C.TIERS[0], 0.8, "activity_B"), ("y", C.TIERS[1], 0.1, "residential"), (None, None, 0.7, "activity_A")], "centre string, tier string, activity_share double, dominant_functional string")
    got = {r.centre: (r.is_active, r.n_cells) for r in plan.centre_concordance(df).collect()}
    assert got == {"x": (True, 2), "y": (False, 1)}
    assert plan.active_not_planned(df).first().n_outside_any_center == 1


def test_older_system():
    from gridweave.functions import projection as P

    lat, lon = np.array([37.5, 38.0, 35.2]), np.array([127.1, 127.0 + 10.405 / 3600, 129.0])
    for tm in (P.UNIFIED, P.CENTRAL_1985):
        back = tm.inverse(*tm.forward(lat, lon))
        assert back[0] == pytest.approx(lat, abs=1e-10) and back[1] == pytest.approx(lon, abs=1e-10)
    assert P.CENTRAL_1985.forward(np.array([38.0]), np.array([127.0 + 10.405 / 3600])) == (pytest.approx([200_000]), pytest.approx([500_000]))
    near = P.change_datum(np.array([37.5]), np.array([127.0]))
    assert 0.002 < near[0][0] - 37.5 < 0.004 and -0.003 < near[1][0] - 127.0 < -0.001  # some 300 m north and 200 m west
    same = P.change_datum(np.array([37.5]), np.array([127.0]), P.GRS80, P.GRS80, (0,) * 7)
    assert same == (pytest.approx([37.5]), pytest.approx([127.0]))


def test_reprojected_rings(spark):
    from gridweave.functions import projection as P

    df = spark.createDataFrame([([[{"x": 200_000.0, "y": 450_000.0}, {"x": 201_000.0, "y": 450_000.0}]],)], "rings array<array<struct<x:double,y:double>>>")
    (a, b) = P.reproject_rings(df).first().rings[0]
    assert math.hypot(b.x - a.x, b.y - a.y) == pytest.approx(1000, rel=1e-3)


def test_stream(spark, tmp_path):
    from gridweave.streaming.presence import presence_stream

    rows = [("2025-01-01 00:10:00", "a", 4.0), ("2025-01-01 00:50:00", "a", 8.0), ("2025-01-01 01:05:00", "a", None), ("2025-01-01 09:00:00", "b", 1.0)]
    df = spark.createDataFrame(rows, "ts string, cell_id string, total_pop double").select(F.col("ts").cast("timestamp").alias("ts"), "cell_id", "total_pop")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = presence_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("presence").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select cell_id, mean_total_pop, n from presence order by hour_start").collect()
    assert [tuple(r) for r in got] == [("a", 6.0, 2), ("a", None, 0)]


def test_reports(spark):
    from gridweave.operators import report

    df = spark.createDataFrame([(C.TIERS[0], 2, 1, 50.0, 0.456)], "tier string, n_centers long, n_active long, pct_active double, mean_activity_share double")
    assert f"{C.TIERS[0]} & 2 & 1 & 50 & 0.46" in report.centre_table(df)
    s = spark.createDataFrame([("abs_0.3", 1844, 50.0, 100.0, None, 0.0, 25.0)], "def string, n_core_cells long, outside_pct double, tier0_active_pct double, tier1_active_pct double, tier2_active_pct double, tier3_active_pct double")
    assert r"abs 0.3 & 1{,}844 & 50.0 & 100 & -- & 0 & 25" in report.threshold_table(s)


def test_months_are_pruned(spark, tmp_path):
    from gridweave.sources import formats

    spark.createDataFrame([("202501", 1), ("202502", 2)], "year_month string, v int").write.partitionBy("year_month").parquet(str(tmp_path / "t"))
    one = formats.read_months(spark, str(tmp_path / "t"), ["202502", "209901"])
    assert [r.v for r in one.collect()] == [2] and len(one.inputFiles()) >= 1
    assert formats.read_months(spark, str(tmp_path / "t")).count() == 2
