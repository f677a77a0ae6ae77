"""Queries over the grid, polygons, plans and transit."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.operators import plan, polygons, regimes, spatial, transit
from gridweave.plans.features import rounded
from gridweave.plans.regimes import TABLE_SQL, _SH, _six, _table, t_tail_sql
from gridweave.session import ensure_checkpoint_dir
from gridweave.sources import domain as D

SHIFTS, PERMS, RELABELS = 150, 999, 200


def _planned(spark, sf):
    """Cells with their regimes and the first centre that holds their middle."""
    t = _table(spark, sf)
    hit = polygons.first_within(t, D.centres(spark, sf), "cell_id", ["label", "tier"])
    return hit.withColumnsRenamed({"label": "centre"})


PLAN_SQL = f"""{TABLE_SQL}, {D.centres_sql()}, hits as (select cell_id, label, tier, ord, row_number() over (partition by cell_id order by ord) as r, count(*) over (partition by cell_id) as n_hits from cells join centres on utm_x > x0 and utm_x < x1 and utm_y > y0 and utm_y < y1),
pl as (select cells.*, label as centre, tier, coalesce(n_hits, 0) as n_hits from cells left join hits on cells.cell_id = hits.cell_id and r = 1)"""
ACT = "dominant_functional in ('activity_A', 'activity_B')"


def queen_edges(spark, sf):
    return spatial.queen_edges(D.cell_units(spark, sf))


def degree_summary(spark, sf):
    u = D.cell_units(spark, sf)
    return rounded(spatial.degree_summary(u, spatial.queen_edges(u)))


def kring_mean(spark, sf):
    t = _table(spark, sf)
    p = t.select(F.col("cell_id").alias("point"), "grid_ix", "grid_iy")
    return rounded(spatial.ring_mean(p, t, 1, ["activity_share", "share_residential"], "dominant_functional"))


def moran_observed(spark, sf):
    t = _table(spark, sf)
    return rounded(spatial.morans(t, spatial.queen_edges(t), ["share_residential", "activity_share", "func_entropy", "dom_margin"]))


def moran_null(spark, sf):
    t = _table(spark, sf)
    return rounded(spatial.against_null(spatial.morans_i(t, spatial.queen_edges(t), "activity_share", PERMS), "moran_i"))


def join_count_observed(spark, sf):
    t = _table(spark, sf)
    return rounded(spatial.same_category_share(t, spatial.queen_edges(t), "dominant_functional"))


def join_count_null(spark, sf):
    t = _table(spark, sf)
    return rounded(spatial.against_null(spatial.same_category_share(t, spatial.queen_edges(t), "dominant_functional", PERMS), "same_share"))


def relabel_null(spark, sf):
    return rounded(spatial.relabel_purity(_table(spark, sf), "admin_dong", "dominant_functional", RELABELS))


def _moves(spark):
    return spark.range(1, SHIFTS + 1).select(F.col("id").cast("int").alias("rep"), (6 + F.col("id") * 7 % 24).cast("int").alias("dx"), (-6 - F.col("id") * 11 % 24).cast("int").alias("dy"))


def toroidal_purity(spark, sf):
    return rounded(spatial.shift_purity(_table(spark, sf), "admin_dong", "dominant_functional", _moves(spark)))


def patch_null(spark, sf):
    return rounded(spatial.patch_purity(_table(spark, sf), "admin_dong", "dominant_functional"))


def point_in_polygon(spark, sf):
    return _planned(spark, sf).select("cell_id", "centre", "tier", "n_hits")


def place_members(spark, sf):
    return polygons.join_within(D.cell_units(spark, sf), D.centres(spark, sf)).select("cell_id", "label", "tier")


def layer_overlay(spark, sf):
    c = D.centres(spark, sf)
    return polygons.overlay_ok(c.where(F.col("tier") == C.TIERS[0]), c)


def center_concordance(spark, sf):
    return rounded(plan.centre_concordance(_planned(spark, sf)))


def tier_concordance(spark, sf):
    return rounded(plan.tier_concordance(plan.centre_concordance(_planned(spark, sf))))


def planned_not_active(spark, sf):
    return rounded(plan.planned_not_active(plan.centre_concordance(_planned(spark, sf))).select("centre", "tier", "n_cells", "mean_act", "frac_act_dom"))


def active_not_planned(spark, sf):
    return rounded(plan.active_not_planned(_planned(spark, sf)))


def threshold_sensitivity(spark, sf):
    return rounded(plan.threshold_sensitivity(_planned(spark, sf), (0.38, 0.4, 0.42, 0.44)))


def emergent_units(spark, sf):
    return plan.top_units(plan.emergent(_planned(spark, sf)), F.substring("admin_dong", 1, 5))


def _members(spark, sf):
    t = _planned(spark, sf).drop("tier")
    m = polygons.join_within(t, D.centres(spark, sf).withColumnsRenamed({"label": "place", "tier": "category"}))
    return m


def category_composition(spark, sf):
    return rounded(plan.category_composition(_members(spark, sf), "category", [*C.REGIMES, C.STRUCTURAL]))


def category_metrics(spark, sf):
    return rounded(plan.category_metrics(_members(spark, sf), "category"))


def emergent_overlap(spark, sf):
    return rounded(plan.overlap(plan.emergent(_planned(spark, sf)), _members(spark, sf).where(F.col("category").isin(C.TIERS[:2]))))


def planning_gaps(spark, sf):
    outside = _members(spark, sf).withColumn("centre", F.when(F.col("place") < "Supplier#000000004", F.col("centre")))
    return rounded(plan.planning_gaps(outside))


MEM_SQL = f"{PLAN_SQL}, mem as (select pl.* exclude (tier), centres.label as place, centres.tier as category from pl join centres on utm_x > x0 and utm_x < x1 and utm_y > y0 and utm_y < y1)"


def _flagged(spark, sf):
    return _table(spark, sf).where("activity_share >= 0.4")


def components(spark, sf):
    return spatial.connected_areas(_flagged(spark, sf).select("cell_id", "grid_ix", "grid_iy"), 2)


def _settled_plan(spark, sf):
    """What areas need of the cells, written once: they read it five times, and each plan would hold the summary of all events as often."""
    ensure_checkpoint_dir(spark)
    return _planned(spark, sf).select("cell_id", "grid_ix", "grid_iy", "admin_dong", "activity_share", "centre", "tier").checkpoint()


def emergent_clusters(spark, sf):
    p = _settled_plan(spark, sf)
    areas = spatial.connected_areas(p.where("activity_share >= 0.4 and centre is null").select("cell_id", "grid_ix", "grid_iy"), 2)
    centres = p.where("centre is not null").select("cell_id", "centre", "tier")
    return rounded(spatial.area_attributes(areas.select("cell_id", "area"), p.select("cell_id", "grid_ix", "grid_iy", "admin_dong", "activity_share"), centres))


def commute_score(spark, sf):
    return rounded(transit.commute_score(D.ridership(spark, sf), ["stop_id"]))


def _stops(spark, sf):
    s = transit.commute_score(D.ridership(spark, sf), ["stop_id", "place"])
    ix, iy = (F.col("place") * 3 % 10).cast("int"), (F.floor(F.col("place") / 10) + F.col("place") * 7 % 9).cast("int")
    return s.withColumns({"utm_x": C.GRID_X0 + C.GRID_STEP * ix + 40.0, "utm_y": C.GRID_Y0 + C.GRID_STEP * iy - 60.0})


def weighted_cell_score(spark, sf):
    at = transit.snap_to_cells(_stops(spark, sf), D.cell_units(spark, sf)).where("cell_id is not null")
    return rounded(transit.weighted_cell_score(at))


def typology_crosstab(spark, sf):
    at = transit.snap_to_cells(_stops(spark, sf), D.cell_units(spark, sf)).where("cell_id is not null")
    pts = at.select(F.col("stop_id").alias("point"), "grid_ix", "grid_iy", "res_score")
    ring = spatial.ring_mean(pts, _table(spark, sf), 1, ["activity_share"], "dominant_functional")
    t = pts.join(ring, "point").select(transit.station_type(F.col("res_score")).alias("station_type"), transit.cell_group(F.col("modal")).alias("cell_group"))
    w = t.groupBy("station_type").pivot("cell_group", ["residential", "activity", "other"]).agg(F.count(F.lit(1)))
    return w.select("station_type", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("residential", "activity", "other")))


def density_control(spark, sf):
    at = transit.snap_to_cells(_stops(spark, sf), D.cell_units(spark, sf)).where("cell_id is not null")
    pts = at.select(F.col("stop_id").alias("point"), "grid_ix", "grid_iy")
    cells = D.cell_units(spark, sf).withColumn("density", F.abs("density"))
    r = spatial.ring_mean(pts, cells, 1, ["density"])
    return rounded(r.select("point", F.log1p("mean_density").alias("log_density")))


def validation_chain(spark, sf):
    """Stops' commute scores against the activity of the cells around them: a regression for each radius of the catchment."""
    at = transit.snap_to_cells(_stops(spark, sf), D.cell_units(spark, sf)).where("cell_id is not null")
    return rounded(transit.catchment_regressions(at, _table(spark, sf), "share_residential"))


QUERIES = {
    f.__name__: f
    for f in (queen_edges, degree_summary, kring_mean, moran_observed, moran_null, join_count_observed, join_count_null, relabel_null, toroidal_purity, patch_null, point_in_polygon, place_members, layer_overlay, center_concordance, tier_concordance, planned_not_active, active_not_planned, threshold_sensitivity, emergent_units, category_composition, category_metrics, emergent_overlap, planning_gaps, components, emergent_clusters, commute_score, weighted_cell_score, typology_crosstab, density_control, validation_chain)
}
_E = "e as (select a.cell_id as src, b.cell_id as dst from cells a join cells b on abs(a.grid_ix - b.grid_ix) <= 1 and abs(a.grid_iy - b.grid_iy) <= 1 and a.cell_id <> b.cell_id)"
_STOP = f"""{D.ridership_sql()}, sc0 as (select stop_id, place, {', '.join(f"coalesce(sum({c}) filter (hour in {h}), 0) as {n}" for n, c, h in (('amb', 'board', '(7, 8, 9)'), ('ama', 'alight', '(7, 8, 9)'), ('pmb', 'board', '(18, 19, 20)'), ('pma', 'alight', '(18, 19, 20)')))} from rides group by all),
sc as (select *, amb + ama + pmb + pma as flow, ((amb + pma) - (ama + pmb)) / (amb + ama + pmb + pma) as res_score, cast(place * 3 % 10 as int) as grid_ix, cast(place // 10 + place * 7 % 9 as int) as grid_iy from sc0 where amb + ama + pmb + pma > 0)"""
_DEF = {**{f"abs_{t:g}": (f"activity_share >= {t}", f"{t}") for t in (0.38, 0.4, 0.42, 0.44)}, "city_mean": ("activity_share >= m", "m"), "top_quartile": ("activity_share >= q75", "null"), "top_decile": ("activity_share >= q90", "null"), "dominant_activity": (ACT, "null")}
_COMP = """reach as (select f.cell_id, f.cell_id as root, 0 as d from f union select ff.dst, r.root, 0 from reach r join ff on ff.src = r.cell_id), lab as (select cell_id, min(root) as area from reach group by cell_id)"""
_AREA = """ar as (select *, count(*) over (partition by area) as n_cells from lab)"""
SQL = {
    "queen_edges": f"with {D.units_sql()}, cells as (select * from units), {_E} select src, dst from e",
    "degree_summary": f"with {D.units_sql()}, cells as (select * from units), {_E}, d as (select cells.cell_id, count(e.dst) as d from cells left join e on src = cells.cell_id group by all) select count(*) as n_cells, cast(sum(d) / 2 as bigint) as n_edges, round(avg(d), 6) as mean_degree, count(*) filter (d = 0) as n_isolates from d",
    "kring_mean": f"with {TABLE_SQL}, w as (select p.cell_id as point, c.* from cells p join cells c on abs(p.grid_ix - c.grid_ix) <= 1 and abs(p.grid_iy - c.grid_iy) <= 1), mo as (select point, dominant_functional as d, count(*) as n from w group by all), m1 as (select point, (list(d order by n desc, d))[1] as modal from mo group by point) select w.point, count(*) as n_cells, round(avg(activity_share), 6) as mean_activity_share, round(avg(share_residential), 6) as mean_share_residential, any_value(modal) as modal from w join m1 on w.point = m1.point group by w.point",
    "moran_observed": f"with {TABLE_SQL}, {_E} " + " union all ".join(f"select '{c}' as measure, round(sum(z * coalesce(lag, 0)) / sum(z * z), 6) as moran_i from (select cell_id, {c} - (select avg({c}) from cells) as z from cells) x left join (select src, avg({c}) - (select avg({c}) from cells) as lag from e join cells on dst = cell_id group by src) l on src = cell_id" for c in ("share_residential", "activity_share", "func_entropy", "dom_margin")),
    "join_count_observed": f"with {TABLE_SQL}, {_E} select 0 as rep, round(avg(case when a.dominant_functional = b.dominant_functional then 1 else 0 end), 6) as same_share from e join cells a on src = a.cell_id join cells b on dst = b.cell_id where src < dst",
    "moran_null": f"with {TABLE_SQL}, {_E}, pp as (select rep, cell_id, row_number() over (partition by rep order by cell_id) as p from cells, range(0, {PERMS + 1}) x(rep)), dd as (select rep, activity_share - (select avg(activity_share) from cells) as v, row_number() over (partition by rep order by case when rep > 0 then md5(rep || '|' || cell_id || '|{C.SEED}') end, cell_id) as p from cells, range(0, {PERMS + 1}) x(rep)), pm as (select pp.rep, cell_id, v from pp join dd on pp.rep = dd.rep and pp.p = dd.p), lg as (select rep, src as cell_id, avg(v) as lag from e join pm on dst = cell_id group by all), st as (select pm.rep, sum(v * coalesce(lag, 0)) / sum(v * v) as s from pm left join lg on pm.rep = lg.rep and pm.cell_id = lg.cell_id group by pm.rep), n0 as (select max(s) filter (rep = 0) as ob, avg(s) filter (rep > 0) as mu, stddev_pop(s) filter (rep > 0) as sd, count(*) filter (rep > 0) as nr from st), k as (select count(*) as k from st, n0 where rep > 0 and s >= ob) select round(ob, 6) as observed, round(mu, 6) as null_mean, round(sd, 6) as null_std, round((ob - mu) / (sd + 1e-12), 6) as z, round((k + 1) / (nr + 1), 6) as p, nr as n_replicates from n0, k",
    "join_count_null": f"with {TABLE_SQL}, {_E}, pp as (select rep, cell_id, row_number() over (partition by rep order by cell_id) as p from cells, range(0, {PERMS + 1}) x(rep)), dd as (select rep, dominant_functional as v, row_number() over (partition by rep order by case when rep > 0 then md5(rep || '|' || cell_id || '|{C.SEED}') end, cell_id) as p from cells, range(0, {PERMS + 1}) x(rep)), pm as (select pp.rep, cell_id, v from pp join dd on pp.rep = dd.rep and pp.p = dd.p), st as (select a.rep, avg(case when a.v = b.v then 1 else 0 end) as s from e join pm a on src = a.cell_id join pm b on dst = b.cell_id and a.rep = b.rep where src < dst group by a.rep), n0 as (select max(s) filter (rep = 0) as ob, avg(s) filter (rep > 0) as mu, stddev_pop(s) filter (rep > 0) as sd, count(*) filter (rep > 0) as nr from st), k as (select count(*) as k from st, n0 where rep > 0 and s >= ob) select round(ob, 6) as observed, round(mu, 6) as null_mean, round(sd, 6) as null_std, round((ob - mu) / (sd + 1e-12), 6) as z, round((k + 1) / (nr + 1), 6) as p, nr as n_replicates from n0, k",
    "relabel_null": f"with {TABLE_SQL}, pp as (select rep, cell_id, row_number() over (partition by rep order by cell_id) as p from cells, range(0, {RELABELS + 1}) x(rep)), dd as (select rep, dominant_functional as v, row_number() over (partition by rep order by case when rep > 0 then md5(rep || '|' || cell_id || '|{C.SEED}') end, cell_id) as p from cells, range(0, {RELABELS + 1}) x(rep)), pm as (select pp.rep, cell_id, v from pp join dd on pp.rep = dd.rep and pp.p = dd.p), n as (select rep, admin_dong, v, count(*) as n from pm join cells on pm.cell_id = cells.cell_id where v <> 'none' and admin_dong is not null group by all), u as (select rep, admin_dong, count(*) as nd, max(n) / sum(n) as p from n group by all) select cast(rep as int) as rep, round(avg(nd), 6) as mean_distinct, round(avg(p), 6) as mean_purity from u group by rep",
    "toroidal_purity": f"""with {TABLE_SQL}, box as (select max(grid_ix) + 1 as nx, max(grid_iy) + 1 as ny, count(*) as n_all from cells), mv as (select cast(i as int) as rep, 6 + i * 7 % 24 as dx, -6 - i * 11 % 24 as dy from range(1, {SHIFTS + 1}) r(i)),
s as (select rep, ((grid_ix + dx) % nx + nx) % nx as ix, ((grid_iy + dy) % ny + ny) % ny as iy, dominant_functional as c from cells, box, mv), j as (select rep, admin_dong, c, n_all from s join cells on ix = grid_ix and iy = grid_iy, box),
ok as (select rep, count(*) / max(n_all) as overlap from j group by rep having count(*) / max(n_all) >= 0.3), n as (select rep, admin_dong, c, count(*) as n from j where c <> 'none' group by all), u as (select rep, admin_dong, count(*) as nd, max(n) / sum(n) as p from n group by all)
select u.rep, round(max(overlap), 6) as overlap, round(avg(nd), 6) as mean_distinct, round(avg(p), 6) as mean_purity from u join ok on u.rep = ok.rep group by u.rep""",
    "point_in_polygon": f"with {PLAN_SQL} select cell_id, centre, tier, n_hits from pl",
    "place_members": f"with {D.units_sql()}, {D.centres_sql()} select cell_id, label, tier from units join centres on utm_x > x0 and utm_x < x1 and utm_y > y0 and utm_y < y1",
    "layer_overlay": f"with {D.centres_sql()}, a as (select min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from centres where tier = {C.TIERS[0]!r}), b as (select min(x0) as a0, min(y0) as b0, max(x1) as a1, max(y1) as b1 from centres) select x0, y0, x1, y1, x0 > a0 - 5000 and x1 < a1 + 5000 and y0 > b0 - 5000 and y1 < b1 + 5000 as overlay_ok from a, b",
    "center_concordance": f"with {PLAN_SQL}, c as (select centre, tier, avg(activity_share) as mean_act, count(*) as n_cells, avg(case when {ACT} then 1 else 0 end) as f from pl where centre is not null group by all) select centre, tier, round(mean_act, 6) as mean_act, n_cells, round(f, 6) as frac_act_dom, f > 0.5 as is_active, mean_act > (select avg(activity_share) from pl) as above_city_mean from c",
    "tier_concordance": f"with {PLAN_SQL}, c as (select centre, tier, avg(activity_share) as ma, avg(case when {ACT} then 1 else 0 end) as f from pl where centre is not null group by all), d as (select *, f > 0.5 as ia, ma > (select avg(activity_share) from pl) as ac from c) select tier, count(*) as n_centers, count(*) filter (ia) as n_active, round(100.0 * avg(case when ia then 1 else 0 end), 6) as pct_active, round(avg(ma), 6) as mean_activity_share, round(avg(f), 6) as mean_frac_act_dom, count(*) filter (ac) as n_above_city_mean, round(100.0 * avg(case when ac then 1 else 0 end), 6) as pct_above_city_mean from d group by tier",
    "planned_not_active": f"with {PLAN_SQL} select centre, tier, count(*) as n_cells, round(avg(activity_share), 6) as mean_act, round(avg(case when {ACT} then 1 else 0 end), 6) as frac_act_dom from pl where centre is not null group by all having not avg(case when {ACT} then 1 else 0 end) > 0.5",
    "active_not_planned": f"with {PLAN_SQL} select count(*) as n_activity_dom_cells, count(*) filter (centre is null) as n_outside_any_center, round(100.0 * avg(case when centre is null then 1 else 0 end), 6) as pct_outside from pl where {ACT}",
    "threshold_sensitivity": f"with {PLAN_SQL}, st as (select avg(activity_share) as m, quantile_cont(activity_share, 0.75) as q75, quantile_cont(activity_share, 0.9) as q90 from pl), r as ({' union all '.join(f'select {n!r} as def, centre, tier, activity_share, {c} as core, cast({t} as double) as thr from pl, st' for n, (c, t) in _DEF.items())}), co as (select def, count(*) filter (core) as n_core_cells, round(100.0 * count(*) filter (core and centre is null) / nullif(count(*) filter (core), 0), 6) as outside_pct from r group by def), p as (select def, centre, tier, case when max(thr) is not null then avg(activity_share) >= max(thr) else avg(case when core then 1 else 0 end) > 0.5 end as a from r where centre is not null group by all) select co.def, any_value(n_core_cells) as n_core_cells, any_value(outside_pct) as outside_pct, {', '.join(f'round(avg(case when a then 100.0 else 0.0 end) filter (tier = {t!r}), 6) as tier{i}_active_pct' for i, t in enumerate(C.TIERS))} from co left join p on co.def = p.def group by co.def",
    "emergent_units": f"with {PLAN_SQL} select substr(admin_dong, 1, 5) as unit, count(*) as n from pl where {ACT} and centre is null group by 1 order by n desc, unit limit 15",
    "category_composition": f"with {MEM_SQL} select category, {', '.join(f'round(count(*) filter (dominant_functional = {r!r}) / count(*), 6) as share_of_{r}' for r in [*C.REGIMES, C.STRUCTURAL])} from mem group by category",
    "category_metrics": f"with {MEM_SQL} select category, count(distinct place) as n_places, count(distinct cell_id) as n_cells, round(avg(activity_share), 6) as mean_activity_share, round(avg(share_residential), 6) as mean_residential_share, round(100.0 * avg(case when {ACT} then 1 else 0 end), 6) as pct_dom_activity, round(100.0 * avg(case when dominant_functional = 'residential' then 1 else 0 end), 6) as pct_dom_residential from mem group by category",
    "emergent_overlap": f"with {MEM_SQL}, a as (select distinct cell_id from pl where {ACT} and centre is null), b as (select distinct cell_id from mem where category in ({', '.join(map(repr, C.TIERS[:2]))})) select count(*) as n, count(b.cell_id) as n_in, round(100.0 * count(b.cell_id) / count(*), 6) as pct_in from a left join b on a.cell_id = b.cell_id",
    "planning_gaps": f"with {MEM_SQL} select place, count(*) as n_cells, round(avg(case when place < 'Supplier#000000004' and centre is not null then 1 else 0 end), 6) as frac_in_centre, round(avg(activity_share), 6) as mean_act, round(avg(case when {ACT} then 1 else 0 end), 6) as frac_act_dom from mem group by place having avg(case when place < 'Supplier#000000004' and centre is not null then 1 else 0 end) < 0.1",
    "components": f"with recursive {TABLE_SQL}, {_E}, f as (select cell_id from cells where activity_share >= 0.4), ff as (select src, dst from e where src in (select cell_id from f) and dst in (select cell_id from f)), {_COMP}, {_AREA} select cell_id, area, n_cells from ar where n_cells >= 2",
    "commute_score": f"with {_STOP} select stop_id, amb, ama, pmb, pma, round(res_score, 6) as res_score, flow from sc",
    "weighted_cell_score": f"with {_STOP}, {D.units_sql()} select cell_id, sc.grid_ix, sc.grid_iy, round(sum(res_score * flow) / sum(flow), 6) as res_score, round(sum(flow), 6) as flow, count(*) as n_stops from sc join units on sc.grid_ix = units.grid_ix and sc.grid_iy = units.grid_iy group by all",
    "typology_crosstab": f"with {_STOP}, {TABLE_SQL}, stops as (select sc.* from sc join units on sc.grid_ix = units.grid_ix and sc.grid_iy = units.grid_iy), w as (select stop_id, res_score, dominant_functional as d, count(*) as n from stops join cells c on abs(stops.grid_ix - c.grid_ix) <= 1 and abs(stops.grid_iy - c.grid_iy) <= 1 group by all), m as (select stop_id, res_score, (list(d order by n desc, d))[1] as modal from w group by all), t as (select case when res_score > 0.1 then 'resid_commute' when res_score < -0.1 then 'activity_commute' else 'no_pattern' end as station_type, case when modal = 'residential' then 'residential' when modal in ('activity_A', 'activity_B') then 'activity' else 'other' end as g from m) select station_type, {', '.join(f'count(*) filter (g = {x!r}) as {x}' for x in ('residential', 'activity', 'other'))} from t group by station_type",
    "validation_chain": f"with {_STOP}, {TABLE_SQL}, stops as (select sc.* from sc join units on sc.grid_ix = units.grid_ix and sc.grid_iy = units.grid_iy), m as (select k, stop_id, avg(share_residential) as x, any_value(res_score) as y from stops join cells c on abs(stops.grid_ix - c.grid_ix) <= 2 and abs(stops.grid_iy - c.grid_iy) <= 2 join range(0, 3) r(k) on greatest(abs(stops.grid_ix - c.grid_ix), abs(stops.grid_iy - c.grid_iy)) <= k group by all), g as (select k, count(*) as n, corr(x, y) as r, regr_r2(y, x) as r2, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from m group by k) select cast(k as int) as k, n, round(r, 6) as r, round(r2, 6) as r2, round(slope, 6) as slope, round(intercept, 6) as intercept, {t_tail_sql('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')} as p from g",
    "density_control": f"with {_STOP}, {D.units_sql()}, stops as (select sc.* from sc join units on sc.grid_ix = units.grid_ix and sc.grid_iy = units.grid_iy) select stop_id as point, round(ln(1 + avg(abs(density))), 6) as log_density from stops join units c on abs(stops.grid_ix - c.grid_ix) <= 1 and abs(stops.grid_iy - c.grid_iy) <= 1 group by stop_id",
}
