"""Queries of report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import report, spatial
from gridweave.plans import places
from gridweave.plans.features import rounded
from gridweave.plans.places import _settled_plan
from gridweave.plans.regimes import K, L, TABLE_SQL, _labels, _table
from gridweave import constants as C
from gridweave.sources import domain as D


def diurnal(spark, sf):
    return rounded(report.diurnal(_labels(spark, sf), K))


def purity_by_size(spark, sf):
    t = _table(spark, sf).withColumn("gu", F.substring("admin_dong", 1, 5))
    return rounded(report.purity_by_size(t, ["admin_dong", "gu"]))


def hotspots(spark, sf):
    p = _settled_plan(spark, sf)
    areas = spatial.connected_areas(p.where("activity_share >= 0.45").select("cell_id", "grid_ix", "grid_iy"), 1)
    clusters = spatial.area_attributes(areas.select("cell_id", "area"), p.select("cell_id", "grid_ix", "grid_iy", "admin_dong", "activity_share"), p.where("centre is not null").select("cell_id", "centre", "tier"))
    return rounded(report.hotspots(clusters, D.centres(spark, sf).withColumnsRenamed({"label": "place", "tier": "category"})))


def centre_report(spark, sf):
    return report.centre_report(places.tier_concordance(spark, sf))


def threshold_report(spark, sf):
    return report.threshold_report(places.threshold_sensitivity(spark, sf))


QUERIES = {f.__name__: f for f in (diurnal, purity_by_size, hotspots, centre_report, threshold_report)}
SQL = {
    "centre_report": f"with t as ({places.SQL['tier_concordance']}) select tier, n_centers as centres, n_active as active, printf('%.0f', pct_active) as active_pct, printf('%.2f', mean_activity_share) as mean_activity from t",
    "threshold_report": f"with t as ({places.SQL['threshold_sensitivity']}) select translate(def, '_', ' ') as definition, n_core_cells as core_cells, coalesce(printf('%.1f', outside_pct), '--') as outside_pct, {', '.join(f"coalesce(printf('%.0f', tier{i}_active_pct), '--') as tier{i}" for i in range(len(C.TIERS)))} from t",
    "diurnal": f"with {L} select time_bin, {', '.join(f'round(count(*) filter (state = {k}) / count(*), 6) as p{k}' for k in range(K))} from labels_t group by time_bin",
    "purity_by_size": f"with {TABLE_SQL}, u as (select 'admin_dong' as unit_kind, admin_dong as unit, dominant_functional as d from cells union all select 'gu', substr(admin_dong, 1, 5), dominant_functional from cells), n as (select unit_kind, unit, d, count(*) as n from u where d <> 'none' group by all) select unit_kind, unit, sum(n)::bigint as n_cells, round(max(n) / sum(n), 6) as purity from n group by all",
}
