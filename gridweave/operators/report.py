"""Tables of results: what reports and figures show, as DataFrames, and the small ones as LaTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.operators import polygons, regimes
from gridweave.sources.sinks import tex_table


def regime_characteristics(emissions: DataFrame, activation: DataFrame) -> DataFrame:
    """Each state's emissions beside how active it is at night and by day."""
    a = activation.select("state", F.col("night").alias("night_activation"), F.col("day").alias("day_activation"))
    return emissions.join(a, "state", "left")


def diurnal(labels: DataFrame, states: int) -> DataFrame:
    """Share of each state in each bin, one column a state; a bin without labels has no row."""
    n = labels.groupBy("time_bin").agg(F.count("*").alias("_all"), *(F.count_if(F.col("state") == k).alias(f"_{k}") for k in range(states)))
    return n.select("time_bin", *((F.col(f"_{k}") / F.col("_all")).alias(f"p{k}") for k in range(states)))


def purity_by_size(cells: DataFrame, units: list[str]) -> DataFrame:
    """unit_kind, unit, cells and purity of all units of several kinds."""
    out = None
    for u in units:
        one = regimes.unit_purity(cells, u).select(F.lit(u).alias("unit_kind"), F.col(u).cast("string").alias("unit"), "n_cells", "purity")
        out = one if out is None else out.unionByName(one)
    return out


def hotspots(clusters: DataFrame, places: DataFrame) -> DataFrame:
    """clusters with the first place whose polygon holds their middle, and how many do; places has ord, rings, place and category."""
    at = clusters.withColumns({"utm_x": F.col("cx"), "utm_y": F.col("cy")})
    hit = polygons.first_within(at, places, "cluster_id", ["place", "category"])
    adjacent = F.array_join(F.transform(F.arrays_zip("adj_centers", "adj_center_tiers", "adj_pair_counts"), lambda x: F.format_string("%s [%s] %d", x["adj_centers"], x["adj_center_tiers"], x["adj_pair_counts"])), "; ")
    return hit.select("cluster_id", "n_cells", "mean_activity_share", "dominant_admin_dong", "gu", "place", "category", F.col("n_hits").alias("n_places"), "touches_center", adjacent.alias("adjacent_centers"))


def centre_report(tiers: DataFrame) -> DataFrame:
    """The tiers in their order, with shares as they are printed."""
    rank = F.array_position(F.array(*map(F.lit, C.TIERS)), F.col("tier"))
    return tiers.orderBy(rank).select("tier", F.col("n_centers").alias("centres"), F.col("n_active").alias("active"), F.format_string("%.0f", "pct_active").alias("active_pct"), F.format_string("%.2f", "mean_activity_share").alias("mean_activity"))


def centre_table(tiers: DataFrame) -> str:
    """The tiers' table in LaTeX."""
    return tex_table(centre_report(tiers), ["Tier", "Centres", "Active", "Active (%)", "Mean activity share"], "lrrrr")


def threshold_report(sensitivity: DataFrame) -> DataFrame:
    """The definitions by name, with shares as they are printed; a share that does not exist is a dash."""
    shown = lambda c, digits: F.when(F.col(c).isNull(), "--").otherwise(F.format_string(f"%.{digits}f", F.col(c)))
    tiers = [shown(f"tier{i}_active_pct", 0).alias(f"tier{i}") for i in range(len(C.TIERS))]
    return sensitivity.orderBy("def").select(F.translate("def", "_", " ").alias("definition"), F.col("n_core_cells").alias("core_cells"), shown("outside_pct", 1).alias("outside_pct"), *tiers)


def threshold_table(sensitivity: DataFrame) -> str:
    """The definitions' table in LaTeX."""
    return tex_table(threshold_report(sensitivity), ["Definition", "Core cells", "Outside (%)", *C.TIERS], "l" + "r" * (2 + len(C.TIERS)))
