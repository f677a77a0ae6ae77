"""Ridership: wide to long, commute scores, catchments and the geocoding of stops and stations."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.functions import columns as X
from gridweave.operators import inference, spatial

#: Hours in the order of an operating day.
SUBWAY_HOURS = [*range(4, 24), *range(4)]
#: Keys for fuzzy matching that are broadcast at most; beyond, names and keys meet by the letters they share.
FUZZY_KEYS = 20_000


def long_hours(wide: DataFrame, ids: Sequence[str], board: str, alight: str, hours: Sequence[int]) -> DataFrame:
    """Columns of hours to rows, in one pass; board and alight are patterns with {h}. Hours without a column are left out."""
    have = [h for h in hours if board.format(h=h) in wide.columns]
    parts = ", ".join(f"{h}Y, cast(trim(`{board.format(h=h)}`) as double), cast(trim(`{alight.format(h=h)}`) as double)" for h in have)
    return wide.selectExpr(*(f"trim(`{c}`) as `{c}`" for c in ids), f"stack({len(have)}, {parts}) as (hour, board, alight)")


def dedup_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key; of different rows the least, so that the result doesn't depend on their order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns))


def by_stop(routes: DataFrame) -> DataFrame:
    return routes.groupBy("use_ym", "stop_id", "stop_name", "hour").agg(X.zero_sum(F.col("board")).alias("board"), X.zero_sum(F.col("alight")).alias("alight"))


def commute_score(rides: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(AM boarding + PM alighting - AM alighting - PM boarding) over all of them; ids without such rides are left out."""
    part = lambda c, hours: X.zero_sum(F.when(F.col("hour").isin(hours), F.col(c)))
    g = rides.groupBy(*ids).agg(part("board", C.AM_HOURS).alias("amb"), part("alight", C.AM_HOURS).alias("ama"), part("board", C.PM_HOURS).alias("pmb"), part("alight", C.PM_HOURS).alias("pma"))
    total = F.col("amb") + F.col("ama") + F.col("pmb") + F.col("pma")
    return g.withColumns({"res_score": X.ratio((F.col("amb") + F.col("pma")) - (F.col("ama") + F.col("pmb")), total), "flow": total}).where("res_score is not null")


def station_type(score):
    return F.when(score > 0.1, "resid_commute").when(score < -0.1, "activity_commute").otherwise("no_pattern")


def cell_group(regime):
    return F.when(regime == "residential", "residential").when(regime.isin(C.ACTIVITY), "activity").otherwise("other")


def weighted_cell_score(scores: DataFrame, keys: Sequence[str] = ("cell_id", "grid_ix", "grid_iy")) -> DataFrame:
    """Mean score of a cell's stops, weighted by flow."""
    return scores.groupBy(*keys).agg((F.sum(F.col("res_score") * F.col("flow")) / F.sum("flow")).alias("res_score"), F.sum("flow").alias("flow"), F.count("*").alias("n_stops"))


def snap_to_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds grid indices of (utm_x, utm_y) and the cell there, null where there is none."""
    at = points.withColumns({"grid_ix": X.grid_index(F.col("utm_x"), C.GRID_X0), "grid_iy": X.grid_index(F.col("utm_y"), C.GRID_Y0)})
    return at.join(cells.select("cell_id", "grid_ix", "grid_iy"), ["grid_ix", "grid_iy"], "left")


def catchment_regressions(stops: DataFrame, cells: DataFrame, value: str, radii: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """k and the regression of the stops' res_score on the mean of `value` over the cells within k of each; a row a radius with stops.

    stops has stop_id, grid_ix, grid_iy and res_score. All radii come from one join with the widest window.
    """
    pairs = spatial.window_pairs(stops.select("stop_id", "res_score", F.col("grid_ix").alias("_x"), F.col("grid_iy").alias("_y"), "grid_ix", "grid_iy"), cells.select("grid_ix", "grid_iy", F.col("grid_ix").alias("_cx"), F.col("grid_iy").alias("_cy"), value), max(radii))
    far = F.greatest(F.abs(F.col("_x") - F.col("_cx")), F.abs(F.col("_y") - F.col("_cy")))
    each = pairs.withColumn("k", F.explode(F.array(*map(F.lit, radii)))).where(far <= F.col("k"))
    means = each.groupBy("k", "stop_id").agg(F.avg(value).alias("_mean"), F.first("res_score").alias("res_score"))
    return inference.regressions(means, "k", "_mean", "res_score")


def geocode_stops(stops: DataFrame, master: DataFrame, cells: DataFrame) -> DataFrame:
    """stops(stop_id, stop_name) with the master's coordinates, projected and put into cells; stops outside cells are left out."""
    j = stops.join(master.select("stop_id", "lat", "lon"), "stop_id", "left").where("lat is not null")
    x, y = X.korea_unified(F.col("lat"), F.col("lon"))
    return snap_to_cells(j.withColumns({"utm_x": x, "utm_y": y}), cells).where("cell_id is not null")


def fuzzy_matches(names: DataFrame, keys: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """name and match: for each name the key of the highest matching ratio (Ratcliff and Obershelp) of at least cutoff, of equal ones the last by code point."""
    n = keys.count()
    if n <= FUZZY_KEYS:
        shared = keys.sparkSession.sparkContext.broadcast(sorted(r[0] for r in keys.collect()))

        def best(batches):
            for b in batches:
                found = [difflib.get_close_matches(x, shared.value, n=1, cutoff=cutoff) for x in b["name"]]
                yield pd.DataFrame({"name": b["name"], "match": [f[0] if f else None for f in found]})

        return names.toDF("name").mapInPandas(best, "name string, match string").where("match is not null")

    # Any ratio above 0 needs a common letter.
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    pairs = names.toDF("name").withColumn("_l", F.explode(letters(F.col("name")))).join(keys.toDF("key").withColumn("_l", F.explode(letters(F.col("key")))), "_l").select("name", "key").distinct()

    def score(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "key": b["key"], "ratio": [difflib.SequenceMatcher(None, k, x).ratio() for x, k in zip(b["name"], b["key"], strict=True)]})

    scored = pairs.mapInPandas(score, "name string, key string, ratio double").where(F.col("ratio") >= cutoff)
    return scored.groupBy("name").agg(F.max(F.struct("ratio", "key")).alias("_m")).select("name", F.col("_m.key").alias("match"))


def geocode_stations(stations: DataFrame, master: DataFrame, cells: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """stations(station_name) by normalised name, then by the nearest name; with coordinates and cell (null outside cells)."""
    keyed = master.withColumn("nkey", X.station_key(F.col("st_name")))
    centre = keyed.groupBy("nkey").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("st_name").alias("st_name"))
    own = stations.select("station_name").distinct().withColumn("nkey", X.station_key(F.col("station_name")))
    exact = own.join(centre, "nkey")
    rest = own.join(centre, "nkey", "left_anti")
    near = fuzzy_matches(rest.select("nkey").distinct(), centre.select("nkey"), cutoff)
    fuzzy = rest.join(near, rest["nkey"] == near["name"]).select("station_name", near["match"].alias("nkey")).join(centre, "nkey")
    both = exact.unionByName(fuzzy)
    x, y = X.korea_unified(F.col("lat"), F.col("lon"))
    return snap_to_cells(both.withColumns({"utm_x": x, "utm_y": y}), cells)
