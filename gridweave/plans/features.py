"""Queries over features, cells and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.functions import columns as X
from gridweave.operators import cells, features
from gridweave.session import ensure_checkpoint_dir
from gridweave.sources import domain as D

N = 1
DAY = "2024-01-25"
B16 = [(f"b_{s}{b}", [f'"{s}_{p}"' for p in parts]) for s in C.SEXES for b, parts in C.TEN_YEAR_BANDS.items()]
R = lambda c, n=6: F.round(c, n).alias(c)


def rounded(df, keep=()):
    """All doubles to six digits."""
    return df.select(*(F.round(f"`{c}`", 6).alias(c) if t == "double" and c not in keep else F.col(f"`{c}`") for c, t in df.dtypes))


def _split():
    return F.when(F.col("date") <= F.lit(DAY).cast("date"), "train").otherwise("holdout")


def _presence(spark, sf, n=N):
    return features.presence(D.living(spark, sf, n))


def _emission(spark, sf, n=N):
    return features.emission(_presence(spark, sf, n), features.dwell(D.stay(spark, sf, n)), _split())


PRESENCE_SQL = f"""{D.living_sql(N)}, pres0 as (select cell_id, date, time_bin, avg(total_pop) as mean_total_pop, count(total_pop) as presence_n_hours,
{', '.join(f"avg({' + '.join(f'coalesce({p}, 0.0)' for p in parts)}) as {b}" for b, parts in B16)} from living group by all having avg(total_pop) is not null),
pres1 as (select *, {' + '.join(b for b, _ in B16)} as bands from pres0),
pres as (select cell_id, date, time_bin, ln(1 + mean_total_pop) as presence_log, mean_total_pop, presence_n_hours, bands <= 0 as presence_demo_masked,
{', '.join(f'case when bands > 0 then {b} / bands end as {m}' for (b, _), m in zip(B16, C.MIX, strict=True))} from pres1)"""
DWELL_SQL = f"""{D.stay_sql(N)}, dw0 as (select cell_id, date, start_tz as time_bin, coalesce(sum(total), 0) as denom, count(total) as dwell_n_codes,
{', '.join(f"coalesce(sum(total) filter (stay_dur = '{c}'), 0) as v_{c}" for c in C.DWELL_CODES)} from stay group by all),
dw as (select cell_id, date, time_bin, {', '.join(f'case when denom > 0 then v_{c} / denom end as dwell_share_{c}' for c in C.DWELL_CODES)},
case when denom > 0 then ln(1 + denom) end as stay_vol_log, dwell_n_codes, dwell_n_codes <= 1 as dwell_heavy_masked,
case when denom > 0 then v_000 / denom end as short_share, case when denom > 0 then v_240 / denom end as long_share from dw0)"""
EM_SQL = f"""{PRESENCE_SQL}, {DWELL_SQL}, em as (select p.cell_id, p.date, p.time_bin, case when p.date <= date '{DAY}' then 'train' else 'holdout' end as split, presence_log, mean_total_pop, presence_n_hours, presence_demo_masked,
{', '.join(C.MIX)}, {', '.join(C.DWELL)}, short_share, long_share, stay_vol_log, dwell_n_codes, dwell_heavy_masked, stay_vol_log is not null as dwell_present
from pres p left join dw d on p.cell_id = d.cell_id and p.date = d.date and p.time_bin = d.time_bin)"""
_r = lambda cols: ", ".join(f"round({c}, 6) as {c}" for c in cols)


def presence_bins(spark, sf):
    return rounded(_presence(spark, sf))


def dwell_bins(spark, sf):
    return rounded(features.dwell(D.stay(spark, sf, N)))


def emission(spark, sf):
    return rounded(_emission(spark, sf))


def universe_emission(spark, sf):
    """The semi-join form: cells of the universe alone."""
    master = cells.cell_master(D.living(spark, sf), D.stay(spark, sf), D.cell_units(spark, sf), D.cell_units(spark, sf))
    universe = master.where("in_universe").select("cell_id")
    p = features.presence(D.living(spark, sf), cells=universe)
    return p.groupBy("cell_id").agg(F.count("*").alias("n_bins"), F.round(F.avg("presence_log"), 6).alias("mean_presence_log"))


def event_share_by_bin(spark, sf):
    from gridweave.operators import sequences

    return rounded(sequences.share_given_bin(D.labels(spark, sf, N)))


def cell_master(spark, sf):
    u = D.cell_units(spark, sf)
    return rounded(cells.cell_master(D.living(spark, sf), D.stay(spark, sf), u, u))


def cell_master_counts(spark, sf):
    u = D.cell_units(spark, sf)
    return cells.master_counts(cells.cell_master(D.living(spark, sf), D.stay(spark, sf), u, u))


MASTER_SQL = f"""{D.living_sql()}, {D.stay_sql()}, {D.units_sql()}, lc as (select cell_id, avg(total_pop) as mean_total_pop, count(total_pop) as n_nonnull_obs, count(*) as n_rows from living group by cell_id),
sc as (select distinct cell_id from stay),
m as (select lc.*, admin_dong, utm_x, utm_y, sc.cell_id is not null as in_stay, mean_total_pop >= 25 as active_25, mean_total_pop >= 50 as active_50, mean_total_pop >= 100 as active_100,
sc.cell_id is not null and mean_total_pop >= 50 as in_universe from lc left join units u on lc.cell_id = u.cell_id left join sc on lc.cell_id = sc.cell_id)"""


def modal_area(spark, sf):
    """The most frequent category by key with a fixed rule for ties."""
    return cells.modal(D.labels(spark, sf).select("cell_id", "state"), "cell_id", "state", "modal_state")


def scaler_train(spark, sf):
    return rounded(features.scaler(_emission(spark, sf)))


def full_cycles(spark, sf):
    full = features.full_cycles(_emission(spark, sf, D.BLOCK).select("cell_id", "date", "split", "time_bin"))
    return full.groupBy("cell_id", "date", "split").agg(F.count("*").alias("n_bins"))


def sampled_keys(spark, sf):
    keys = _emission(spark, sf).select("cell_id", "date", "split").distinct()
    return features.sample_keys(keys, {"train": 60, "holdout": 15})


def dwell_share_overall(spark, sf):
    return rounded(cells.dwell_shares(D.stay(spark, sf, N)))


def dwell_by_start(spark, sf):
    return rounded(cells.dwell_by_bin(D.stay(spark, sf, N)))


def ingest_accounting(spark, sf):
    living = D.living(spark, sf, N)
    return rounded(cells.ingest_accounting(living, X.year_month(F.col("date")), "grid_id", "total_pop", D.DEMO))


def clr_mix(spark, sf):
    t = features.with_clr(_emission(spark, sf))
    parts = [F.round(f"{b}_{i}", 6).alias(f"clr_{c}") for b, names in features.BLOCKS.items() for i, c in enumerate(names)]
    return t.select(*features.KEYS, "mix_missing", "dwell_missing", *parts)


def _clr_sql(cols, missing):
    d = C.ZERO_REPLACEMENT
    z = " + ".join(f"case when {c} = 0 then 1 else 0 end" for c in cols)
    fill = [f"ln(case when {c} = 0 then {d} else {c} * (1 - ({z}) * {d}) end)" for c in cols]
    mean = f"(({' + '.join(fill)}) / {len(cols)})"
    return [f"case when not {missing} then {f} - {mean} end as clr_{c}" for c, f in zip(cols, fill, strict=True)]


CLR_SQL = f"""{EM_SQL}, mk as (select *, presence_demo_masked or {' or '.join(f'{c} is null' for c in C.MIX)} as mix_missing, not dwell_present or {' or '.join(f'{c} is null' for c in C.DWELL)} as dwell_missing from em),
cl as (select *, {', '.join(_clr_sql(C.MIX, 'mix_missing'))}, {', '.join(_clr_sql(C.DWELL, 'dwell_missing'))} from mk)"""
_CL = [f"clr_{c}" for c in [*C.MIX, *C.DWELL]]
Z_SQL = f"""{CLR_SQL}, mu as (select {', '.join(f'avg({c}) as {c}_m' for c in _CL)}, avg(presence_log) as pm, stddev_samp(presence_log) as ps, avg(stay_vol_log) as sm, stddev_samp(stay_vol_log) as ss from cl where split = 'train'),
im as (select cl.* exclude ({', '.join(_CL)}), {', '.join(f'coalesce({c}, {c}_m) as {c}' for c in _CL)}, pm, ps, sm, ss from cl, mu),
sd as (select {', '.join(f'avg({c}) as {c}_a, stddev_pop({c}) as {c}_s' for c in _CL)} from im where split = 'train'),
z as (select cell_id, date, time_bin, split, (presence_log - pm) / ps as presence_log_z, case when dwell_missing then 0 else (stay_vol_log - sm) / ss end as stay_vol_log_z,
{', '.join(f'({c} - {c}_a) / case when {c}_s > 0 then {c}_s else 1 end as {c}_z' for c in _CL)}, cast(dwell_missing as double) as dwell_missing, cast(mix_missing as double) as mix_missing from im, sd)"""


def _rows(spark, sf, n=N):
    em = _emission(spark, sf, n)
    return features.model_rows(em, features.fit_transform_parameters(em))


def feature_vector(spark, sf):
    r = _rows(spark, sf)
    return r.select(*features.KEYS, "split", *(F.round(F.element_at("x", i + 1), 6).alias(f) for i, f in enumerate(C.FEATURES)))


def presence_only_vector(spark, sf):
    em = _emission(spark, sf)
    r = features.presence_only_rows(em, features.fit_transform_parameters(em))
    names = [C.FEATURES[0], *C.FEATURES[2:18], C.FEATURES[-1]]
    return r.select(*features.KEYS, "split", *(F.round(F.element_at("x", i + 1), 6).alias(f) for i, f in enumerate(names)))


def model_sequences(spark, sf):
    """Sequences of complete days: a check sum of each feature matrix."""
    seq = features.sequences(features.full_cycles(_rows(spark, sf, D.BLOCK)))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.aggregate(v, F.lit(0.0), lambda b, y: b + y.cast("double")))
    return seq.select("cell_id", "date", "split", "year_month", F.size("x").alias("n_steps"), F.round(total, 2).alias("total"))


def lda_tokens(spark, sf):
    ensure_checkpoint_dir(spark)
    rows = _rows(spark, sf).checkpoint()  # read for the edges and for the tokens
    t = features.tokens(rows, features.quantile_edges(rows.where("split = 'train'"), 24), 24)
    return t.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_F24 = C.FEATURES[:24]
TOKEN_SQL = f"""{Z_SQL}, ed as (select {', '.join(f'quantile_cont({f}, [0.2, 0.4, 0.6, 0.8]) as {f}' for f in _F24)} from z where split = 'train'),
tk as ({' union all '.join(f'select {j * 5} + len(list_filter(ed.{f}, lambda e: e <= z.{f})) as token from z, ed' for j, f in enumerate(_F24))}
union all select 120 as token from z where dwell_missing > 0.5 union all select 121 as token from z where mix_missing > 0.5)"""


def quantiles(spark, sf):
    """A quantile by nearest rank beside the linear one."""
    living = D.living(spark, sf, N)
    near = cells.quantile_nearest(living, "total_pop", 0.9).withColumnRenamed("value", "nearest")
    return living.agg(F.round(F.percentile("total_pop", F.lit(0.9)), 6).alias("linear")).crossJoin(near)


QUERIES = {f.__name__: f for f in (presence_bins, dwell_bins, emission, universe_emission, event_share_by_bin, cell_master, cell_master_counts, modal_area, scaler_train, full_cycles, sampled_keys, dwell_share_overall, dwell_by_start, ingest_accounting, clr_mix, feature_vector, presence_only_vector, model_sequences, lda_tokens, quantiles)}

SQL = {
    "presence_bins": f"with {PRESENCE_SQL} select cell_id, date, time_bin, round(presence_log, 6) as presence_log, round(mean_total_pop, 6) as mean_total_pop, presence_n_hours, presence_demo_masked, {_r(C.MIX)} from pres",
    "dwell_bins": f"with {DWELL_SQL} select cell_id, date, time_bin, {_r([*C.DWELL, 'stay_vol_log'])}, dwell_n_codes, dwell_heavy_masked, {_r(['short_share', 'long_share'])} from dw",
    "emission": f"with {EM_SQL} select cell_id, date, time_bin, split, {_r(['presence_log', 'mean_total_pop'])}, presence_n_hours, presence_demo_masked, {_r([*C.MIX, *C.DWELL, 'short_share', 'long_share', 'stay_vol_log'])}, dwell_n_codes, dwell_heavy_masked, dwell_present from em",
    "universe_emission": f"with {D.living_sql()}, u as (select cell_id from living group by cell_id having avg(total_pop) >= 50), p as (select cell_id, date, time_bin, ln(1 + avg(total_pop)) as l from living where cell_id in (select cell_id from u) group by all having avg(total_pop) is not null) select cell_id, count(*) as n_bins, round(avg(l), 6) as mean_presence_log from p group by cell_id",
    "event_share_by_bin": f"with {D.labels_sql(N)}, c as (select time_bin, state, count(*) as n from labels_t group by all) select time_bin, state, n, round(n / sum(n) over (partition by time_bin), 6) as share from c",
    "cell_master": f"with {MASTER_SQL} select cell_id, round(mean_total_pop, 6) as mean_total_pop, n_nonnull_obs, n_rows, admin_dong, utm_x, utm_y, in_stay, active_25, active_50, active_100, in_universe from m",
    "cell_master_counts": f"with {MASTER_SQL} select count(*) as living_any, count(*) filter (in_stay) as intersection, {', '.join(f'count(*) filter (active_{t}) as active_{t}_all, count(*) filter (in_stay and active_{t}) as intersection_active_{t}' for t in (25, 50, 100))}, count(*) filter (utm_x is null) as coords_missing, count(*) filter (admin_dong is null) as admin_missing, count(*) filter (in_universe) as universe from m",
    "modal_area": f"with {D.labels_sql()}, c as (select cell_id, state, count(*) as n from labels_t group by all) select cell_id, state as modal_state from (select *, row_number() over (partition by cell_id order by n desc, state) as r from c) where r = 1",
    "scaler_train": f"with {EM_SQL}, t as (select * from em where split = 'train') " + " union all ".join(f"select '{f}' as feature, round(avg({f}), 6) as mean, round(stddev_samp({f}), 6) as std, count({f}) as n_train from t" for f in ("presence_log", "stay_vol_log")),
    "full_cycles": f"with {D.in_blocks(EM_SQL)} select cell_id, date, split, count(*) as n_bins from em group by all having count(*) = 19",
    "sampled_keys": f"with {EM_SQL}, k as (select distinct cell_id, date, split from em), r as (select *, row_number() over (partition by split order by md5(cell_id || '|' || cast(date as varchar) || '|42'), cell_id, date) as r from k) select cell_id, date, split from r where r <= case when split = 'train' then 60 else 15 end",
    "dwell_share_overall": f"with {D.stay_sql(N)}, c as (select * from (values {', '.join(f'({i}, ' + repr(c) + ')' for i, c in enumerate(C.DWELL_CODES))}) v(ord, code)), s as (select stay_dur, sum(total) as pop from stay group by stay_dur) select ord, code as stay_dur, round(coalesce(pop, 0) / (select sum(pop) from s), 6) as share from c left join s on code = stay_dur",
    "dwell_by_start": f"with {D.stay_sql(N)} select stay_dur, {', '.join(f'round(coalesce(sum(total) filter (start_tz = ' + repr(b) + f'), 0), 6) as tz_{b}' for b in C.TIME_BINS)} from stay group by stay_dur",
    "ingest_accounting": f"with {D.living_sql(N)}, d as (select strftime(date, '%Y%m') as ym, date, count(*) as n from living group by all), dd as (select ym, min(n) as lo, max(n) as hi from d group by ym), l as (select strftime(date, '%Y%m') as year_month, count(*) as rows, count(distinct date) as n_days, count(distinct cell_id) as uniq_grid, min(date) as date_min, max(date) as date_max, round(sum({' + '.join(f'cast({chr(34)}{c}{chr(34)} is null as int)' for c in D.DEMO)}) * 100.0 / (count(*) * {len(D.DEMO)}), 6) as demo_null_pct, count(*) filter (total_pop is null) as total_null from living group by 1) select l.*, lo as rows_per_day_min, hi as rows_per_day_max from l join dd on year_month = ym",
    "clr_mix": f"with {CLR_SQL} select cell_id, date, time_bin, mix_missing, dwell_missing, {_r(_CL)} from cl",
    "feature_vector": f"with {Z_SQL} select cell_id, date, time_bin, split, {_r(C.FEATURES)} from z",
    "presence_only_vector": f"with {Z_SQL} select cell_id, date, time_bin, split, {_r([C.FEATURES[0], *C.FEATURES[2:18], C.FEATURES[-1]])} from z",
    "model_sequences": f"with {D.in_blocks(Z_SQL)}, q as (select *, count(*) over (partition by cell_id, date) as nb from z) select cell_id, date, split, strftime(date, '%Y%m') as year_month, cast(count(*) as int) as n_steps, round(sum({' + '.join(f'cast(cast({f} as float) as double)' for f in C.FEATURES)}), 2) as total from q where nb = 19 group by cell_id, date, split",
    "lda_tokens": f"with {TOKEN_SQL} select cast(token as int) as token, count(*) as n from tk group by 1",
    "quantiles": f"with {D.living_sql(N)}, s as (select total_pop, row_number() over (order by total_pop) - 1 as i, count(*) over () as n from living where total_pop is not null) select round((select quantile_cont(total_pop, 0.9) from living), 6) as linear, total_pop as nearest from s where i = round_even(0.9 * (n - 1), 0)",
}
