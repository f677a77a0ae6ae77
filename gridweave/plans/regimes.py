"""Queries over labels: runs, durations, summaries of regimes, agreement and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.operators import agreement, inference, regimes, sequences
from gridweave.plans.features import rounded
from gridweave.sources import domain as D

K = len(D.STATES)
STRUCT = [6]
NAMES = D.STATES
KEYS = ["cell_id", "date"]
MOST = 19
SUBSET = 800


def _labels(spark, sf):
    return D.labels(spark, sf)


def _days(spark, sf):
    """Sequences of a cell and a day, for blocks of users."""
    return D.labels(spark, sf, D.BLOCK)


def run_lengths(spark, sf):
    r = sequences.runs(_days(spark, sf), KEYS, "event_id")
    return r.groupBy("state", "length", "interior").agg(F.count("*").alias("n"))


def duration_pmf(spark, sf):
    return rounded(sequences.duration_pmf(sequences.runs(_days(spark, sf), KEYS, "event_id"), MOST))


def coherence(spark, sf):
    return rounded(sequences.coherence(_days(spark, sf), KEYS, "event_id"))


def transition_counts(spark, sf):
    return sequences.transitions(_days(spark, sf), KEYS, "event_id")


def _self_transition(labels):
    t = sequences.transitions(labels, KEYS, "event_id")
    return t.groupBy(F.col("src").alias("state")).agg((F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a"))


def geometric_pmf(spark, sf):
    return rounded(sequences.geometric_pmf(_self_transition(_days(spark, sf)), MOST))


def duration_kl(spark, sf):
    l = _days(spark, sf)
    pmf = sequences.duration_pmf(sequences.runs(l, KEYS, "event_id"), MOST)
    prior = l.groupBy("state").agg(F.count("*").cast("double").alias("w"))
    return rounded(sequences.duration_kl(pmf, sequences.geometric_pmf(_self_transition(l), MOST), prior, MOST))


L = D.labels_sql()
RUNS_SQL = f"""{D.in_blocks(L)}, s0 as (select *, row_number() over (partition by cell_id, date order by event_id) - 1 as t, case when state <> lag(state) over (partition by cell_id, date order by event_id) then 1 else 0 end as ch, count(*) over (partition by cell_id, date) - 1 as lt from labels_t),
s1 as (select *, sum(ch) over (partition by cell_id, date order by event_id rows unbounded preceding) as seg from s0),
runs as (select cell_id, date, seg, min(state) as state, count(*) as length, min(t) > 0 and max(t) < max(lt) as interior from s1 group by cell_id, date, seg),
pm0 as (select state, length as duration, count(*) as n from runs where interior and length <= {MOST} group by all), pmf as (select *, n / sum(n) over (partition by state) as p from pm0),
tr as (select lag(state) over (partition by cell_id, date order by event_id) as src, state as dst from labels_t), trc as (select src, dst, count(*) as n from tr where src is not null group by all),
st as (select src as state, greatest(1e-6, least(1 - 1e-6, sum(case when src = dst then n else 0 end) / sum(n))) as a from trc group by src),
ge0 as (select state, d as duration, pow(a, d - 1) * (1 - a) as w from st, range(1, {MOST + 1}) r(d)), geo as (select state, duration, w / sum(w) over (partition by state) as q from ge0)"""


def _summary(spark, sf):
    return regimes.summary(_labels(spark, sf), NAMES, STRUCT)


def _table(spark, sf):
    s = regimes.with_margin(regimes.with_activity(_summary(spark, sf)))
    return s.join(D.cell_units(spark, sf), "cell_id")


def cell_regime_summary(spark, sf):
    return rounded(_summary(spark, sf))


def _dom(names, cols):
    best = f"greatest({', '.join(cols)})"
    when = " ".join(f"when {c} = {best} then '{n}'" for c, n in zip(cols, names, strict=True))
    return f"case when {' + '.join(cols)} = 0 then 'none' {when} end"


_FN = C.REGIMES
SUM_SQL = f"""{L}, cn as (select cell_id, {', '.join(f"count(*) filter (state = {k} and split = 'train') as a{k}, count(*) filter (state = {k} and split = 'train' and time_bin in ({', '.join(map(repr, C.DAY_BINS))})) as d{k}, count(*) filter (state = {k} and split = 'train' and time_bin in ({', '.join(map(repr, C.NIGHT_BINS))})) as n{k}, count(*) filter (state = {k} and split <> 'train') as h{k}" for k in range(K))} from labels_t group by cell_id),
sh as (select *, {' + '.join(f'a{k}' for k in range(6))} as ft, {' + '.join(f'a{k}' for k in range(7))} as al from cn),
sm as (select cell_id, al as n_celldays_train, {_dom(NAMES, [f'a{k}' for k in range(7)])} as dominant_all, {_dom(NAMES, [f'd{k}' for k in range(7)])} as dominant_day, {_dom(NAMES, [f'n{k}' for k in range(7)])} as dominant_night,
{_dom(_FN, [f'a{k}' for k in range(6)])} as dominant_functional, {_dom(NAMES, [f'h{k}' for k in range(7)])} as dominant_all_ho,
-({' + '.join(f'case when ft > 0 and a{k} > 0 then (a{k} / ft) * ln(a{k} / ft + 1e-12) else 0 end' for k in range(6))}) / ln(6) as func_entropy, case when al > 0 then a6 / al else 0 end as struct_bin_ratio,
{', '.join(f'case when ft > 0 then a{k} / ft else 0 end as share_{r}' for k, r in enumerate(_FN))} from sh)"""
_SH = [f"share_{r}" for r in _FN]
TABLE_SQL = f"""{SUM_SQL}, {D.units_sql()}, mg as (select *, share_activity_A + share_activity_B as activity_share, list_sort([{', '.join(_SH)}], 'desc')[1] - list_sort([{', '.join(_SH)}], 'desc')[2] as dom_margin from sm),
cells as (select mg.*, u.grid_ix, u.grid_iy, u.utm_x, u.utm_y, u.admin_dong, u.density from mg join units u on mg.cell_id = u.cell_id)"""


def _disc_sql(unit, where="true", lead=""):
    return f"""(select {lead} count(*) as n_units, avg(nd) as mean_distinct, avg(mx / tot) as mean_purity, median(mx / tot) as median_purity, count(*) filter (nd >= 2) as n_multi, 100.0 * avg(case when nd >= 2 then 1 else 0 end) as pct_multi
from (select u, count(*) as nd, sum(n) as tot, max(n) as mx from (select {unit} as u, dominant_functional as d, count(*) as n from cells where {unit} is not null and dominant_functional <> 'none' and {where} group by all) group by u))"""


_ROUND_DISC = "n_units, round(mean_distinct, 6) as mean_distinct, round(mean_purity, 6) as mean_purity, round(median_purity, 6) as median_purity, n_multi, round(pct_multi, 6) as pct_multi"


def unit_purity(spark, sf):
    return rounded(regimes.unit_purity(_table(spark, sf), "admin_dong"))


def discordance(spark, sf):
    t = _table(spark, sf).withColumn("gu", F.substring("admin_dong", 1, 5))
    a = regimes.discordance(t, "admin_dong").withColumn("unit", F.lit("dong"))
    return rounded(a.unionByName(regimes.discordance(t, "gu").withColumn("unit", F.lit("gu"))))


def eta2(spark, sf):
    return rounded(regimes.eta_squared(_table(spark, sf), "admin_dong", _SH))


def sensitivity(spark, sf):
    return rounded(regimes.sensitivity(_table(spark, sf), "admin_dong"))


def state_activation(spark, sf):
    return rounded(regimes.state_activation(_labels(spark, sf), K))


def _po(spark, sf):
    l = _labels(spark, sf)
    return regimes.presence_only_summary(l, K, regimes.state_activation(l, K))


def presence_only_summary(spark, sf):
    return rounded(_po(spark, sf))


def day_night_switch(spark, sf):
    return rounded(regimes.switch_share(_summary(spark, sf), "dominant_day", "dominant_night"))


def split_by_state(spark, sf):
    j = _summary(spark, sf).join(_po(spark, sf).select("cell_id", "po_dominant"), "cell_id")
    return rounded(regimes.split_table(j, 10))


def margin_quantiles(spark, sf):
    qs = (0.1, 0.25, 0.5, 0.75, 0.9)
    return rounded(_table(spark, sf).agg(*(F.percentile("dom_margin", F.lit(q)).alias(f"q{int(q * 100)}") for q in qs)))


ACT_SQL = f"""{L}, bn as (select time_bin, {', '.join(f'count(*) filter (state = {k}) / count(*) as p{k}' for k in range(K))} from labels_t group by time_bin),
ac as ({' union all '.join(f"select {k} as state, coalesce(avg(p{k}) filter (time_bin in ({', '.join(map(repr, C.NIGHT_BINS))})), 0) as night, coalesce(avg(p{k}) filter (time_bin in ({', '.join(map(repr, C.DAY_BINS))})), 0) as day from bn" for k in range(K))}),
kd as (select *, night - day as residentialness, case when night - day > 0.01 then 'residential' when night - day < -0.01 then 'activity' else 'neutral' end as kind from ac)"""


def _first(cols):
    best = f"greatest({', '.join(cols)})"
    return "case " + " ".join(f"when {c} = {best} then {i}" for i, c in enumerate(cols)) + " end"


PO_SQL = f"""{ACT_SQL}, {SUM_SQL[len(L) + 2 :]}, po as (select cell_id, {_first([f'a{k}' for k in range(7)])} as po_dominant, {_first([f'd{k}' for k in range(7)])} as po_dominant_day, {_first([f'n{k}' for k in range(7)])} as po_dominant_night,
{' + '.join(f"case when (select kind from kd where state = {k}) = 'residential' then a{k} / al else 0 end" for k in range(K))} as po_res_share, {' + '.join(f"case when (select kind from kd where state = {k}) = 'activity' then a{k} / al else 0 end" for k in range(K))} as po_act_share,
{', '.join(f'a{k} / al as po_share_s{k}' for k in range(K))} from sh where al > 0)"""


# Agreement and tests.


def _two_labelings(spark, sf):
    return _labelings(D.table(spark, sf, "events"))


def _labelings(events):
    return events.select("event_type", (F.length("props") * 7 + F.col("user_id") % 4).cast("int").alias("other"))


def ari(spark, sf):
    return rounded(agreement.adjusted_rand(_two_labelings(spark, sf), "event_type", "other"))


def ari_subset(spark, sf):
    """The index over a seeded subset of rows."""
    e = agreement.hash_subset(D.table(spark, sf, "events"), "event_id", SUBSET)
    return rounded(agreement.adjusted_rand(_labelings(e), "event_type", "other"))


def nmi(spark, sf):
    return rounded(agreement.normalized_mutual_information(_two_labelings(spark, sf), "event_type", "other"))


def contingency(spark, sf):
    return agreement.contingency(_two_labelings(spark, sf), "event_type", "other")


def linreg(spark, sf):
    return rounded(inference.linear_regression(D.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


def partial_corr(spark, sf):
    return rounded(inference.partial_correlation(D.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"))


def chi2_cramers_v(spark, sf):
    return rounded(inference.chi_squared(D.table(spark, sf, "customer"), "c_mktsegment", "c_nationkey"))


def multi_r2(spark, sf):
    r = inference.multiple_r2(D.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return spark.createDataFrame([(round(r["r2"], 6), round(r["adj_r2"], 6), r["n"], r["k"])], "r2 double, adj_r2 double, n long, k int")


QUERIES = {
    f.__name__: f
    for f in (run_lengths, duration_pmf, coherence, transition_counts, geometric_pmf, duration_kl, cell_regime_summary, unit_purity, discordance, eta2, sensitivity, state_activation, presence_only_summary, day_night_switch, split_by_state, margin_quantiles, ari, ari_subset, nmi, contingency, linreg, partial_corr, chi2_cramers_v, multi_r2)
}
_TWO = "t as (select event_type as a, cast(length(props) * 7 + user_id % 4 as int) as b from events), c as (select a, b, count(*) as n from t group by all), w as (select *, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as total from c)"


def t_tail_sql(t: str, dof: str) -> str:
    """Two-sided tail of the t distribution: one less its density summed by Simpson's rule up to |t| (at most 40)."""
    size, x = f"least(abs({t}), 40.0)", f"(least(abs({t}), 40.0) * i / 4000)"
    density = f"exp(lgamma(({dof} + 1) / 2) - lgamma(({dof}) / 2) - 0.5 * ln(pi() * ({dof})) - ({dof} + 1) / 2 * ln(1 + {x} * {x} / ({dof})))"
    return f"round(greatest(1 - 2 * (select sum({density} * case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) from range(0, 4001) simpson(i)) * {size} / 12000, 0.0), 6)"


_six = lambda *cols: ", ".join(f"round({c}, 6) as {c}" for c in cols)
SQL = {
    "run_lengths": f"with {RUNS_SQL} select state, length, interior, count(*) as n from runs group by all",
    "duration_pmf": f"with {RUNS_SQL} select state, duration, n, round(p, 6) as p from pmf",
    "coherence": f"with {RUNS_SQL} select round(sum(case when src = dst then n else 0 end) / sum(n), 6) as coherence, sum(n)::bigint as n_steps from trc",
    "transition_counts": f"with {RUNS_SQL} select src, dst, n from trc",
    "geometric_pmf": f"with {RUNS_SQL} select state, cast(duration as int) as duration, round(q, 6) as q from geo",
    "duration_kl": f"""with {RUNS_SQL}, j as (select s.state, d, coalesce(p, 0) + 1e-9 as p, coalesce(q, 0) + 1e-9 as q from (select distinct state from pmf) s cross join range(1, {MOST + 1}) r(d) left join pmf on pmf.state = s.state and pmf.duration = d left join geo on geo.state = s.state and geo.duration = d),
k as (select state, sum(p / sp * ln((p / sp) / (q / sq))) as kl from (select *, sum(p) over (partition by state) as sp, sum(q) over (partition by state) as sq from j) group by state), pr as (select state, count(*) / sum(count(*)) over () as w from labels_t group by state)
select round(sum(w * kl), 6) as duration_kl from k join pr using (state)""",
    "cell_regime_summary": f"with {SUM_SQL} select cell_id, n_celldays_train, dominant_all, dominant_day, dominant_night, dominant_functional, {_six('func_entropy', 'struct_bin_ratio')}, dominant_all_ho, {_six(*_SH)} from sm",
    "unit_purity": f"with {TABLE_SQL}, n as (select admin_dong, dominant_functional as d, count(*) as n from cells where dominant_functional <> 'none' group by all) select admin_dong, count(*) as n_distinct, sum(n)::bigint as n_cells, max(n) as n_modal, (list(d order by n desc, d))[1] as modal, round(max(n) / sum(n), 6) as purity from n group by admin_dong",
    "discordance": f"with {TABLE_SQL} select 'dong' as unit, {_ROUND_DISC} from {_disc_sql('admin_dong')} union all select 'gu' as unit, {_ROUND_DISC} from {_disc_sql('substr(admin_dong, 1, 5)')}",
    "eta2": f"with {TABLE_SQL}, x as ({' union all '.join(f'select {c!r} as component, admin_dong as u, {c} as x from cells' for c in _SH)}), g as (select component, u, count(*) as n, avg(x) as m from x group by all), t as (select component, avg(x) as m, var_pop(x) * count(*) as sst from x group by component), e as (select g.component, sum(n * pow(g.m - t.m, 2)) as ssb, max(sst) as sst from g join t on g.component = t.component group by g.component) select component, case when sst > 0 then round(ssb / sst, 6) end as eta2 from e union all select 'all', round(sum(ssb) / sum(sst), 6) from e",
    "sensitivity": f"with {TABLE_SQL} " + " union all ".join(f"select {m} as margin, {_ROUND_DISC} from {_disc_sql('admin_dong', f'dom_margin >= {m} and struct_bin_ratio <= 0.5')}" for m in (0.0, 0.1, 0.2)),
    "state_activation": f"with {ACT_SQL} select state, {_six('night', 'day', 'residentialness')}, kind from kd",
    "presence_only_summary": f"with {PO_SQL} select cell_id, po_dominant, po_dominant_day, po_dominant_night, {_six('po_res_share', 'po_act_share', *(f'po_share_s{k}' for k in range(K)))} from po",
    "day_night_switch": f"with {SUM_SQL} select round(100.0 * avg(case when dominant_day <> dominant_night then 1 else 0 end), 6) as switch_pct, count(*) as n from sm",
    "split_by_state": f"with {PO_SQL}, j as (select po_dominant, dominant_functional as d, count(*) as n, sum(share_residential) as r, sum(share_activity_B) as b from po join sm using (cell_id) group by all) select po_dominant, sum(n)::bigint as n_cells, count(*) as n_regimes, (list(d order by n desc, d))[1] as top_regime, round(sum(r) / sum(n), 6) as mean_share_residential, round(sum(b) / sum(n), 6) as \"mean_share_activityB\" from j group by po_dominant having sum(n) >= 10",
    "margin_quantiles": f"with {TABLE_SQL} select {', '.join(f'round(quantile_cont(dom_margin, {q}), 6) as q{int(q * 100)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9))} from cells",
    "ari": f"with {_TWO}, s as (select sum(n * (n - 1) / 2) as ij, (select sum(x * (x - 1) / 2) from (select sum(n) as x from c group by a)) as i, (select sum(x * (x - 1) / 2) from (select sum(n) as x from c group by b)) as j, sum(n) as t from c) select round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) as ari, t::bigint as n from s",
    "ari_subset": f"with {_TWO.replace('from events)', f"from (select * from events order by md5(event_id || '|{C.SEED}'), event_id limit {SUBSET}))")}, s as (select sum(n * (n - 1) / 2) as ij, (select sum(x * (x - 1) / 2) from (select sum(n) as x from c group by a)) as i, (select sum(x * (x - 1) / 2) from (select sum(n) as x from c group by b)) as j, sum(n) as t from c) select round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) as ari, t::bigint as n from s",
    "nmi": f"with {_TWO} select round(sum(n / total * ln((n / total) / ((na / total) * (nb / total)))) / ((sum(-n / total * ln(na / total)) + sum(-n / total * ln(nb / total))) / 2), 6) as nmi, max(total)::bigint as n from w",
    "contingency": f"with {_TWO} select a, b, n, na::bigint as na, nb::bigint as nb, total::bigint as total from w",
    "linreg": "with l as (select count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 6) as intercept, corr(l_quantity, l_extendedprice) as raw from lineitem) select l.* exclude (raw), " + t_tail_sql("raw * sqrt((n - 2) / (1 - raw * raw))", "n - 2") + " as p from l",
    "partial_corr": "with c as (select count(*) as n, corr(l_quantity, l_extendedprice) as xy, corr(l_quantity, l_discount) as xz, corr(l_extendedprice, l_discount) as yz from lineitem), p as (select n, xy, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) as pr from c) select n, round(xy, 6) as raw_r, round(pr, 6) as partial_r, round(pr * sqrt((n - 3) / (1 - pr * pr)), 6) as t, " + t_tail_sql("pr * sqrt((n - 3) / (1 - pr * pr))", "n - 3") + " as p from p",
    "chi2_cramers_v": "with c as (select c_mktsegment as a, c_nationkey as b, count(*) as n from customer group by all), ra as (select a, sum(n) as na from c group by a), rb as (select b, sum(n) as nb from c group by b), f as (select na, nb, coalesce(n, 0) as n, (select sum(n) from c) as t from ra cross join rb left join c on c.a = ra.a and c.b = rb.b), s as (select sum(pow(n - na * nb / t, 2) / (na * nb / t)) as chi2, max(t) as t, (select count(*) from ra) as ka, (select count(*) from rb) as kb from f) select round(chi2, 6) as chi2, (ka - 1) * (kb - 1) as dof, t::bigint as n, round(sqrt(chi2 / (t * (least(ka, kb) - 1))), 6) as cramers_v, round((select sum(exp(-chi2 / 2 + k * ln(chi2 / 2) - lgamma(k + 1))) from range(0, 500) r(k) where k < (ka - 1) * (kb - 1) / 2), 6) as p from s",
    "multi_r2": "with c as (select count(*) as n, corr(l_extendedprice, l_quantity) as ya, corr(l_extendedprice, l_discount) as yb, corr(l_extendedprice, l_tax) as yc, corr(l_quantity, l_discount) as ab, corr(l_quantity, l_tax) as ac, corr(l_discount, l_tax) as bc from lineitem), d as (select *, (yb - ya * ab) / sqrt((1 - ya * ya) * (1 - ab * ab)) as yb_a, (yc - ya * ac) / sqrt((1 - ya * ya) * (1 - ac * ac)) as yc_a, (bc - ab * ac) / sqrt((1 - ab * ab) * (1 - ac * ac)) as bc_a from c), e as (select *, (yc_a - yb_a * bc_a) / sqrt((1 - yb_a * yb_a) * (1 - bc_a * bc_a)) as yc_ab from d), f as (select n, 1 - (1 - ya * ya) * (1 - yb_a * yb_a) * (1 - yc_ab * yc_ab) as r2 from e) select round(r2, 6) as r2, round(1 - (1 - r2) * (n - 1) / (n - 4), 6) as adj_r2, n, 3 as k from f",
}
