"""Summaries of decoded states: shares and dominants by cell, discordance of areas, variance between areas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.functions import columns as X

NONE = "none"


def split_states(emission_means: Sequence[float], threshold: float = 0.5) -> tuple[list[int], list[int]]:
    """States whose mean of the missing-dwell indicator reaches the threshold are structural, the others functional."""
    structural = [k for k, m in enumerate(emission_means) if m >= threshold]
    return structural, [k for k in range(len(emission_means)) if k not in structural]


def _counts(states: int, when) -> list:
    return [F.count_if((F.col("state") == k) & when).alias(f"_{k}") for k in range(states)]


def _dominant(counts, names: Sequence[str]):
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.element_at(F.array(*(F.lit(n) for n in names)), X.arg_max(counts) + 1)).otherwise(NONE)


def summary(labels: DataFrame, names: Sequence[str], structural: Sequence[int]) -> DataFrame:
    """One row a cell of labels(cell_id, time_bin, split, state): numbers, dominants, entropy and shares, in one aggregation.

    A tie of states goes to the smaller one; a cell without labels of a kind has the dominant `none`.
    """
    k, train = len(names), F.col("split") == "train"
    day, night = F.col("time_bin").isin(C.DAY_BINS), F.col("time_bin").isin(C.NIGHT_BINS)
    kinds = {"all": train, "day": train & day, "night": train & night, "ho": ~train}
    agg = labels.groupBy("cell_id").agg(*(F.array(*_counts(k, w)).alias(f"_{n}") for n, w in kinds.items()))
    functional = [i for i in range(k) if i not in structural]
    func = F.array(*(F.col("_all")[i] for i in functional))
    total = F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + x)
    func_total = F.aggregate(func, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.transform(func, lambda x: F.when(func_total > 0, x / func_total).otherwise(0.0))
    out = agg.select(
        "cell_id",
        total.alias("n_celldays_train"),
        _dominant(F.col("_all"), names).alias("dominant_all"),
        _dominant(F.col("_day"), names).alias("dominant_day"),
        _dominant(F.col("_night"), names).alias("dominant_night"),
        _dominant(func, [names[i] for i in functional]).alias("dominant_functional"),
        X.entropy(shares, len(functional)).alias("func_entropy"),
        F.when(total > 0, sum((F.col("_all")[i] for i in structural), F.lit(0).cast("long")) / total).otherwise(0.0).alias("struct_bin_ratio"),
        _dominant(F.col("_ho"), names).alias("dominant_all_ho"),
        shares.alias("_s"),
    )
    return out.select(*(c for c in out.columns if c != "_s"), *(F.col("_s")[j].alias(f"share_{names[i]}") for j, i in enumerate(functional)))


def with_activity(cells: DataFrame) -> DataFrame:
    return cells.withColumn("activity_share", F.col("share_activity_A") + F.col("share_activity_B"))


def with_margin(cells: DataFrame) -> DataFrame:
    return cells.withColumn("dom_margin", X.top_margin(F.array(*(F.col(f"share_{r}") for r in C.REGIMES))))


def unit_purity(cells: DataFrame, unit: str, category: str = "dominant_functional", drop_none: bool = True) -> DataFrame:
    """For each unit: cells, distinct categories, the commonest one's count and name, and purity."""
    rows = cells.where(F.col(unit).isNotNull())
    if drop_none:
        rows = rows.where(F.col(category) != NONE)
    n = rows.groupBy(unit, category).agg(F.count("*").alias("n"))
    per = n.groupBy(unit).agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_cells"), F.max("n").alias("n_modal"), F.min_by(category, F.struct(-F.col("n"), F.col(category))).alias("modal"))
    return per.withColumn("purity", F.col("n_modal") / F.col("n_cells"))


def discordance(cells: DataFrame, unit: str, category: str = "dominant_functional", drop_none: bool = True) -> DataFrame:
    """One row over all units: how mixed they are."""
    u = unit_purity(cells, unit, category, drop_none)
    return u.agg(
        F.count("*").alias("n_units"),
        F.avg("n_distinct").alias("mean_distinct"),
        F.avg("purity").alias("mean_purity"),
        F.percentile("purity", F.lit(0.5)).alias("median_purity"),
        F.count_if(F.col("n_distinct") >= 2).alias("n_multi"),
        (100.0 * F.avg((F.col("n_distinct") >= 2).cast("double"))).alias("pct_multi"),
    )


def eta_squared(cells: DataFrame, unit: str, columns: Sequence[str]) -> DataFrame:
    """Share of variance between units for each column, and over all columns together (`all`)."""
    d = cells.where(F.col(unit).isNotNull())
    names = [f"c{i}" for i in range(len(columns))]
    per = d.groupBy(unit).agg(F.count("*").alias("n"), *(F.avg(c).alias(n) for c, n in zip(columns, names, strict=True)))
    total = d.agg(*(x for c, n in zip(columns, names, strict=True) for x in (F.avg(c).alias(f"{n}_m"), (F.var_pop(c) * F.count(c)).alias(f"{n}_t"))))
    j = per.crossJoin(F.broadcast(total))  # one row
    sums = j.agg(*(x for n in names for x in (F.sum(F.col("n") * F.pow(F.col(n) - F.col(f"{n}_m"), F.lit(2.0))).alias(f"{n}_b"), F.max(f"{n}_t").alias(f"{n}_t"))))
    parts = ", ".join(f"'{c}', {n}_b, {n}_t" for c, n in zip(columns, names, strict=True))
    long = sums.selectExpr(f"stack({len(columns)}, {parts}) as (component, ssb, sst)")
    every = long.agg(F.lit("all").alias("component"), F.sum("ssb").alias("ssb"), F.sum("sst").alias("sst"))
    return long.unionByName(every).select("component", X.ratio(F.col("ssb"), F.col("sst")).alias("eta2"))


def sensitivity(cells: DataFrame, unit: str, margins: Sequence[float] = (0.0, 0.1, 0.2), structural_most: float = 0.5) -> DataFrame:
    """Discordance among the cells whose margin reaches each threshold and whose structural share is small."""
    out = None
    for m in margins:
        kept = cells.where((F.col("dom_margin") >= m) & (F.col("struct_bin_ratio") <= structural_most))
        row = discordance(kept, unit).select(F.lit(m).alias("margin"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def state_activation(labels: DataFrame, states: int) -> DataFrame:
    """For each state: the mean of its shares in night bins, in day bins, their difference, and its kind (beyond 0.01)."""
    bins = labels.groupBy("time_bin").agg(F.count("*").alias("all"), *(F.count_if(F.col("state") == k).alias(f"n{k}") for k in range(states)))
    long = bins.selectExpr("time_bin", f"stack({states}, {', '.join(f'{k}, n{k} / all' for k in range(states))}) as (state, p)")
    a = long.groupBy("state").agg(F.coalesce(F.avg(F.when(F.col("time_bin").isin(C.NIGHT_BINS), F.col("p"))), F.lit(0.0)).alias("night"), F.coalesce(F.avg(F.when(F.col("time_bin").isin(C.DAY_BINS), F.col("p"))), F.lit(0.0)).alias("day"))
    a = a.withColumn("residentialness", F.col("night") - F.col("day"))
    return a.withColumn("kind", F.when(F.col("residentialness") > 0.01, "residential").when(F.col("residentialness") < -0.01, "activity").otherwise("neutral"))


def presence_only_summary(labels: DataFrame, states: int, kinds: DataFrame) -> DataFrame:
    """One row a cell over training labels: dominant states (0 for a cell without data) and shares by state and by kind of kinds(state, kind)."""
    day, night = F.col("time_bin").isin(C.DAY_BINS), F.col("time_bin").isin(C.NIGHT_BINS)
    yes = F.lit(True)
    train = labels.where("split = 'train'")
    agg = train.groupBy("cell_id").agg(*(F.array(*_counts(states, w)).alias(n) for n, w in (("_all", yes), ("_day", day), ("_night", night))))
    total = F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + x)
    of = kinds.agg(F.map_from_entries(F.collect_list(F.struct("state", "kind"))).alias("_kinds"))  # a row, an entry a state
    share = [F.col("_all")[k] / total for k in range(states)]
    by = lambda kind: sum((F.when(F.col("_kinds")[k] == kind, share[k]).otherwise(0.0) for k in range(states)), F.lit(0.0))
    return agg.crossJoin(F.broadcast(of)).select(
        "cell_id",
        X.arg_max(F.col("_all")).alias("po_dominant"),
        X.arg_max(F.col("_day")).alias("po_dominant_day"),
        X.arg_max(F.col("_night")).alias("po_dominant_night"),
        by("residential").alias("po_res_share"),
        by("activity").alias("po_act_share"),
        *(s.alias(f"po_share_s{k}") for k, s in enumerate(share)),
    )


def switch_share(cells: DataFrame, day: str, night: str) -> DataFrame:
    """Per cent of cells whose dominant differs between day and night; one row."""
    return cells.agg((100.0 * F.avg((F.col(day) != F.col(night)).cast("double"))).alias("switch_pct"), F.count("*").alias("n"))


def split_table(cells: DataFrame, least: int = 20) -> DataFrame:
    """How each presence-only dominant state spreads over the dwell-aware regimes, for states of at least `least` cells."""
    n = cells.groupBy("po_dominant", "dominant_functional").agg(F.count("*").alias("n"), F.sum("share_residential").alias("r"), F.sum("share_activity_B").alias("b"))
    per = n.groupBy("po_dominant").agg(
        F.sum("n").alias("n_cells"),
        F.count("*").alias("n_regimes"),
        F.min_by("dominant_functional", F.struct(-F.col("n"), F.col("dominant_functional"))).alias("top_regime"),
        (F.sum("r") / F.sum("n")).alias("mean_share_residential"),
        (F.sum("b") / F.sum("n")).alias("mean_share_activityB"),
    )
    return per.where(F.col("n_cells") >= least)


def max_entropy(states: int) -> float:
    return math.log(states)
