"""Comparison of regimes with planned centres and places: concordance, thresholds, composition, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave import constants as C


def _is_activity():
    return F.col("dominant_functional").isin(C.ACTIVITY)


def _share(c):
    return F.avg(c.cast("double"))


def centre_concordance(cells: DataFrame, rule: float = 0.5) -> DataFrame:
    """One row a centre of cells(centre, tier, activity_share, dominant_functional): is more than `rule` of its cells activity?"""
    city = cells.agg(F.avg("activity_share").alias("_city"))
    per = cells.where("centre is not null").groupBy("centre", "tier").agg(F.avg("activity_share").alias("mean_act"), F.count("*").alias("n_cells"), _share(_is_activity()).alias("frac_act_dom"))
    return per.crossJoin(F.broadcast(city)).select(*per.columns, (F.col("frac_act_dom") > rule).alias("is_active"), (F.col("mean_act") > F.col("_city")).alias("above_city_mean"))  # one row


def tier_rank(tier="tier"):
    ranks = F.create_map(*(F.lit(x) for i, t in enumerate(C.TIERS) for x in (t, i)))
    return ranks[F.col(tier)]


def tier_concordance(concordance: DataFrame) -> DataFrame:
    return concordance.groupBy("tier").agg(
        F.count("*").alias("n_centers"),
        F.count_if("is_active").alias("n_active"),
        (100.0 * _share(F.col("is_active"))).alias("pct_active"),
        F.avg("mean_act").alias("mean_activity_share"),
        F.avg("frac_act_dom").alias("mean_frac_act_dom"),
        F.count_if("above_city_mean").alias("n_above_city_mean"),
        (100.0 * _share(F.col("above_city_mean"))).alias("pct_above_city_mean"),
    )


def planned_not_active(concordance: DataFrame) -> DataFrame:
    return concordance.where("not is_active").orderBy("frac_act_dom", "mean_act", "centre")


def active_not_planned(cells: DataFrame) -> DataFrame:
    """Activity cells, those outside any centre, and their share; one row."""
    a = cells.where(_is_activity())
    return a.agg(F.count("*").alias("n_activity_dom_cells"), F.count_if(F.col("centre").isNull()).alias("n_outside_any_center"), (100.0 * _share(F.col("centre").isNull())).alias("pct_outside"))


def emergent(cells: DataFrame) -> DataFrame:
    return cells.where(_is_activity() & F.col("centre").isNull())


def top_units(cells: DataFrame, unit, most: int = 15) -> DataFrame:
    """The units with the most cells, equal ones by code."""
    return cells.groupBy(unit.alias("unit")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit").limit(most)


def threshold_sensitivity(cells: DataFrame, thresholds: Sequence[float] = (0.3, 0.4, 0.5, 0.6)) -> DataFrame:
    """For each definition of a core cell: core cells, their share outside centres, and for each tier the share of active centres.

    A centre is active if its mean share reaches the definition's threshold or, for definitions without one, if over half of its cells are core.
    All definitions are rows of one plan. Quantiles are linear.
    """
    stats = cells.agg(F.avg("activity_share").alias("_m"), F.percentile("activity_share", F.lit(0.75)).alias("_q75"), F.percentile("activity_share", F.lit(0.9)).alias("_q90"))
    share = F.col("activity_share")
    none = F.lit(None).cast("double")
    defs = [F.struct(F.lit(f"abs_{t:g}").alias("def"), (share >= t).alias("core"), F.lit(t).alias("thr")) for t in thresholds]
    defs += [F.struct(F.lit("city_mean").alias("def"), (share >= F.col("_m")).alias("core"), F.col("_m").alias("thr"))]
    defs += [F.struct(F.lit(n).alias("def"), c.alias("core"), none.alias("thr")) for n, c in (("top_quartile", share >= F.col("_q75")), ("top_decile", share >= F.col("_q90")), ("dominant_activity", _is_activity()))]
    rows = cells.crossJoin(F.broadcast(stats)).select("*", F.explode(F.array(*defs)).alias("_d")).select("centre", "tier", "activity_share", "_d.*")  # one row
    core = rows.groupBy("def").agg(F.count_if("core").alias("n_core_cells"), (100.0 * F.count_if(F.col("core") & F.col("centre").isNull()) / F.nullif(F.count_if("core"), F.lit(0))).alias("outside_pct"))
    per = rows.where("centre is not null").groupBy("def", "centre", "tier").agg(F.avg("activity_share").alias("ma"), _share(F.col("core")).alias("fc"), F.max("thr").alias("thr"))
    active = F.when(F.col("thr").isNotNull(), F.col("ma") >= F.col("thr")).otherwise(F.col("fc") > 0.5)
    tiers = per.groupBy("def").agg(*(F.avg(F.when(F.col("tier") == t, (100.0 * active.cast("int")))).alias(f"tier{i}_active_pct") for i, t in enumerate(C.TIERS)))
    return core.join(tiers, "def", "left")


def category_composition(members: DataFrame, category: str, regimes: Sequence[str]) -> DataFrame:
    """Share of each dominant regime among the cells of each category; a cell may be a member of several places."""
    n = members.groupBy(category).pivot("dominant_functional", list(regimes)).agg(F.count(F.lit(1)))
    total = members.groupBy(category).agg(F.count("*").alias("_n"))
    return n.join(total, category).select(category, *((F.coalesce(F.col(f"`{r}`"), F.lit(0)) / F.col("_n")).alias(f"share_of_{r}") for r in regimes))


def category_metrics(members: DataFrame, category: str) -> DataFrame:
    return members.groupBy(category).agg(
        F.countDistinct("place").alias("n_places"),
        F.countDistinct("cell_id").alias("n_cells"),
        F.avg("activity_share").alias("mean_activity_share"),
        F.avg("share_residential").alias("mean_residential_share"),
        (100.0 * _share(_is_activity())).alias("pct_dom_activity"),
        (100.0 * _share(F.col("dominant_functional") == "residential")).alias("pct_dom_residential"),
    )


def overlap(a: DataFrame, b: DataFrame, key: str = "cell_id") -> DataFrame:
    """Distinct keys of a, and how many of them are in b; one row."""
    left, right = a.select(key).distinct(), b.select(key).distinct().withColumn("_in", F.lit(1))
    return left.join(right, key, "left").agg(F.count("*").alias("n"), F.count("_in").alias("n_in"), (100.0 * F.count("_in") / F.count("*")).alias("pct_in"))


def planning_gaps(members: DataFrame, most: float = 0.1) -> DataFrame:
    """Places of which less than `most` lies in centres, the largest first."""
    per = members.groupBy("place").agg(F.count("*").alias("n_cells"), _share(F.col("centre").isNotNull()).alias("frac_in_centre"), F.avg("activity_share").alias("mean_act"), _share(_is_activity()).alias("frac_act_dom"))
    return per.where(F.col("frac_in_centre") < most).orderBy(F.desc("n_cells"), "place")
