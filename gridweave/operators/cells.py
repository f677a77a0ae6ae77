"""The table of cells, dwell summaries and accounting of ingested tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.functions import columns as X


def modal(df: DataFrame, key: str, category: str, name: str | None = None) -> DataFrame:
    """The most frequent category of each key; ties go to the smallest."""
    n = df.groupBy(key, category).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.min_by(category, F.struct(-F.col("_n"), F.col(category))).alias(name or category))


def cell_master(living: DataFrame, stay: DataFrame, coordinates: DataFrame, units: DataFrame | None = None, universe: float = C.UNIVERSE_THRESHOLD) -> DataFrame:
    """One row a cell of living(grid_id, total_pop[, admin_dong]).

    The area is the most frequent one (or comes from units(cell_id, admin_dong)); coordinates come from coordinates(cell_id, utm_x, utm_y) and else
    from stay's own columns, if it has any; a cell of the universe is in stay and its mean reaches the threshold.
    """
    cells = living.groupBy(F.col("grid_id").alias("cell_id")).agg(F.avg("total_pop").alias("mean_total_pop"), F.count("total_pop").alias("n_nonnull_obs"), F.count("*").alias("n_rows"))
    admin = units.select("cell_id", "admin_dong") if units is not None else modal(living.withColumnRenamed("grid_id", "cell_id"), "cell_id", "admin_dong")
    fallback = [F.min(c).alias(f"_{c}") if c in stay.columns else F.lit(None).cast("double").alias(f"_{c}") for c in ("utm_x", "utm_y")]
    in_stay = stay.groupBy("cell_id").agg(F.lit(True).alias("_in"), *fallback)
    m = cells.join(admin, "cell_id", "left").join(coordinates.select("cell_id", "utm_x", "utm_y"), "cell_id", "left").join(in_stay, "cell_id", "left")
    m = m.withColumns({"utm_x": F.coalesce("utm_x", "_utm_x"), "utm_y": F.coalesce("utm_y", "_utm_y"), "in_stay": F.coalesce("_in", F.lit(False)), **X.threshold_flags(F.col("mean_total_pop"))})
    m = m.withColumn("in_universe", F.col("in_stay") & (F.col("mean_total_pop") >= universe))
    return m.drop("_in", "_utm_x", "_utm_y")


def master_counts(master: DataFrame) -> DataFrame:
    """One row: how many cells hold each flag."""
    on = lambda c: F.count_if(c)
    return master.agg(
        F.count("*").alias("living_any"),
        on(F.col("in_stay")).alias("intersection"),
        *(on(F.col(f"active_{t}")).alias(f"active_{t}_all") for t in (25, 50, 100)),
        *(on(F.col("in_stay") & F.col(f"active_{t}")).alias(f"intersection_active_{t}") for t in (25, 50, 100)),
        on(F.col("utm_x").isNull()).alias("coords_missing"),
        on(F.col("admin_dong").isNull()).alias("admin_missing"),
        on(F.col("in_universe")).alias("universe"),
    )


def dwell_shares(stay: DataFrame) -> DataFrame:
    """Each dwell code's share of the people, in the order of codes; a code without rows has 0."""
    spark = stay.sparkSession
    codes = spark.createDataFrame([(i, c) for i, c in enumerate(C.DWELL_CODES)], "ord int, stay_dur string")
    sums = stay.groupBy("stay_dur").agg(X.zero_sum(F.col("total")).alias("pop"))
    total = sums.agg(F.sum("pop").alias("_all"))
    joined = F.broadcast(codes).join(sums, "stay_dur", "left").crossJoin(F.broadcast(total))  # six rows and one
    return joined.select("ord", "stay_dur", F.coalesce(F.col("pop") / F.col("_all"), F.lit(0.0)).alias("share"))


def dwell_by_bin(stay: DataFrame) -> DataFrame:
    """People by dwell code and start bin, one column for each of the 19 bins."""
    wide = stay.groupBy("stay_dur").pivot("start_tz", C.TIME_BINS).agg(F.sum("total"))
    return wide.select("stay_dur", *(F.coalesce(F.col(f"`{b}`"), F.lit(0.0)).alias(f"tz_{b}") for b in C.TIME_BINS))


def ingest_accounting(df: DataFrame, month: Column, grid: str, total: str, demo: list[str]) -> DataFrame:
    """Rows, days, grids, date range and masked counts of each month, in one aggregation."""
    nulls = sum((F.col(c).isNull().cast("long") for c in demo), F.lit(0).cast("long"))
    per = df.groupBy(month.alias("year_month")).agg(
        F.count("*").alias("rows"),
        F.countDistinct("date").alias("n_days"),
        F.countDistinct(grid).alias("uniq_grid"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        (F.sum(nulls) * 100.0 / (F.count("*") * len(demo))).alias("demo_null_pct"),
        F.count_if(F.col(total).isNull()).alias("total_null"),
    )
    days = df.groupBy(month.alias("year_month"), "date").agg(F.count("*").alias("n")).groupBy("year_month").agg(F.min("n").alias("rows_per_day_min"), F.max("n").alias("rows_per_day_max"))
    return per.join(days, "year_month")


def quantiles(long: DataFrame, key: str, value: str, probabilities: Sequence[float], nearest: bool = False, accuracy: int = 10_000) -> DataFrame:
    """key and q, the exact quantiles of value for each key: linear ones, or (nearest) the values at the nearest ranks, halves to even.

    No task sees all values of a key: a first pass brackets each quantile between approximate ones, a second counts what lies below a
    bracket and collects only what lies in it, some 4 / accuracy of the values. Keys with at most `accuracy` values are one bracket.
    """
    long = long.where(F.col(value).isNotNull())
    at = lambda q, side: min(max(q + side * 2 / accuracy, 0.0), 1.0)
    marks = F.percentile_approx(value, [at(q, s) for q in probabilities for s in (-1, 1)], accuracy)
    found = long.groupBy(key).agg(marks.alias("_m"), F.count("*").alias("_n"))
    few, inf = F.col("_n") <= accuracy, F.lit(float("inf"))
    bracket = lambda i: F.struct(F.lit(i).alias("i"), F.when(few, -inf).otherwise(F.col("_m")[2 * i]).alias("lo"), F.when(few, inf).otherwise(F.col("_m")[2 * i + 1]).alias("hi"))
    brackets = found.select(key, "_n", F.explode(F.array(*map(bracket, range(len(probabilities))))).alias("_b"))
    own = long.join(brackets, key).groupBy(key, "_b.i").agg(
        F.count_if(F.col(value) < F.col("_b.lo")).alias("_below"),
        F.sort_array(F.collect_list(F.when((F.col(value) >= F.col("_b.lo")) & (F.col(value) <= F.col("_b.hi")), F.col(value)))).alias("_v"),
        F.max("_n").alias("_n"),
    )
    place = F.element_at(F.array(*map(F.lit, probabilities)), F.col("i") + 1) * (F.col("_n") - 1)
    if nearest:
        q = F.element_at("_v", (F.rint(place) - F.col("_below") + 1).cast("int"))
    else:
        low = F.floor(place)
        a = F.element_at("_v", (low - F.col("_below") + 1).cast("int"))
        b = F.element_at("_v", F.least(low - F.col("_below") + 2, F.size("_v")).cast("int"))
        q = a + (b - a) * (place - low)
    return own.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda s: s["q"]).alias("q"))


def quantile_nearest(df: DataFrame, column: str, q: float) -> DataFrame:
    """The value at the nearest rank to q * (n - 1), halves to the even rank; one row, none for a table without values."""
    one = quantiles(df.select(F.lit(0).alias("_k"), column), "_k", column, [q], nearest=True)
    return one.select(F.element_at("q", 1).alias("value"))
