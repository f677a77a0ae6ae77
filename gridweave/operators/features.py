"""Presence and dwell features, compositional transforms and model inputs, as DataFrame expressions.

Shapes: presence and dwell are aggregated to (cell, date, bin) before they are joined on just these keys, so the join needs
no exchange of its own; statistics that later steps apply are one row and reach them by a broadcast of that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.functions import columns as X
from gridweave.operators.cells import quantiles

KEYS = ["cell_id", "date", "time_bin"]


def harmonise(df: DataFrame) -> DataFrame:
    """14 age bands of each sex to 8; masked counts are 0 here."""
    return df.withColumns({f"b_{s}{b}": X.sum_of(*(F.col(f"{s}_{p}") for p in parts)) for s in C.SEXES for b, parts in C.TEN_YEAR_BANDS.items()})


def presence(living: DataFrame, cell: str = "grid_id", cells: DataFrame | None = None) -> DataFrame:
    """Features of presence by cell, date and bin.

    The mean of totals skips masked hours, bands count masked hours as 0; a bin without any total is left out; without any
    band's count the mix is null. `cells` (one column cell_id) keeps these cells only.
    """
    rows = living.withColumnRenamed(cell, "cell_id")
    if cells is not None:
        rows = rows.join(cells.select("cell_id"), "cell_id", "left_semi")
    bands = [f"b_{s}{b}" for s in C.SEXES for b in C.TEN_YEAR_BANDS]
    agg = (
        harmonise(rows)
        .withColumn("time_bin", X.time_bin(F.col("hour")))
        .groupBy(*KEYS)
        .agg(F.avg("total_pop").alias("mean_total_pop"), F.count("total_pop").alias("presence_n_hours"), *(F.avg(b).alias(b) for b in bands))
        .where("mean_total_pop is not null")
        .withColumn("_bands", X.sum_of(*(F.col(b) for b in bands)))
    )
    mix = [X.ratio(F.col(b), F.col("_bands")).alias(m) for b, m in zip(bands, C.MIX, strict=True)]
    return agg.select(*KEYS, F.log1p("mean_total_pop").alias("presence_log"), "mean_total_pop", "presence_n_hours", (F.col("_bands") <= 0).alias("presence_demo_masked"), *mix)


def dwell(stay: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Features of dwell by cell, date and start bin; all shares are null where every count is masked."""
    rows = stay if cells is None else stay.join(cells.select("cell_id"), "cell_id", "left_semi")
    agg = rows.groupBy("cell_id", "date", F.col("start_tz").alias("time_bin")).agg(
        X.zero_sum(F.col("total")).alias("_all"),
        F.count("total").alias("dwell_n_codes"),
        *(X.zero_sum(F.when(F.col("stay_dur") == c, F.col("total"))).alias(f"_v{c}") for c in C.DWELL_CODES),
    )
    shares = [X.ratio(F.col(f"_v{c}"), F.col("_all")).alias(d) for c, d in zip(C.DWELL_CODES, C.DWELL, strict=True)]
    out = agg.select(*KEYS, *shares, F.when(F.col("_all") > 0, F.log1p("_all")).alias("stay_vol_log"), "dwell_n_codes", (F.col("dwell_n_codes") <= 1).alias("dwell_heavy_masked"))
    return out.withColumns({"short_share": F.col("dwell_share_000"), "long_share": F.col("dwell_share_240")})


def split_of(date_month, train_max: str = C.TRAIN_MAX):
    return F.when(date_month <= train_max, F.lit("train")).otherwise(F.lit("holdout"))


def emission(presence_rows: DataFrame, dwell_rows: DataFrame, split) -> DataFrame:
    """Presence with the dwell of the same cell, date and bin where there is any."""
    e = presence_rows.withColumn("split", split).join(dwell_rows, KEYS, "left").withColumn("dwell_present", F.col("stay_vol_log").isNotNull())
    order = [*KEYS, "split", "presence_log", "mean_total_pop", "presence_n_hours", "presence_demo_masked", *C.MIX, *C.DWELL]
    return e.select(*order, "short_share", "long_share", "stay_vol_log", "dwell_n_codes", "dwell_heavy_masked", "dwell_present")


def scaler(em: DataFrame, features: Sequence[str] = ("presence_log", "stay_vol_log")) -> DataFrame:
    """feature, mean, std (n - 1) and n_train over the training rows, in one pass."""
    train = em.where(F.col("split") == "train")
    row = train.agg(*(x for f in features for x in (F.avg(f).alias(f"{f}_m"), F.stddev_samp(f).alias(f"{f}_s"), F.count(f).alias(f"{f}_n"))))
    parts = ", ".join(f"'{f}', {f}_m, {f}_s, {f}_n" for f in features)
    return row.selectExpr(f"stack({len(features)}, {parts}) as (feature, mean, std, n_train)")


def full_cycles(rows: DataFrame, bins: int = len(C.TIME_BINS), keys: Sequence[str] = ("cell_id", "date")) -> DataFrame:
    """Rows of the (cell, date) groups that have exactly `bins` rows: a count over a window, not a join back."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") == bins).drop("_n")


def sample_keys(keys: DataFrame, n: dict[str, int], seed: int = C.SEED) -> DataFrame:
    """n keys of each split, by the order of a hash: the same whatever the partitioning."""
    out = None
    for split, most in n.items():
        own = keys.where(F.col("split") == split).orderBy(F.md5(F.concat_ws("|", "cell_id", F.col("date").cast("string"), F.lit(str(seed)))), "cell_id", "date").limit(most)
        out = own if out is None else out.unionByName(own)
    return out


def missing_masks(em: DataFrame) -> DataFrame:
    any_null = lambda cols: F.greatest(*(F.col(c).isNull().cast("int") for c in cols)) == 1
    return em.withColumns({"mix_missing": F.col("presence_demo_masked") | any_null(C.MIX), "dwell_missing": ~F.col("dwell_present") | any_null(C.DWELL)})


BLOCKS = {"clr_mix": C.MIX, "clr_dwell": C.DWELL}
_PARTS = [f"{b}_{i}" for b, parts in BLOCKS.items() for i in range(len(parts))]


def with_clr(em: DataFrame, delta: float = C.ZERO_REPLACEMENT) -> DataFrame:
    """Adds clr_mix_0 .. and clr_dwell_0 .., the centred log-ratios of the parts, null where a composition is missing.

    Zeros, logarithms and their mean are columns of their own, so that generated code computes each of them once a row.
    """
    m = missing_masks(em)
    zeros = {f"_{b}_z": sum((F.when(F.col(p) == 0, 1).otherwise(0) for p in parts), F.lit(0)) for b, parts in BLOCKS.items()}
    logs = {f"_{b}_{i}": F.ln(F.when(F.col(p) == 0, F.lit(delta)).otherwise(F.col(p) * (1 - F.col(f"_{b}_z") * delta))) for b, parts in BLOCKS.items() for i, p in enumerate(parts)}
    means = {f"_{b}_m": sum((F.col(f"_{b}_{i}") for i in range(len(parts))), F.lit(0.0)) / len(parts) for b, parts in BLOCKS.items()}
    out = {f"{b}_{i}": F.when(~F.col("mix_missing" if b == "clr_mix" else "dwell_missing"), F.col(f"_{b}_{i}") - F.col(f"_{b}_m")) for b, parts in BLOCKS.items() for i in range(len(parts))}
    return m.withColumns(zeros).withColumns(logs).withColumns(means).withColumns(out).drop(*zeros, *logs, *means)


def fit_transform_parameters(em: DataFrame) -> DataFrame:
    """One row: means of the log-ratios over complete training rows, and mean and deviation (n) over training rows after missing ones got these means; mean and deviation (n - 1) of the logarithms.

    A column's imputed values equal its mean, so the second pair follows from sums of the complete rows alone: one pass.
    """
    t = with_clr(em.where(F.col("split") == "train"))
    aggs = [F.count("*").alias("n_rows")]
    for p in _PARTS:
        # Deviations of imputed rows are 0, so their variance is the complete rows' sum of squares over all rows.
        aggs += [F.avg(p).alias(f"{p}_m"), F.sqrt(F.var_pop(p) * F.count(p) / F.count("*")).alias(f"{p}_s")]
    for f in ("presence_log", "stay_vol_log"):
        aggs += [F.avg(f).alias(f"{f}_m"), F.stddev_samp(f).alias(f"{f}_s")]
    return t.agg(*aggs)


def model_rows(em: DataFrame, parameters: DataFrame) -> DataFrame:
    """Keys with x, the feature vector of FEATURES, for training and new rows alike. parameters is the row of fit_transform_parameters."""
    t = with_clr(em).crossJoin(F.broadcast(parameters))  # one row
    z = []
    for p in _PARTS:
        m, s = F.col(f"{p}_m"), F.col(f"{p}_s")
        z.append((F.coalesce(F.col(p), m) - m) / F.when(s > 0, s).otherwise(1.0))
    presence_z = (F.col("presence_log") - F.col("presence_log_m")) / F.col("presence_log_s")
    stay_z = F.when(F.col("dwell_missing"), 0.0).otherwise((F.col("stay_vol_log") - F.col("stay_vol_log_m")) / F.col("stay_vol_log_s"))
    x = F.array(presence_z, stay_z, *z, F.col("dwell_missing").cast("double"), F.col("mix_missing").cast("double"))
    return t.select(*KEYS, "split", X.bin_rank(F.col("time_bin")).alias("tb_rank"), x.alias("x"))


def presence_only_rows(em: DataFrame, parameters: DataFrame) -> DataFrame:
    """Keys with x, the 18 features without dwell: presence, the mix and its mask."""
    n = len(C.MIX)
    full = model_rows(em, parameters)
    x = F.concat(F.slice("x", 1, 1), F.slice("x", 3, n), F.slice("x", len(C.FEATURES), 1))
    return full.withColumn("x", x)


def sequences(rows: DataFrame) -> DataFrame:
    """One row a (cell, date): x, its feature vectors in the order of bins, in single precision."""
    seq = rows.groupBy("cell_id", "date", "split").agg(F.array_sort(F.collect_list(F.struct("tb_rank", "x"))).alias("_s"))
    return seq.select("cell_id", "date", "split", X.year_month(F.col("date")).alias("year_month"), F.transform("_s", lambda s: s["x"].cast("array<float>")).alias("x"))


def quantile_edges(rows: DataFrame, features: int, bins: int = 5) -> DataFrame:
    """j and edges, the inner quantiles (linear) of each of the first features of x."""
    long = rows.select(F.posexplode(F.slice("x", 1, features)).alias("j", "v"))
    return quantiles(long, "j", "v", [k / bins for k in range(1, bins)]).withColumnRenamed("q", "edges")


def tokens(rows: DataFrame, edges: DataFrame, features: int, bins: int = 5, indicators: int = 2) -> DataFrame:
    """Adds tokens: for each feature j * bins + the number of edges at most its value, and one token for each indicator that is set."""
    table = edges.agg(F.array_sort(F.collect_list(F.struct("j", "edges"))).alias("_e"))  # one row, `features` entries
    t = rows.crossJoin(F.broadcast(table))
    binned = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda j: (j * bins + F.size(F.filter(F.element_at(F.col("_e"), j + 1)["edges"], lambda e: e <= F.element_at(F.col("x"), j + 1)))).cast("int"))
    flags = F.filter(F.array(*(F.when(F.element_at(F.col("x"), features + i + 1) > 0.5, F.lit(features * bins + i)) for i in range(indicators))), lambda v: v.isNotNull())
    return t.withColumn("tokens", F.concat(binned, flags)).drop("_e")
