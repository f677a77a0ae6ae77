"""Regressions, correlations and contingency tests: sums in Spark, tails of distributions on the one row they give."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import special


def _finite(*columns: str):
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return ok


def _with_p(one: DataFrame, p, *inputs: str) -> DataFrame:
    """Adds p, a function of some columns, to a result of one row; null where one of them is."""

    def run(batches):
        for b in batches:
            known = b[list(inputs)].notna().all(axis=1)
            yield b.assign(p=[p(*(b[c].iloc[i] for c in inputs)) if known.iloc[i] else None for i in range(len(b))])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema)
    return one.mapInPandas(run, f"{types}, p double")


def linear_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, r, r2, slope and intercept of y on x over rows where both are finite, and the slope's two-sided p; one row."""
    d = df.where(_finite(x, y))
    return _with_p(_line(d, x, y), regression_p, "n", "r")


def regressions(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """linear_regression for each key; a row a key."""
    return _with_p(_line(df.where(_finite(x, y)).groupBy(key), x, y), regression_p, "n", "r")


def _line(d, x: str, y: str) -> DataFrame:
    return d.agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_r2(y, x).alias("r2"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def regression_p(n: int, r: float) -> float:
    """Two-sided p of a correlation; undefined for less than three rows."""
    return special.t_two_sided(r * np.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2)


def partial_correlation(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """n, raw_r and partial_r of x and y given z, t and its two-sided p; one row."""
    c = df.where(_finite(x, y, z)).agg(F.count("*").alias("n"), F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    pr = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    out = c.select("n", F.col("xy").alias("raw_r"), pr.alias("partial_r"))
    return _with_p(out.withColumn("t", F.col("partial_r") * F.sqrt((F.col("n") - 3) / (1 - F.col("partial_r") * F.col("partial_r")))), partial_p, "n", "t")


def partial_p(n: int, t: float) -> float:
    return special.t_two_sided(t, n - 3)


def multiple_r2(df: DataFrame, xs: Sequence[str], y: str) -> dict[str, float]:
    """R2 and adjusted R2 of y on xs. The sums of products come from one aggregation; collinear columns are allowed."""
    names = ["_one", *xs, y]
    d = df.where(_finite(*xs, y)).withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = d.agg(*(F.sum(F.col(names[i]).cast("double") * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs)).first()
    g = np.zeros((len(names), len(names)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"s{i}_{j}"] or 0.0
    n = float(g[0, 0])
    # Centred products, so that the pseudo-inverse doesn't see the size of the means.
    c = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / max(n, 1)
    k = len(xs)
    scale = np.sqrt(np.maximum(np.diag(c)[:k], 1e-300))
    beta = np.linalg.pinv(c[:k, :k] / np.outer(scale, scale), rcond=1e-10) @ (c[:k, k] / scale)
    r2 = float(beta @ (c[:k, k] / scale) / c[k, k])
    return {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k - 1), "n": int(n), "k": k}


def chi_squared(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, dof, n, Cramer's V and p of the table of two categories (Yates' correction with one degree of freedom); one row."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra, cb = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    # All cells of the table, empty ones too; its sides are categories, not rows.
    full = ra.crossJoin(cb).join(n, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = Window.partitionBy()
    full = full.withColumns({"total": F.sum("n").over(every), "e": F.col("na") * F.col("nb") / F.sum("n").over(every)})
    s = full.agg(
        F.sum(F.pow(F.col("n") - F.col("e"), F.lit(2.0)) / F.col("e")).alias("plain"),
        F.sum(F.pow(F.greatest(F.abs(F.col("n") - F.col("e")) - 0.5, F.lit(0.0)), F.lit(2.0)) / F.col("e")).alias("yates"),
        F.countDistinct("a").alias("ka"),
        F.countDistinct("b").alias("kb"),
        F.max("total").alias("n"),
    )
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    chi2 = F.when(dof == 1, F.col("yates")).otherwise(F.col("plain"))
    out = s.select(chi2.alias("chi2"), dof.alias("dof"), "n", F.sqrt(chi2 / (F.col("n") * (F.least("ka", "kb") - 1))).alias("cramers_v"))
    return _with_p(out, special.chi2_upper, "chi2", "dof")


def permutation_p(at_least: int, replicates: int) -> float:
    return (at_least + 1) / (replicates + 1)


def information_criterion(log_likelihood: float, parameters: int, n: int) -> float:
    return -2 * log_likelihood + parameters * float(np.log(n))


def perplexity(df: DataFrame, log_likelihood: str, steps: str) -> DataFrame:
    """exp of minus the mean log-likelihood of a step; one row."""
    return df.agg(F.exp(-F.sum(log_likelihood) / F.sum(steps)).alias("perplexity"))
