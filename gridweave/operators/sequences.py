"""Metrics of label sequences: change points, runs, durations, coherence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(labels: DataFrame, keys: Sequence[str], order: str, state: str = "state") -> DataFrame:
    """Adds changed (the state differs from the one before), seg (number of the run) and t (place in its sequence)."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(state).over(w)
    out = labels.withColumn("changed", F.coalesce(F.col(state) != before, F.lit(False)))
    return out.withColumn("seg", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.row_number().over(w) - 1)


def runs(labels: DataFrame, keys: Sequence[str], order: str, state: str = "state") -> DataFrame:
    """One row a run: its state, length, and whether it touches an end of its sequence."""
    c = changes(labels, keys, order, state).withColumn("_last", F.max("t").over(Window.partitionBy(*keys)))
    r = c.groupBy(*keys, "seg").agg(F.min(state).alias("state"), F.count("*").alias("length"), F.min("t").alias("start"), F.max("t").alias("end"), F.max("_last").alias("_last"))
    return r.withColumn("interior", (F.col("start") > 0) & (F.col("end") < F.col("_last"))).drop("_last")


def duration_pmf(run_rows: DataFrame, most: int) -> DataFrame:
    """p of each (state, duration) over interior runs of at most `most`."""
    n = run_rows.where(F.col("interior") & (F.col("length") <= most)).groupBy("state", F.col("length").alias("duration")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def coherence(labels: DataFrame, keys: Sequence[str], order: str, state: str = "state") -> DataFrame:
    """Share of steps that keep the state; one row."""
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = labels.select((F.col(state) == F.lag(state).over(w)).alias("same")).where("same is not null")
    return pairs.agg(F.avg(F.col("same").cast("double")).alias("coherence"), F.count("*").alias("n_steps"))


def geometric_pmf(stay: DataFrame, most: int) -> DataFrame:
    """Durations that a chain implies, from stay(state, a): a^(d-1) (1 - a), a kept off 0 and 1, over d up to `most`."""
    a = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("a")))
    d = stay.select("state", a.alias("a"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("duration"))
    d = d.withColumn("w", F.pow("a", F.col("duration") - 1) * (1 - F.col("a")))
    return d.select("state", "duration", (F.col("w") / F.sum("w").over(Window.partitionBy("state"))).alias("q"))


def duration_kl(empirical: DataFrame, implied: DataFrame, prior: DataFrame, most: int, eps: float = 1e-9) -> DataFrame:
    """Divergence of empirical(state, duration, p) from implied(state, duration, q), weighted by prior(state, w); states without runs are skipped. One row."""
    states = empirical.select("state").distinct().select("state", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("duration"))
    j = states.join(empirical.select("state", "duration", "p"), ["state", "duration"], "left").join(implied, ["state", "duration"], "left")
    j = j.select("state", (F.coalesce("p", F.lit(0.0)) + eps).alias("p"), (F.coalesce("q", F.lit(0.0)) + eps).alias("q"))
    per = j.groupBy("state").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    terms = j.join(per, "state").withColumns({"p": F.col("p") / F.col("_p"), "q": F.col("q") / F.col("_q")}).groupBy("state").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))
    share = prior.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy()))
    return terms.join(share, "state").agg(F.sum(F.col("w") * F.col("kl")).alias("duration_kl"))


def transitions(labels: DataFrame, keys: Sequence[str], order: str, state: str = "state") -> DataFrame:
    """n of each (src, dst) pair of successive states."""
    w = Window.partitionBy(*keys).orderBy(order)
    return labels.select(F.lag(state).over(w).alias("src"), F.col(state).alias("dst")).where("src is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def share_given_bin(labels: DataFrame, time_bin: str = "time_bin", state: str = "state") -> DataFrame:
    """n and share of each state in each bin."""
    n = labels.groupBy(time_bin, state).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(time_bin)))
