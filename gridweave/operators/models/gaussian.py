"""What the sequence models share: emissions, starting points, and sums of statistics over batches of sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INIT_ROWS = 60_000
MIN_COVAR = 1e-3


def log_emission(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Log density of each step under each state's diagonal normal: (..., D) to (..., K)."""
    const = -0.5 * (x.shape[-1] * np.log(2 * np.pi) + np.log(variances).sum(1))
    # Expanded squares: three products instead of an array with a state axis and a feature axis.
    w = 1 / variances
    return const - 0.5 * ((x * x) @ w.T - 2 * x @ (means * w).T + (means * means * w).sum(1))


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def by_length(column: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and tensors (n, T, D) of a batch's sequences, those of equal length together."""
    lengths = column.map(len).to_numpy()
    for t in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == t)
        yield own, np.stack([np.stack(column.iloc[i]) for i in own]).astype(np.float64)


def start_means(sequences: DataFrame, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """k cluster centres of a sample of some INIT_ROWS steps, chosen by their hash whatever the partitioning, and the variance of each feature; zeros if there is no step."""
    steps = sequences.select(F.explode("x").alias("x"))
    n = steps.count()
    if not n:
        return np.zeros((k, 1)), np.zeros(1)
    some = steps.where(F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1 << 40)) < int(INIT_ROWS / n * (1 << 40))) if n > INIT_ROWS else steps
    some = some.orderBy(F.xxhash64("x", F.lit(seed))).select(array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    means = np.array(KMeans(k=k, seed=seed, initSteps=3, maxIter=20).fit(some).clusterCenters())
    while len(means) < k:  # fewer distinct steps than states
        means = np.vstack([means, means[:1] + 1e-3 * (len(means) + 1)])
    d = means.shape[1]
    x = F.col("x")
    row = steps.agg(*(F.var_pop(x[j].cast("double")).alias(f"v{j}") for j in range(d))).first()
    return means, np.array([row[j] or 0.0 for j in range(d)])


def summed(sequences: DataFrame, statistics: Callable[[np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over all sequences of arrays that `statistics` makes from a tensor (n, T, D).

    Each batch becomes a few rows, one an array, which an aggregation adds up by name; what reaches the driver has the size of the parameters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for _, x in by_length(b["x"]):
                for name, a in statistics(x).items():
                    total[name] = total[name] + a if name in total else np.asarray(a, np.float64)
        if total:
            yield pd.DataFrame({"name": list(total), "shape": [list(a.shape) for a in total.values()], "values": [a.ravel().tolist() for a in total.values()]})

    parts = sequences.select("x").mapInPandas(run, "name string, shape array<int>, values array<double>")
    long = parts.select("name", "shape", F.posexplode("values").alias("i", "v")).groupBy("name", "shape", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for name, rows in long.toPandas().groupby("name"):
        a = np.zeros(len(rows))
        a[rows["i"].to_numpy()] = rows["v"].to_numpy()
        out[str(name)] = a.reshape(list(rows["shape"].iloc[0]))
    return out


def per_sequence(sequences: DataFrame, keys: list[str], columns: str, run: Callable[[np.ndarray], list[list]]) -> DataFrame:
    """keys with columns that `run` makes for each sequence of a tensor."""
    names = [c.split()[0] for c in columns.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[list] = [[None] * len(b) for _ in names]
            for own, x in by_length(b["x"]):
                for col, values in zip(out, run(x), strict=True):
                    for i, v in zip(own, values, strict=True):
                        col[i] = v
            if len(b):
                yield pd.DataFrame({**{k: b[k] for k in keys}, **dict(zip(names, out, strict=True))})

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sequences.select(*keys).schema)
    return sequences.select(*keys, "x").mapInPandas(each, f"{ddl}, {columns}")
