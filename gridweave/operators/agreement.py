"""Agreement of two labelings of the same rows, from their contingency table alone."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave import constants as C


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """n of each pair (a, b); with row and column sums and the total it is all that the indices need."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # over the pairs, not the rows
    return n.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b")), "total": F.sum("n").over(every)})


def _pairs(c):
    return c * (c - 1) / 2.0


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index; one row. 1 if both labelings are trivial."""
    c = contingency(df, a, b)
    s = c.agg(
        F.sum(_pairs(F.col("n"))).alias("ij"),
        F.sum(_pairs(F.col("na")) * F.col("n") / F.col("na")).alias("i"),
        F.sum(_pairs(F.col("nb")) * F.col("n") / F.col("nb")).alias("j"),
        F.max("total").alias("total"),
    )
    expected = F.col("i") * F.col("j") / _pairs(F.col("total"))
    most = (F.col("i") + F.col("j")) / 2
    return s.select(F.when(F.abs(most - expected) < 1e-12, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"), F.col("total").alias("n"))


def normalized_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the mean of the two entropies; one row."""
    c = contingency(df, a, b)
    p, pa, pb = (F.col(x) / F.col("total") for x in ("n", "na", "nb"))
    s = c.agg(F.sum(p * F.ln(p / (pa * pb))).alias("mi"), F.sum(-p * F.ln(pa)).alias("ha"), F.sum(-p * F.ln(pb)).alias("hb"), F.max("total").alias("n"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return s.select(F.when(mean > 1e-15, F.col("mi") / mean).otherwise(1.0).alias("nmi"), "n")


def best_assignment(matrix: np.ndarray) -> dict[int, int]:
    """Rows to columns with the greatest sum; for small matrices (the number of states), by shortest augmenting paths."""
    n, m = matrix.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = -matrix
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while match[j0]:
            used[j0] = True
            slack = cost[match[j0]] - u[match[j0]] - v
            slack[0] = np.inf
            better = ~used & (slack < least)
            least[better], way[better] = slack[better], j0
            free = np.flatnonzero(~used[1:]) + 1
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return {int(match[j]) - 1: j - 1 for j in range(1, m + 1) if match[j] <= n}


def best_assignment_exhaustive(matrix: np.ndarray) -> float:
    """The greatest sum by trying all permutations; for tests."""
    n = matrix.shape[0]
    return max(sum(matrix[i, p[i]] for i in range(n)) for p in permutations(range(matrix.shape[1]), n))


def hash_subset(rows: DataFrame, key: str, n: int, seed: int = C.SEED) -> DataFrame:
    """n rows by the order of a hash of their key: the same whatever the partitioning."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
