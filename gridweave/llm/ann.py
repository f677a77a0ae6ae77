"""Approximate nearest neighbours with a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then put into a leaf. A query takes nodes from a priority queue,
nearest centre first, until it has visited as many leaves as a calibration on the sample's own neighbours found necessary
for the wanted recall. Visited leaves meet their queries in units of bounded size (large leaves are dealt into blocks, the
queries of a leaf into chunks), distances are exact on the original vectors in double precision, and a query's best rows of all units are merged.

Equal vectors are one class with their k + 1 smallest ids, which is all that a result can hold of them; a class is searched
once however many queries share it. Defined results: vectors that are null, zero, of another size than the most common one (the larger of equally common ones), or
that hold null or non-finite components take no part, nor do rows without an id; of rows that share an id the one with the
least vector counts; with fewer candidates than k all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import settle

#: Vectors that the tree is fitted on at most, of a leaf in the sample, and rows and queries of a unit of work.
FIT, LEAF, FANOUT, BLOCK, CHUNK, CALIBRATION = 20_000, 24, 12, 4096, 512, 200


@dataclass
class Tree:
    """Nodes as arrays: centre, first child and number of children (0 for a leaf); `leaf` numbers the leaves."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest child, level by level."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.count[node] > 0)
            if not len(inner):
                return self.leaf[node]
            for n in np.unique(node[inner]):
                own = inner[node[inner] == n]
                kids = np.arange(self.first[n], self.first[n] + self.count[n])
                node[own] = kids[_squares(x[own], self.centre[kids]).argmin(1)]

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, n = heapq.heappop(heap)
            if not self.count[n]:
                out.append(int(self.leaf[n]))
                continue
            kids = range(self.first[n], self.first[n] + self.count[n])
            gap = self.centre[kids.start : kids.stop] - q
            for d, k in zip(np.einsum("ij,ij->i", gap, gap).tolist(), kids, strict=True):
                heapq.heappush(heap, (d, k))
        return out


def _matrix(vectors: list) -> np.ndarray:
    """Vectors as rows in double precision; no vectors are no rows of width 1."""
    return np.array(vectors, np.float64) if vectors else np.zeros((0, 1))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _squares(x, centre).argmin(1)
        size = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        some = size > 0
        centre = np.add.reduceat(x[order], starts[some], 0) / size[some][:, None]
        k = len(centre)
    return centre


def build(x: np.ndarray, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    centre, first, count, rows, at = [x.mean(0) if len(x) else np.zeros(1)], [0], [0], [np.arange(len(x))], 0
    while at < len(centre):
        own = rows[at]
        if len(own) > LEAF:
            kids = _kmeans(x[own], min(FANOUT, len(own)), rng)
            to = _squares(x[own], kids).argmin(1)
            used = np.unique(to)
            if len(used) > 1:
                first[at], count[at] = len(centre), len(used)
                for k in used:
                    centre.append(kids[k])
                    rows.append(own[to == k])
                    first.append(0)
                    count.append(0)
        at += 1
    count = np.array(count)
    leaf = np.where(count == 0, np.cumsum(count == 0) - 1, -1)
    return Tree(np.array(centre), np.array(first), count, leaf)


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit until the sample's own k nearest are found with the wanted mean recall."""
    if len(x) < 2:
        return 1
    leaves = int(tree.leaf.max()) + 1
    own, queries = tree.assign(x), np.linspace(0, len(x) - 1, min(CALIBRATION, len(x))).astype(int)
    needed = []
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(leaves, np.int64)
        place[tree.visits(x[q], leaves)] = np.arange(leaves)
        needed.append(place[own[near]] + 1)
    return int(np.quantile(np.concatenate(needed), recall, method="higher"))


def valid(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: Column, k: int = 10, recall: float = 0.97, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest; `queries` holds on the rows that ask.

    `queries` is a condition on the column vec_id. Candidates are all rows but the query's own.
    """
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].alias("x")).where(F.col("vec_id").isNotNull() & valid(F.col("x")))
    rows = rows.groupBy("vec_id").agg(F.min("x").alias("x"))
    size = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c")).agg(F.max(F.struct("c", "n")).alias("m")).first().m
    rows = settle(rows.where(F.size("x") == (size.n if size else 0)), "vectors")
    # The planner keeps k + 1 rows of a vector in each task before the shuffle.
    place = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    few = rows.withColumn("r", place).where(F.col("r") <= k + 1).drop("r")
    classes = few.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.col("ids")[0])
    classes = settle(classes, "classes")
    total = classes.count()
    at = F.pmod(F.xxhash64("class"), F.lit(1 << 40))
    some = classes if total <= FIT else classes.where(at < int(1.1 * FIT / total * (1 << 40))).orderBy(at, "class").limit(FIT)
    got = some.select("class", "x").toPandas().sort_values("class")
    sample = _matrix(got["x"].tolist())
    tree = build(sample)
    visits = calibrate(tree, sample, k, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1).to_pylist())
            leaf = shared.value.assign(x) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf, pa.int64())], names=["class", "leaf"])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1).to_pylist())
            found = [shared.value.visits(v, visits) for v in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["query", "leaves"])

    placed = classes.select("class", "x").mapInArrow(leaves, "class long, leaf long")
    placed = settle(placed.join(classes, "class"), "leaves")
    asks = settle(rows.where(queries).select(F.col("vec_id").alias("query_id"), "x").join(classes.select("x", "class"), "x").select("query_id", F.col("class").alias("query")), "asks")
    q = classes.join(asks.select(F.col("query").alias("class")).distinct(), "class", "left_semi").select("class", "x")
    q = settle(q, "queries")
    wanted = q.mapInArrow(bins, "query long, leaves array<long>").select("query", F.explode("leaves").alias("leaf"))
    wanted = settle(wanted.join(q.withColumnRenamed("class", "query"), "query"), "visits")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = wanted.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    units = settle(sizes.join(asked, "leaf"), "units")  # a row a leaf
    part = lambda column, n, salt: F.pmod(F.xxhash64(column, F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(units, "leaf").withColumn("block", part("class", "blocks", 1)).withColumn("chunk", every("chunks"))
    right = wanted.join(units, "leaf").withColumn("chunk", part("query", "chunks", 2)).withColumn("block", every("blocks"))
    keep = k + 1

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "class": [], "score": []}
        if len(a) and len(b):
            c, ids = np.array(a["x"].tolist(), np.float64), a["class"].to_numpy()
            for start in range(0, len(b), 64):
                part = b.iloc[start : start + 64]
                y = np.array(part["x"].tolist(), np.float64)
                d = _squares(y, c)
                for i, query in enumerate(part["query"].tolist()):
                    own = np.arange(len(c))
                    if len(c) > keep:  # the products only choose; what they choose is measured on the vectors
                        own = np.flatnonzero(d[i] <= np.partition(d[i], keep - 1)[keep - 1] + 1e-9 * (1 + (y[i] ** 2).sum() + (c**2).sum(1).max()))
                    exact = np.sqrt(((c[own] - y[i]) ** 2).sum(1))
                    best = np.lexsort((ids[own], exact))[:keep]
                    out["query"] += [query] * len(best)
                    out["class"] += ids[own][best].tolist()
                    out["score"] += exact[best].tolist()
        return pd.DataFrame({"query": np.array(out["query"], np.int64), "class": np.array(out["class"], np.int64), "score": np.array(out["score"], np.float64)})

    unit = ["leaf", "block", "chunk"]
    met = left.select(*unit, "class", "x").groupBy(*unit).cogroup(right.select(*unit, "query", "x").groupBy(*unit)).applyInPandas(meet, "query long, class long, score double")
    top = lambda df, by, order, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)
    best = top(met, "query", ["score", "class"], keep).drop("rank")
    best = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    best = settle(top(best, "query", ["score", "vec_id"], keep).drop("rank"), "best")
    named = asks.join(best, "query").where("vec_id != query_id")
    return top(named, "query_id", ["score", "vec_id"], k).select("query_id", "rank", "vec_id", "score")
