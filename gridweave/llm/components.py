"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import drop_settled, settle


#: Edges that one task may take instead (some 100 bytes each).
FEW = 500_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The same result for at most FEW edges: union by the smaller root, in one task."""
    kind = {"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[edges.schema["u"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root.get(x, x)
            return top

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                root.setdefault(x, x)
                root.setdefault(y, y)
                root[max(x, y)] = min(x, y)
        rows = [(x, top) for x in root if (top := find(x)) != x]
        for i in range(0, len(rows), 50_000):
            us, vs = zip(*rows[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(us, kind), pa.array(vs, kind)], names=["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, edges.select("u", "v").schema)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node but the smallest of its component, with that smallest node.

    Edges are (u, v) in any direction and may repeat; loops count for nothing, rows with a null end are left out. A round
    joins every edge with the least neighbour of its end, found by an aggregation with partial results, so a hub costs a
    row per edge; skewed joins are split by the adaptive planner. The number of rounds grows with the logarithm of the nodes.
    At most FEW edges take one task instead, which spares small inputs the rounds.
    """
    e = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(e)
    if 0 < mark[0] <= FEW:
        return settle(_in_one_task(e), "cc")
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = settle(large.where("u != v").distinct(), "cc")  # v < u holds: the least neighbour of v's neighbour is at most v's
        down = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v"))
        new = settle(small.where("u != v").distinct(), "cc")
        drop_settled(e, big)
        e, (was, mark) = new, (mark, _mark(new))
        if was == mark:
            break
    return e
