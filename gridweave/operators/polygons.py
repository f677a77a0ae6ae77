"""Point in polygon on rings of vertices, with plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a polygon layer up to which it may be broadcast; beyond, points and polygons meet in tiles of the plane.
BROADCAST_POLYGONS = 10_000


def _edges(ring: Column) -> Column:
    n = F.size(ring) - 1
    return F.transform(F.slice(ring, 1, n), lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.element_at(ring, i + 2)["x"].alias("x2"), F.element_at(ring, i + 2)["y"].alias("y2")))


def within(x: Column, y: Column, rings: Column) -> Column:
    """Is the point inside by the even-odd rule over all rings (closed), points on an edge being outside."""
    edges = F.flatten(F.transform(rings, _edges))
    cross = lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])
    on_edge = F.exists(edges, lambda e: (cross(e) == 0) & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"])) & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"])))
    crossed = F.aggregate(edges, F.lit(0), lambda a, e: a + F.when(((e["y1"] > y) != (e["y2"] > y)) & (((e["y2"] > e["y1"]) & (cross(e) > 0)) | ((e["y2"] < e["y1"]) & (cross(e) < 0))), 1).otherwise(0))
    return ~on_edge & (crossed % 2 == 1)


def with_box(polygons: DataFrame) -> DataFrame:
    xs, ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["x"]))), F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["y"])))
    return polygons.withColumns({"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})


def join_within(points: DataFrame, polygons: DataFrame, x: str = "utm_x", y: str = "utm_y", tile: float = 5_000.0) -> DataFrame:
    """All pairs of a point and a polygon that holds it; polygons has ord (their order) and rings.

    Both sides meet in tiles of the plane: a polygon is repeated for each tile that its box touches, so the join is an
    equi-join whatever the sizes; few polygons are broadcast.
    """
    boxed = with_box(polygons)
    index = lambda c: F.floor(c / tile).cast("int")
    tiles = boxed.withColumn("_tx", F.explode(F.sequence(index(F.col("_x0")), index(F.col("_x1"))))).withColumn("_ty", F.explode(F.sequence(index(F.col("_y0")), index(F.col("_y1")))))
    few = polygons.count() <= BROADCAST_POLYGONS
    at = points.withColumns({"_tx": index(F.col(x)), "_ty": index(F.col(y))})
    j = at.join(F.broadcast(tiles) if few else tiles, ["_tx", "_ty"])
    box = (F.col(x) >= F.col("_x0")) & (F.col(x) <= F.col("_x1")) & (F.col(y) >= F.col("_y0")) & (F.col(y) <= F.col("_y1"))
    return j.where(box & within(F.col(x), F.col(y), F.col("rings"))).drop("_tx", "_ty", "_x0", "_x1", "_y0", "_y1", "rings")


def first_within(points: DataFrame, polygons: DataFrame, key: str, columns: list[str], x: str = "utm_x", y: str = "utm_y") -> DataFrame:
    """points with the columns of the first polygon (by ord) that holds each, null if none does, and the number of such polygons."""
    hit = join_within(points.select(key, x, y), polygons.select("ord", "rings", *columns), x, y)
    first = hit.groupBy(key).agg(F.min_by(F.struct(*columns), "ord").alias("_f"), F.count("*").alias("n_hits"))
    return points.join(first, key, "left").select(*points.columns, *(F.col(f"_f.{c}").alias(c) for c in columns), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def bounds(polygons: DataFrame) -> DataFrame:
    b = with_box(polygons)
    return b.agg(F.min("_x0").alias("x0"), F.min("_y0").alias("y0"), F.max("_x1").alias("x1"), F.max("_y1").alias("y1"))


def overlay_ok(inner: DataFrame, outer: DataFrame, slack: float = 5_000.0) -> DataFrame:
    """Does the first layer's box lie in the second's, with some slack; one row."""
    a, b = bounds(inner), bounds(outer).toDF("a0", "b0", "a1", "b1")
    return a.crossJoin(b).select("x0", "y0", "x1", "y1", ((F.col("x0") > F.col("a0") - slack) & (F.col("x1") < F.col("a1") + slack) & (F.col("y0") > F.col("b0") - slack) & (F.col("y1") < F.col("b1") + slack)).alias("overlay_ok"))
