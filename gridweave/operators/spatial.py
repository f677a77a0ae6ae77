"""Neighbourhoods on the grid, spatial autocorrelation, permutation and shift nulls, connected areas.

Neighbourhoods are equi-joins: each cell is exploded by the offsets of its window (8 or (2k+1)^2 rows) and joined on the
shifted indices. Replicates of a null are rows, so they run side by side and need no driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.session import ensure_checkpoint_dir


def _offsets(k: int, centre: bool) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("da"), F.lit(b).alias("db")) for a in range(-k, k + 1) for b in range(-k, k + 1) if centre or a or b))


def window_pairs(points: DataFrame, cells: DataFrame, k: int, centre: bool = True) -> DataFrame:
    """Rows of points joined with the cells in the window of radius k; points and cells have grid_ix and grid_iy."""
    shifted = points.withColumn("_o", F.explode(_offsets(k, centre))).withColumns({"_ix": F.col("grid_ix") + F.col("_o.da"), "_iy": F.col("grid_iy") + F.col("_o.db")}).drop("_o")
    other = cells.withColumnsRenamed({"grid_ix": "_ix", "grid_iy": "_iy"})
    return shifted.join(other, ["_ix", "_iy"]).drop("_ix", "_iy")


def queen_edges(cells: DataFrame) -> DataFrame:
    """src and dst of each pair of neighbouring cells, in both directions."""
    src = cells.select(F.col("cell_id").alias("src"), "grid_ix", "grid_iy")
    return window_pairs(src, cells.select(F.col("cell_id").alias("dst"), "grid_ix", "grid_iy"), 1, centre=False).select("src", "dst")


def degree_summary(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells, undirected edges, mean degree and isolates; one row."""
    d = cells.select("cell_id").join(edges.groupBy(F.col("src").alias("cell_id")).agg(F.count("*").alias("d")), "cell_id", "left")
    return d.agg(F.count("*").alias("n_cells"), (F.coalesce(F.sum("d"), F.lit(0)) / 2).cast("long").alias("n_edges"), F.avg(F.coalesce("d", F.lit(0))).alias("mean_degree"), F.count_if(F.col("d").isNull()).alias("n_isolates"))


def ring_mean(points: DataFrame, cells: DataFrame, k: int, values: Sequence[str], category: str | None = None, key: str = "point") -> DataFrame:
    """Mean of each value (and the commonest category, ties to the first by name) over the cells in the window of each point; points whose window is empty are left out."""
    pairs = window_pairs(points.select(key, "grid_ix", "grid_iy"), cells.select("grid_ix", "grid_iy", *values, *([category] if category else [])), k)
    out = pairs.groupBy(key).agg(F.count("*").alias("n_cells"), *(F.avg(v).alias(f"mean_{v}") for v in values))
    if not category:
        return out
    n = pairs.groupBy(key, category).agg(F.count("*").alias("_n"))
    return out.join(n.groupBy(key).agg(F.min_by(category, F.struct(-F.col("_n"), F.col(category))).alias("modal")), key)


def permuted(values: DataFrame, value: str, replicates: int, seed: int = C.SEED, key: str = "cell_id") -> DataFrame:
    """rep, key and value: replicate 0 is as observed, the others are permutations by the order of an MD5 hash.

    A replicate's rows are numbered in one window of as many rows as there are cells; replicates are spread over tasks.
    """
    reps = values.select(key, value).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(key))
    drawn = F.row_number().over(Window.partitionBy("rep").orderBy(F.when(F.col("rep") > 0, F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col(key).cast("string"), F.lit(str(seed))))), key))
    numbered = reps.withColumns({"_p": place, "_d": drawn})
    return numbered.select("rep", key, "_p").join(numbered.select("rep", F.col("_d").alias("_p"), value), ["rep", "_p"]).select("rep", key, value)


def morans_i(cells: DataFrame, edges: DataFrame, value: str, replicates: int = 0) -> DataFrame:
    """rep and moran_i, rep 0 being the observed one. Neighbours weigh alike; isolates count in the mean and the denominator alone."""
    base = permuted(cells, value, replicates) if replicates else cells.select(F.lit(0).alias("rep"), "cell_id", value)
    z = cells.agg(F.avg(value).alias("_m"))
    centred = base.crossJoin(F.broadcast(z)).select("rep", "cell_id", (F.col(value) - F.col("_m")).alias("z"))  # one row
    lag = edges.withColumnRenamed("dst", "cell_id").join(centred, "cell_id").groupBy("rep", F.col("src").alias("cell_id")).agg(F.avg("z").alias("lag"))
    j = centred.join(lag, ["rep", "cell_id"], "left")
    return j.groupBy("rep").agg((F.sum(F.col("z") * F.coalesce("lag", F.lit(0.0))) / F.sum(F.col("z") * F.col("z"))).alias("moran_i"))


def morans(cells: DataFrame, edges: DataFrame, values: Sequence[str]) -> DataFrame:
    """measure and moran_i of several columns, in one pass over the edges."""
    mean = cells.agg(*(F.avg(v).alias(f"_m_{v}") for v in values))
    z = cells.crossJoin(F.broadcast(mean)).select("cell_id", *((F.col(v) - F.col(f"_m_{v}")).alias(v) for v in values))  # one row
    lag = edges.withColumnRenamed("dst", "cell_id").join(z, "cell_id").groupBy(F.col("src").alias("cell_id")).agg(*(F.avg(v).alias(f"_l_{v}") for v in values))
    sums = z.join(lag, "cell_id", "left").agg(*(x for v in values for x in (F.sum(F.col(v) * F.coalesce(f"_l_{v}", F.lit(0.0))).alias(f"_a_{v}"), F.sum(F.col(v) * F.col(v)).alias(f"_b_{v}"))))
    return sums.selectExpr(f"stack({len(values)}, {', '.join(f'{v!r}, try_divide(_a_{v}, _b_{v})' for v in values)}) as (measure, moran_i)")


def same_category_share(cells: DataFrame, edges: DataFrame, category: str, replicates: int = 0) -> DataFrame:
    """rep and same_share: the share of neighbouring pairs in the same category."""
    base = permuted(cells, category, replicates) if replicates else cells.select(F.lit(0).alias("rep"), "cell_id", category)
    one = edges.where("src < dst")
    a = one.join(base.select("rep", F.col("cell_id").alias("src"), F.col(category).alias("_a")), "src")
    b = a.join(base.select("rep", F.col("cell_id").alias("dst"), F.col(category).alias("_b")), ["rep", "dst"])
    return b.groupBy("rep").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("same_share"))


def against_null(replicates: DataFrame, statistic: str) -> DataFrame:
    """observed, null_mean, null_std (n), z and one-sided p of rep 0 among the others; one row."""
    obs = replicates.where("rep = 0").select(F.col(statistic).alias("observed"))
    j = replicates.where("rep > 0").crossJoin(F.broadcast(obs))  # one row
    s = j.agg(F.max("observed").alias("observed"), F.avg(statistic).alias("null_mean"), F.stddev_pop(statistic).alias("null_std"), F.count_if(F.col(statistic) >= F.col("observed")).alias("_k"), F.count("*").alias("n_replicates"))
    return s.select("observed", "null_mean", "null_std", ((F.col("observed") - F.col("null_mean")) / (F.col("null_std") + 1e-12)).alias("z"), ((F.col("_k") + 1) / (F.col("n_replicates") + 1)).alias("p"), "n_replicates")


def relabel_purity(cells: DataFrame, unit: str, category: str, replicates: int) -> DataFrame:
    """rep, mean_distinct and mean_purity of units when categories are permuted over cells."""
    p = permuted(cells, category, replicates).join(cells.select("cell_id", unit), "cell_id").where((F.col(category) != "none") & F.col(unit).isNotNull())
    n = p.groupBy("rep", unit, category).agg(F.count("*").alias("n"))
    u = n.groupBy("rep", unit).agg(F.count("*").alias("nd"), (F.max("n") / F.sum("n")).alias("purity"))
    return u.groupBy("rep").agg(F.avg("nd").alias("mean_distinct"), F.avg("purity").alias("mean_purity"))


def shifts(spark, n: int, low: int = 6, high: int = 29, seed: int = C.SEED) -> DataFrame:
    """rep, dx and dy: random shifts of either sign."""
    rng = np.random.default_rng(seed)
    d = rng.integers(low, high + 1, (n, 2)) * rng.choice([-1, 1], (n, 2))
    return spark.createDataFrame([(i + 1, int(a), int(b)) for i, (a, b) in enumerate(d)], "rep int, dx int, dy int")


def shift_purity(cells: DataFrame, unit: str, category: str, moves: DataFrame, least_overlap: float = 0.3, keep: int | None = None) -> DataFrame:
    """rep, overlap, mean_distinct and mean_purity when the map of categories is shifted around a torus under fixed units.

    Replicates that cover too few cells are left out; `keep` keeps the first so many of the others. The torus is the cells' bounding box.
    """
    box = cells.agg((F.max("grid_ix") + 1).alias("nx"), (F.max("grid_iy") + 1).alias("ny"), F.count("*").alias("n_all"))
    base = cells.crossJoin(F.broadcast(box))  # one row
    moved = base.crossJoin(F.broadcast(moves)).select("rep", F.pmod(F.col("grid_ix") + F.col("dx"), F.col("nx")).alias("grid_ix"), F.pmod(F.col("grid_iy") + F.col("dy"), F.col("ny")).alias("grid_iy"), F.col(category).alias("_c"))  # a row a replicate
    j = moved.join(base.select("grid_ix", "grid_iy", unit, "n_all"), ["grid_ix", "grid_iy"])
    enough = j.groupBy("rep").agg((F.count("*") / F.max("n_all")).alias("overlap")).where(F.col("overlap") >= least_overlap)
    if keep is not None:
        enough = enough.orderBy("rep").limit(keep)
    n = j.where((F.col("_c") != "none") & F.col(unit).isNotNull()).groupBy("rep", unit, "_c").agg(F.count("*").alias("n"))
    u = n.groupBy("rep", unit).agg(F.count("*").alias("nd"), (F.max("n") / F.sum("n")).alias("purity"))
    return u.join(F.broadcast(enough), "rep").groupBy("rep").agg(F.max("overlap").alias("overlap"), F.avg("nd").alias("mean_distinct"), F.avg("purity").alias("mean_purity"))


def patch_purity(cells: DataFrame, unit: str, category: str, patches: int = 40, seed: int = C.SEED) -> DataFrame:
    """For each unit: its purity beside that of random connected patches of as many cells.

    The map (a row a cell, of the table of cells alone) is broadcast; units and replicates are spread over tasks, and each grows its patch by itself.
    """
    spark = cells.sparkSession
    rows = cells.select("cell_id", "grid_ix", "grid_iy", category).orderBy("cell_id").toPandas()
    where = {(a, b): i for i, (a, b) in enumerate(zip(rows["grid_ix"], rows["grid_iy"], strict=True))}
    near = [[j for da in (-1, 0, 1) for db in (-1, 0, 1) if (da or db) and (j := where.get((a + da, b + db))) is not None] for a, b in where]
    shared = spark.sparkContext.broadcast((near, rows[category].tolist()))
    n = cells.where(F.col(unit).isNotNull() & ~F.col(category).isin("none", C.STRUCTURAL)).groupBy(unit, category).agg(F.count("*").alias("n"))
    size = cells.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.count("*").alias("n_cells"))
    units = n.groupBy(unit).agg((F.max("n") / F.sum("n")).alias("purity")).join(size, unit).withColumnRenamed(unit, "unit")

    def grow(batches):
        near, kinds = shared.value
        for b in batches:
            out = []
            for name, most, rep in zip(b["unit"], b["n_cells"], b["rep"], strict=True):
                rng = np.random.default_rng([seed, rep, *str(name).encode()])
                seen, queue = set(), [int(rng.integers(len(near)))]
                while queue and len(seen) < most:
                    i = queue.pop(0)
                    if i in seen:
                        continue
                    seen.add(i)
                    more = [j for j in near[i] if j not in seen]
                    rng.shuffle(more)
                    queue += more
                own = [kinds[i] for i in seen if kinds[i] not in ("none", C.STRUCTURAL)]
                out.append(max(map(own.count, set(own))) / len(own) if own else None)
            yield pd.DataFrame({"unit": b["unit"], "patch": pd.Series(out, dtype="float64")})

    grown = units.select("unit", "n_cells", F.explode(F.sequence(F.lit(1), F.lit(patches))).alias("rep")).mapInPandas(grow, f"unit {units.schema['unit'].dataType.simpleString()}, patch double")
    null = grown.groupBy("unit").agg(F.avg("patch").alias("null_mean"), F.stddev_pop("patch").alias("null_std"))
    return units.join(null, "unit").withColumn("z", (F.col("purity") - F.col("null_mean")) / (F.col("null_std") + 1e-9))


#: Edges up to which areas are joined up in one task (some 200 bytes each).
FEW_EDGES = 300_000


def _areas_in_one_task(edges: DataFrame) -> DataFrame:
    """cell_id and the smallest cell_id of its component, of every cell with an edge; union by the smaller root."""

    def run(batches):
        root = {}

        def find(x):
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        for b in batches:
            for x, y in zip(b["src"], b["dst"], strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = root[min(x, y)] = min(x, y)
        yield pd.DataFrame({"cell_id": list(root), "_least": [find(x) for x in root]})

    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").coalesce(1).mapInPandas(run, f"cell_id {kind}, _least {kind}")


def connected_areas(cells: DataFrame, least: int = 5, most_rounds: int = 200, few: int = FEW_EDGES) -> DataFrame:
    """cell_id and area (its smallest cell_id) of the 8-neighbour components of cells with at least `least` members.

    At most `few` edges take one task. Of more the least label spreads to neighbours and, by pointers, to the label's own label, so
    rounds grow with the logarithm of an area's extent; each round is written to the checkpoint folder and is a plan or two that the
    driver keeps. Raises RuntimeError if labels still change after most_rounds.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    edges = queen_edges(cells).checkpoint()
    if edges.count() <= few:
        found = cells.select("cell_id").join(_areas_in_one_task(edges), "cell_id", "left")
        return _with_size(found.select("cell_id", F.coalesce("_least", "cell_id").alias("area")).checkpoint(), least)
    label = cells.select("cell_id", F.col("cell_id").alias("area"))
    mark = None
    for _ in range(most_rounds):
        near = edges.join(label.select(F.col("cell_id").alias("dst"), "area"), "dst").groupBy(F.col("src").alias("cell_id")).agg(F.min("area").alias("_near"))
        step = label.join(near, "cell_id", "left").select("cell_id", F.least("area", "_near").alias("area"))
        jump = step.select(F.col("cell_id").alias("area"), F.col("area").alias("_up"))
        label = step.join(jump, "area", "left").select("cell_id", F.least("area", "_up").alias("area")).checkpoint()
        now = label.agg(F.bit_xor(F.xxhash64("cell_id", "area")), F.count("*")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"areas are not complete after {most_rounds} rounds")
    return _with_size(label, least)


def _with_size(label: DataFrame, least: int) -> DataFrame:
    size = label.groupBy("area").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= least)
    return label.join(size, "area").select("cell_id", "area", "n_cells")


def area_attributes(areas: DataFrame, cells: DataFrame, centres: DataFrame) -> DataFrame:
    """One row an area, numbered by size: its commonest admin area, mean activity, middle, members and the centres it touches.

    cells has cell_id, grid indices, admin_dong and activity_share; centres(cell_id, centre, tier) has the cells of centres.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    m = areas.join(cells, "cell_id").checkpoint()
    dong = m.groupBy("area", "admin_dong").agg(F.count("*").alias("n")).groupBy("area").agg(F.min_by("admin_dong", F.struct(-F.col("n"), F.col("admin_dong"))).alias("dominant_admin_dong"))
    base = m.groupBy("area").agg(
        F.count("*").alias("n_cells"),
        F.avg("activity_share").alias("mean_activity_share"),
        (F.avg("grid_ix") * C.GRID_STEP + C.GRID_X0).alias("cx"),
        (F.avg("grid_iy") * C.GRID_STEP + C.GRID_Y0).alias("cy"),
        F.sort_array(F.collect_list("cell_id")).alias("cell_ids"),
    )
    near = centres.select("cell_id", "centre", "tier").join(cells.select("cell_id", "grid_ix", "grid_iy"), "cell_id")
    touch = window_pairs(m.select("area", "grid_ix", "grid_iy"), near.select("grid_ix", "grid_iy", "centre", "tier"), 1, centre=False)
    pairs = touch.groupBy("area", "centre", "tier").agg(F.count("*").alias("n"))
    lists = pairs.groupBy("area").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "centre", "tier"))).alias("_p"))
    out = base.join(dong, "area").join(lists, "area", "left")
    rank = F.row_number().over(Window.orderBy(F.desc("n_cells"), "area"))  # a row an area
    return out.select(
        rank.alias("cluster_id"),
        "n_cells",
        "dominant_admin_dong",
        F.substring("dominant_admin_dong", 1, 5).alias("gu"),
        "mean_activity_share",
        "cx",
        "cy",
        "cell_ids",
        F.coalesce(F.transform("_p", lambda x: x["centre"]), F.array().cast("array<string>")).alias("adj_centers"),
        F.coalesce(F.transform("_p", lambda x: x["tier"]), F.array().cast("array<string>")).alias("adj_center_tiers"),
        F.coalesce(F.transform("_p", lambda x: -x["n"]), F.array().cast("array<bigint>")).alias("adj_pair_counts"),
        F.coalesce(F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a - x["n"]), F.lit(0)).alias("n_adj_pairs"),
        F.col("_p").isNotNull().alias("touches_center"),
    )
