"""Mixing sources to target weights by temperature.

A source's share of all words, to the power of an exponent and normalised, is its weight. The exponent is searched between
1 (as found) and 0 (all alike): the largest that gives the weights a target entropy, raised again until no source is
repeated more often than the limit allows. A source's words in the mixture are its weight times the budget: so many whole
passes over it, and for the rest a prefix of a permutation: documents are dealt into blocks by a hash, the blocks are
permuted, whole blocks are taken while they fit, and of the block at the border documents in hash order while they fit.

The search sees one row of sums for 64 exponents at a time. A source's decision is one row (passes, border block, border
document), so documents are not shuffled; the table of decisions is broadcast only if it has few rows.
Defined results: null source is a source of its own; null and empty texts have no words and go with their block; rows with
the same id (or none) stand together in hash order, and fit together or not at all; without any words every document is
taken once; an empty table gives an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import settle

PER_BLOCK, SECTIONS, BROADCAST_ROWS = 1024, 64, 100_000


def n_words(text: Column) -> Column:
    """Words of a whole text; null has none."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return F.coalesce(F.size(F.filter(parts, lambda w: w != "")), F.lit(0)).cast("long")


def _place(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _search(sources: DataFrame, total: int, budget: float | None, entropy: float, repeat: float) -> tuple[float, float]:
    """The exponent and the budget in words, from the sources' words."""
    p = F.col("words") / float(total)
    used = sources.where("words > 0")
    n, low_p, top_p = used.agg(F.count("*"), F.min(p), F.max(p)).first()

    def sums(a: float, b: float) -> list[tuple[float, float, float]]:
        grid = [a + (b - a) * k / SECTIONS for k in range(SECTIONS + 1)]
        row = used.agg(*(F.sum(F.pow(p, F.lit(x))) for x in grid), *(F.sum(F.pow(p, F.lit(x)) * F.log(p)) for x in grid)).first()
        return [(x, z, math.log(z) - x * s / z) for x, z, s in zip(grid, row[: len(grid)], row[len(grid) :], strict=True)]

    def words(a: float, z: float) -> float:
        return total * (budget if budget is not None else z * top_p ** (1 - a))  # no budget: the least repeated source passes once

    def largest(good) -> float:
        a, b = 0.0, 1.0
        for _ in range(4):
            rows = sums(a, b)
            if good(*rows[-1]):
                return rows[-1][0]
            k = max((i for i, r in enumerate(rows) if good(*r)), default=-1)
            if k < 0:
                return rows[0][0]
            a, b = rows[k][0], rows[k + 1][0]
        return a

    def smallest(good) -> float:
        a, b = 0.0, 1.0
        for _ in range(4):
            rows = sums(a, b)
            k = min((i for i, r in enumerate(rows) if good(*r)), default=len(rows) - 1)
            if not k:
                return rows[0][0]
            a, b = rows[k - 1][0], rows[k][0]
        return b

    goal = entropy * math.log(n) if n > 1 else 0.0
    exponent = largest(lambda a, z, h: h >= goal - 1e-12)
    held = smallest(lambda a, z, h: words(a, z) / total * low_p ** (a - 1) / z <= repeat + 1e-12)
    exponent = round(max(exponent, held), 6)
    z = used.agg(F.sum(F.pow(p, F.lit(exponent)))).first()[0]
    return exponent, words(exponent, z) / z


def decisions(docs: DataFrame, budget: float | None = 1.0, entropy: float = 0.97, repeat: float = 4.0, seed: int = 42) -> DataFrame:
    """For each source (key `_source`): weight, passes, and where the last, partial pass ends."""
    words = settle(docs.select(F.coalesce("source", F.lit("\0")).alias("_source"), "doc_id", n_words(F.col("text")).alias("words")), "words")
    sources = settle(words.groupBy("_source").agg(F.sum("words").alias("words"), F.count("*").alias("n")), "sources")
    total = sources.agg(F.sum("words")).first()[0] or 0
    if not total:
        return sources.select("_source", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit(1).cast("long").alias("blocks"), F.lit(None).cast("long").alias("block_at"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("struct<h:bigint,id:bigint>").alias("last"))
    exponent, scale = _search(sources, total, budget, entropy, repeat)
    raw = F.when(F.col("words") > 0, F.pow(F.col("words") / float(total), F.lit(exponent))).otherwise(0.0)
    goal = F.floor(raw * scale + 1e-6)
    plan = sources.select("_source", (raw * scale / F.lit(1.0)).alias("weight"), F.when(F.col("words") > 0, F.floor(goal / F.col("words"))).otherwise(1).cast("long").alias("passes"), F.when(F.col("words") > 0, goal % F.col("words")).otherwise(0).cast("long").alias("rest"), F.ceil(F.col("n") / PER_BLOCK).cast("long").alias("blocks"))
    plan = settle(plan, "plan")
    in_plan = _with(words, plan).withColumn("block", _block(seed))
    # A source of n documents has n / PER_BLOCK blocks in its window.
    order = Window.partitionBy("_source").orderBy("at", "block")
    sums = in_plan.groupBy("_source", "block", "rest").agg(F.sum("words").alias("words")).withColumn("at", _place(seed, F.col("_source"), F.col("block")))
    sums = sums.withColumn("end", F.sum("words").over(order))
    border = sums.where(F.col("end") > F.col("rest")).groupBy("_source").agg(F.min(F.struct("at", "block", (F.col("rest") - F.col("end") + F.col("words")).alias("left"))).alias("b")).select("_source", F.col("b.at").alias("block_at"), F.col("b.block").alias("block"), F.col("b.left").alias("left"))
    border = settle(border, "border")
    inside = _with(words, plan.select("_source", "blocks")).withColumn("block", _block(seed)).join(border, ["_source", "block"])
    inside = inside.groupBy("_source", "left", F.struct(_place(seed, F.col("doc_id")).alias("h"), F.col("doc_id").alias("id")).alias("last")).agg(F.sum("words").alias("words"))
    inside = inside.withColumn("end", F.sum("words").over(Window.partitionBy("_source").orderBy("last")))
    last = inside.where(F.col("end") <= F.col("left")).groupBy("_source").agg(F.max("last").alias("last"))
    share = plan.agg(F.sum("weight")).first()[0]
    out = plan.join(border.drop("left"), "_source", "left").join(last, "_source", "left")
    return settle(out.select("_source", (F.col("weight") / share).alias("weight"), "passes", "blocks", "block_at", "block", "last"), "decision")


def _block(seed: int) -> Column:
    return F.pmod(_place(seed + 1, F.col("doc_id")), F.col("blocks"))


def _with(docs: DataFrame, table: DataFrame) -> DataFrame:
    few = table.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(table) if few else table, "_source")


def _drawn(docs: DataFrame, decision: DataFrame, seed: int) -> DataFrame:
    """Rows as a struct _doc, so that their names clash with none here, with weight and copies."""
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), F.coalesce(docs["source"], F.lit("\0")).alias("_source"), docs["doc_id"].alias("doc_id"))
    d = _with(d, decision.withColumnRenamed("block", "border_block"))
    block = _block(seed)
    place = F.struct(_place(seed, F.col("_source"), block).alias("at"), block.alias("block"))
    edge = F.struct(F.col("block_at").alias("at"), F.col("border_block").alias("block"))
    own = F.struct(_place(seed, F.col("doc_id")).alias("h"), F.col("doc_id").alias("id"))
    more = F.when(F.col("block_at").isNull(), False).when(place < edge, True).when(place == edge, F.coalesce(own <= F.col("last"), F.lit(False))).otherwise(False)
    return d.select("_doc", "weight", (F.col("passes") + more.cast("long")).alias("copies"), place["at"].alias("block_place"), own["h"].alias("doc_place"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]


def copies(docs: DataFrame, decision: DataFrame, seed: int = 42) -> DataFrame:
    """docs with the new columns weight (the source's), copies, how often the mixture has the row, and the row's place in its source's
    permutation: by block_place, then by doc_place. Columns of docs with these names are left out for the new ones."""
    new = ("weight", "copies", "block_place", "doc_place")
    return _drawn(docs, decision, seed).select(*(c for c, n in zip(_columns(docs), docs.columns, strict=True) if n not in new), *new)


def mix(docs: DataFrame, budget: float | None = 1.0, entropy: float = 0.97, repeat: float = 4.0, seed: int = 42) -> DataFrame:
    """The mixture: rows of docs, each as often as it is drawn."""
    drawn = _drawn(docs, decisions(docs, budget, entropy, repeat, seed), seed).where("copies > 0")
    return drawn.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*_columns(docs))
