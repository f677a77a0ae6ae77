"""Mixing and line dedup on small tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import linededup, mixing


def corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{min(int(k), 5)}", "w " * int(rng.integers(0, 60))) for i, k in enumerate(rng.geometric(0.55, 900) - 1)]
    rows += [(1000, None, "one two"), (1001, "s0", None), (1002, "s0", ""), (None, "s1", "no id"), (3, "s0", "again and again"), (1003, "s5", "w " * 5000)]
    return rows, spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, source string, text string, copies int")


def exponent_of(words, entropy, repeat, budget):
    p = np.array([w for w in words if w], float) / sum(words)

    def stats(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum(), (budget * w / p).max()

    grid = np.linspace(0, 1, 200_001)
    ok = [a for a in grid[::50] if stats(a)[0] >= entropy * math.log(len(p)) - 1e-12]
    held = [a for a in grid[::50] if stats(a)[1] <= repeat]
    return max(max(ok, default=0.0), min(held, default=1.0))


def test_weights_and_budget(spark):
    rows, df = corpus(spark)
    for entropy, repeat in ((0.9, 50.0), (0.99, 3.0)):
        got = mixing.copies(df.drop("copies"), mixing.decisions(df, 1.0, entropy, repeat)).collect()
        assert len(got) == len(rows)
        words = defaultdict(int)
        for _, s, t in rows:
            words[s] += len((t or "").split())
        a = exponent_of(list(words.values()), entropy, repeat, 1.0)
        total = sum(words.values())
        z = sum((w / total) ** a for w in words.values())
        weight = {r.source: r.weight for r in got}
        drawn = Counter()
        for r in got:
            drawn[r.source] += len((r.text or "").split()) * r.copies
        for s, w in words.items():
            assert weight[s] == pytest.approx((w / total) ** a / z, abs=2e-3)
            goal = weight[s] * total
            assert drawn[s] <= goal + 1e-3 and goal - drawn[s] <= 5001  # a block and its border fit, short of one document
            k = [r.copies for r in got if r.source == s]
            assert max(k) - min(k) <= 1


def test_everything_once_without_a_budget(spark):
    rows, df = corpus(spark)
    out = mixing.mix(df, budget=None, repeat=2.0)
    assert out.columns == df.columns and {r.doc_id for r in out.select("doc_id").collect()} == {r[0] for r in rows}
    assert mixing.mix(df.limit(0)).count() == 0
    blank = df.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix(blank).count() == len(rows)


def test_the_same_draw_whatever_the_partitions(spark):
    _, df = corpus(spark)
    draw = lambda d: sorted(map(tuple, mixing.mix(d).collect()), key=str)
    assert draw(df) == draw(df.repartition(7))


def clean(rows, least):
    sites = defaultdict(set)
    for _, s, t in rows:
        for line in (t or "").split("\n"):
            if (k := line.strip(" \t\r")) and s is not None:
                sites[k].add(s)
    spread = {k for k, v in sites.items() if len(v) >= least}
    out = []
    for d, _, t in rows:
        if t is None:
            out.append((d, None, 0, 0, False))
            continue
        lines = t.split("\n")
        keys = [x.strip(" \t\r") for x in lines]
        gone, total = sum(len(k) for k in keys if k in spread), sum(map(len, keys))
        copy = 2 * gone > total
        kept = lines if copy else [x for x, k in zip(lines, keys, strict=True) if k not in spread]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept), copy))
    return sorted(out, key=str)


def test_spread_lines(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"s{i % 15}", "\n".join([f"own line number {i} with some words", " shared footer \r" if i % 3 else "", "rare line" if i % 15 < 9 else "x", "line on ten" if i % 15 < 10 else "y y", f"word {rng.integers(5)}"])) for i in range(300)]
    rows += [(400 + i, f"s{i}", "copied page\nin all places") for i in range(14)]
    rows += [(500, None, "shared footer\nmy own text that is long enough"), (501, "s1", None), (502, "s1", ""), (503, "s2", "\n\n"), (None, "s3", "shared footer\nand a text without an id, long"), (504, "s1", "shared footer\n" * 3000 + "z" * 60_000), (1, "s4", "shared footer\nanother row of that id here")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, source string, text string, h string")
    got = linededup.remove_spread_lines(df)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.is_copy) for r in got.collect()), key=str) == clean(rows, 10)
    assert got.columns == ["doc_id", "source", "text", "h", "n_lines", "n_removed", "is_copy"]
    assert linededup.remove_spread_lines(df.limit(0)).count() == 0
    clash = df.withColumnRenamed("h", "is_copy")
    assert linededup.remove_spread_lines(clash, add=False).columns == clash.columns


def test_only_native_operators(spark):
    df = spark.createDataFrame([(1, "s", "t")], "doc_id long, source string, text string")
    plan = linededup.remove_spread_lines(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
