"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import ann

RNG = np.random.default_rng(5)


def brute(rows, asks, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            ok[i] = min(ok.get(i, v), v)
    out = {}
    for q in ok:
        if asks(q):
            a = np.array(ok[q], np.float64)
            d = sorted((float(np.sqrt(((np.array(v, np.float64) - a) ** 2).sum())), i) for i, v in ok.items() if i != q)
            out[q] = d[:k]
    return out


def run(spark, rows, k=10, recall=0.97, every=7):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = ann.search(df, F.col("vec_id") % every == 0, k, recall).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(by[r.query_id])
    return by


def vec(x):
    return [float(np.float32(v)) for v in x]


def test_few_vectors_are_exact(spark):
    rows = [(i, vec(RNG.normal(size=8))) for i in range(30)]
    same = vec(RNG.normal(size=8))
    rows += [(100 + i, same) for i in range(40)] + [(200 + i, vec(np.array(same) + [1, *[0] * 7])) for i in range(3)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan"), *[1.0] * 7]), (303, [float("inf"), *[1.0] * 7]), (304, [None, *[1.0] * 7]), (305, [1.0] * 7), (306, []), (None, same), (7, rows[7][1]), (14, vec(RNG.normal(size=8))), (-7, [-0.0, *[1.0] * 7])]
    got, want = run(spark, rows, recall=1.0), brute(rows, lambda q: q % 7 == 0, 10)
    assert got == want


def test_recall(spark, monkeypatch):
    centres = RNG.normal(size=(12, 8)) * 2
    rows = [(i, vec(centres[i % 12] + RNG.normal(size=8))) for i in range(3000)]
    monkeypatch.setattr(ann, "FIT", 800)
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "CHUNK", 16)
    got, want = run(spark, rows, every=50), brute(rows, lambda q: q % 50 == 0, 10)
    assert got.keys() == want.keys()
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    dist = {q: dict((i, s) for s, i in brute(rows, lambda x, q=q: x == q, 3000)[q]) for q in list(want)[:5]}
    assert all(s == dist[q][i] for q in dist for s, i in got[q])


@pytest.mark.parametrize("rows", [[], [(7, [1.0] * 8)], [(7, [1.0] * 8), (8, [2.0] * 8)]])
def test_tiny(spark, rows):
    assert run(spark, rows) == {q: d for q, d in brute(rows, lambda q: q % 7 == 0, 10).items() if d}
