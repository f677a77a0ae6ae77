"""Sequence models against enumeration of all segmentations and paths."""

from itertools import product

import numpy as np
import pytest

from gridweave.operators.models import hmm, hsmm
from gridweave.operators.models.gaussian import log_emission

RNG = np.random.default_rng(1)


def hsmm_of(k=2, most=6, d=2):
    trans = RNG.random((k, k)) * (1 - np.eye(k))
    return hsmm.HSMM(np.full(k, 1 / k), trans / trans.sum(1, keepdims=True), RNG.normal(size=(k, d)), RNG.random((k, d)) + 0.5, hsmm.duration_pmf(RNG.random(k) * 3 + 1, RNG.random(k) + 0.5, most))


def segmentations(t, k):
    def go(at, before):
        if at == t:
            yield []
            return
        for d in range(1, t - at + 1):
            for s in range(k):
                if s != before:
                    for rest in go(at + d, s):
                        yield [(s, d), *rest]

    yield from go(0, -1)


@pytest.mark.parametrize(("t", "k"), [(1, 2), (4, 2), (6, 2), (5, 3)])
def test_semi_markov(t, k):
    m = hsmm_of(k)
    x = RNG.normal(size=(3, t, 2))
    b = log_emission(x, m.means, m.vars)
    after = np.cumsum(m.durations[:, ::-1], 1)[:, ::-1]
    labels, scores = m.viterbi(x)
    for i in range(3):
        best, total = (-np.inf, None), []
        for seg in segmentations(t, k):
            lp, at, path = np.log(m.start[seg[0][0]]), 0, []
            for j, (s, d) in enumerate(seg):
                if j:
                    lp += np.log(m.trans[seg[j - 1][0], s])
                lp += b[i, at : at + d, s].sum()
                at += d
                path += [s] * d
                if j < len(seg) - 1:
                    lp += np.log(m.durations[s, d - 1])
            s, d = seg[-1]
            total.append(lp + np.log(after[s, d - 1]))
            if lp + np.log(m.durations[s, d - 1]) > best[0]:
                best = (lp + np.log(m.durations[s, d - 1]), path)
        assert labels[i].tolist() == best[1]
        assert scores[i] == pytest.approx(best[0])
        assert m.likelihood(x)[i] == pytest.approx(np.logaddexp.reduce(total))


def test_markov():
    k, t = 3, 5
    m = hmm.HMM(np.array([0.5, 0.3, 0.2]), RNG.dirichlet(np.ones(k), k), RNG.normal(size=(k, 2)), RNG.random((k, 2)) + 0.5)
    x = RNG.normal(size=(2, t, 2))
    b = log_emission(x, m.means, m.vars)
    for i in range(2):
        logs = {p: np.log(m.start[p[0]]) + sum(np.log(m.trans[a, c]) for a, c in zip(p, p[1:], strict=False)) + sum(b[i, j, s] for j, s in enumerate(p)) for p in product(range(k), repeat=t)}
        assert tuple(m.viterbi(x)[i]) == max(logs, key=logs.get)
        assert np.logaddexp.reduce(m.forward(b)[i, -1]) == pytest.approx(np.logaddexp.reduce(list(logs.values())))
    s = m.statistics(x)
    assert s["n"].sum() == pytest.approx(2 * t) and s["xi"].sum() == pytest.approx(2 * (t - 1)) and s["start"].sum() == pytest.approx(2)


def test_durations():
    p = hsmm.duration_pmf(np.array([1.0, 3.0]), np.array([0.1, 2.0]), 19)
    assert p.sum(1) == pytest.approx(1) and (p > 0).all()


def test_fit_recovers_states(spark):
    rng = np.random.default_rng(4)
    rows, truth = [], []
    for i in range(60):
        path = [s for s in rng.permutation(2).tolist() * 3 for _ in range(int(rng.integers(2, 5)))][:12]
        rows.append((i, [[float(v) for v in rng.normal(4 * s, 0.4, 2)] for s in path]))
        truth.append(path)
    df = spark.createDataFrame(rows, "id int, x array<array<float>>").repartition(3)
    for module, options in ((hmm, {}), (hsmm, {"most": 12})):
        m = module.fit(df, 2, n_iter=6, **options)
        got = {r.id: r.labels for r in module.decode(df, m, ["id"]).collect()}
        same = np.mean([a == b for i, p in enumerate(truth) for a, b in zip(got[i], p, strict=True)])
        assert max(same, 1 - same) > 0.99
        again = type(m).from_json(m.to_json())
        assert module.score(df, again) == pytest.approx(m.log_likelihood)
    assert m.history == sorted(m.history) or m.converged
