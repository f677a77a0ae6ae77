"""Gaussian hidden Markov models, plain and sticky: Baum-Welch over batches of sequences of any length."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from gridweave.operators.models.gaussian import MIN_COVAR, log_emission, log_sum, per_sequence, start_means, summed


@dataclass
class HMM:
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    vars: np.ndarray
    log_likelihood: float = float("nan")

    @property
    def k(self) -> int:
        return len(self.start)

    def n_params(self) -> int:
        return 2 * self.means.size + (self.k - 1) + self.k * (self.k - 1)

    def to_json(self) -> str:
        return json.dumps({n: np.asarray(getattr(self, n)).tolist() for n in ("start", "trans", "means", "vars", "log_likelihood")})

    @classmethod
    def from_json(cls, text: str) -> HMM:
        d = json.loads(text)
        return cls(*(np.array(d[n]) for n in ("start", "trans", "means", "vars")), float(d["log_likelihood"]))

    def _logs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.log(self.start + 1e-300), np.log(self.trans + 1e-300)

    def forward(self, b: np.ndarray) -> np.ndarray:
        """Log forward variables from log emissions (n, T, K)."""
        pi, a = self._logs()
        out = np.empty_like(b)
        out[:, 0] = pi + b[:, 0]
        for t in range(1, b.shape[1]):
            out[:, t] = log_sum(out[:, t - 1, :, None] + a, 1) + b[:, t]
        return out

    def statistics(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Expected counts of a tensor of sequences."""
        _, a = self._logs()
        b = log_emission(x, self.means, self.vars)
        f = self.forward(b)
        back = np.zeros_like(b)
        for t in range(b.shape[1] - 2, -1, -1):
            back[:, t] = log_sum(a + (b[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        ll = log_sum(f[:, -1], 1)
        g = np.exp(f + back - ll[:, None, None])
        xi = np.zeros((self.k, self.k))
        for t in range(b.shape[1] - 1):
            xi += np.exp(f[:, t, :, None] + a + (b[:, t + 1] + back[:, t + 1])[:, None, :] - ll[:, None, None]).sum(0)
        flat, w = x.reshape(-1, x.shape[-1]), g.reshape(-1, self.k)
        return {"start": g[:, 0].sum(0), "xi": xi, "n": w.sum(0), "x": w.T @ flat, "xx": w.T @ (flat * flat), "ll": np.array([ll.sum()]), "rows": np.array([x.shape[0] * x.shape[1]], np.float64)}

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        pi, a = self._logs()
        b = log_emission(x, self.means, self.vars)
        n, t_all, _ = b.shape
        score, back = pi + b[:, 0], np.zeros(b.shape, np.int64)
        for t in range(1, t_all):
            step = score[:, :, None] + a
            back[:, t] = step.argmax(1)
            score = step.max(1) + b[:, t]
        labels = np.empty((n, t_all), np.int64)
        labels[:, -1] = score.argmax(1)
        for t in range(t_all - 1, 0, -1):
            labels[:, t - 1] = back[np.arange(n), t, labels[:, t]]
        return labels


def initial(sequences: DataFrame, k: int, seed: int) -> HMM:
    means, variances = start_means(sequences, k, seed)
    return HMM(np.full(k, 1 / k), np.full((k, k), 1 / k), means, np.tile(variances + MIN_COVAR, (k, 1)))


def fit(sequences: DataFrame, k: int, n_iter: int = 40, tol: float = 1e-2, kappa: float = 0.0, seed: int = 42) -> HMM:
    """Expectation-maximisation until the log-likelihood gains less than tol. kappa is the sticky prior's extra count of staying."""
    m, last = initial(sequences, k, seed), -np.inf
    for _ in range(n_iter):
        s = summed(sequences, m.statistics)
        if not s:
            return m
        ll = float(s["ll"][0])
        n = np.maximum(s["n"], 1e-10)[:, None]
        means = s["x"] / n
        trans = s["xi"] + kappa * np.eye(k)
        rows = trans.sum(1, keepdims=True)
        trans = np.where(rows > 0, trans / np.where(rows > 0, rows, 1), 1 / k)
        m = HMM(s["start"] / s["start"].sum(), trans, means, np.maximum(s["xx"] / n - means**2, 0) + MIN_COVAR, ll)
        if ll - last < tol:
            break
        last = ll
    m.log_likelihood = score(sequences, m)
    return m


def best_of(sequences: DataFrame, k: int, reinits: int = 5, seed: int = 42, **options) -> tuple[HMM, list[HMM]]:
    """The fit of the highest likelihood from several starting points, and all of them."""
    fits = [fit(sequences, k, seed=seed + 31 * r, **options) for r in range(reinits)]
    return max(fits, key=lambda f: f.log_likelihood), fits


def score(sequences: DataFrame, model: HMM) -> float:
    """Log-likelihood of all sequences."""
    s = summed(sequences, lambda x: {"ll": np.array([log_sum(model.forward(log_emission(x, model.means, model.vars))[:, -1], 1).sum()])})
    return float(s["ll"][0]) if s else 0.0


def decode(sequences: DataFrame, model: HMM, keys: list[str]) -> DataFrame:
    """keys and labels, the most probable states of each sequence."""
    return per_sequence(sequences, keys, "labels array<int>", lambda x: [model.viterbi(x).tolist()])
