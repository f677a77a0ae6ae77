"""Hidden semi-Markov models with explicit durations: hard expectation-maximisation, decoding and censored likelihood.

A state lasts a number of steps from its own distribution and is never followed by itself. The score of entering a state
at a step is kept for each step, so a segment's score is a difference of running sums plus that entry, and the recursion
over durations costs steps^2 * states for a sequence (and steps * states^2 for the entries).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from gridweave.operators.models.gaussian import MIN_COVAR, log_emission, log_sum, per_sequence, start_means, summed

NEVER = -1e30


def duration_pmf(means: np.ndarray, variances: np.ndarray, most: int) -> np.ndarray:
    """Shares of the lengths 1 .. most under gamma distributions; means count as 1.05 and variances as 0.25 at least.

    A gamma density is length ** (rate * mean - 1) * exp(-rate * length), with rate = mean / variance, but for a factor that
    does not depend on the length and so drops out of the shares.
    """
    mean = np.maximum(means, 1.05)
    rate = mean / np.maximum(variances, 0.25)
    length = np.arange(1.0, most + 1)
    logs = np.outer(rate * mean - 1, np.log(length)) - np.outer(rate, length)
    shares = np.maximum(np.exp(logs - log_sum(logs, 1)[:, None]), 1e-12)
    return shares / shares.sum(1, keepdims=True)


def row_shares(counts: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Each row's counts as shares of its allowed places; a row without any gets equal ones."""
    own = np.where(allowed, counts, 0.0)
    equal = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    total = own.sum(1, keepdims=True)
    return np.divide(own, total, out=equal, where=total > 0)


@dataclass
class HSMM:
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    vars: np.ndarray
    durations: np.ndarray
    log_likelihood: float = float("nan")
    converged: bool = False
    history: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.start)

    def n_params(self) -> int:
        return 2 * self.means.size + self.k * (self.k - 2) + (self.k - 1) + 2 * self.k

    def mean_durations(self) -> np.ndarray:
        return self.durations @ np.arange(1, self.durations.shape[1] + 1)

    def to_json(self) -> str:
        return json.dumps({n: np.asarray(getattr(self, n)).tolist() for n in ("start", "trans", "means", "vars", "durations", "log_likelihood")})

    @classmethod
    def from_json(cls, text: str) -> HSMM:
        d = json.loads(text)
        return cls(*(np.array(d[n]) for n in ("start", "trans", "means", "vars", "durations")), float(d["log_likelihood"]))

    def _logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.log(self.trans + 1e-300)
        np.fill_diagonal(a, NEVER)
        return np.log(self.start + 1e-300), a, np.log(self.durations)

    def _running(self, x: np.ndarray) -> np.ndarray:
        b = log_emission(x, self.means, self.vars)
        return np.concatenate([np.zeros((len(b), 1, self.k)), np.cumsum(b, 1)], 1)

    def viterbi(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels (n, T) and scores of the best segmentations; of equal ones the shorter last segment, the lower state."""
        pi, a, dur = self._logs()
        run = self._running(x)
        n, t_all = x.shape[:2]
        most = min(self.durations.shape[1], t_all)
        entry, source = np.empty((n, t_all, self.k)), np.full((n, t_all, self.k), -1)
        best, length = np.empty((n, t_all, self.k)), np.empty((n, t_all, self.k), np.int64)
        entry[:, 0] = pi
        for t in range(t_all):
            if t:
                step = best[:, t - 1, :, None] + a
                entry[:, t], source[:, t] = step.max(1), step.argmax(1)
            starts = np.arange(t, max(t - most, -1), -1)  # durations 1, 2, ...
            cand = entry[:, starts] - run[:, starts] + dur.T[: len(starts)]
            length[:, t] = cand.argmax(1) + 1
            best[:, t] = cand.max(1) + run[:, t + 1]
        labels, who = np.empty((n, t_all), np.int64), np.arange(n)
        state, t = best[:, -1].argmax(1), np.full(n, t_all - 1)
        left = np.ones(n, bool)
        while left.any():
            i = who[left]
            d = length[i, t[i], state[i]]
            first = t[i] - d + 1
            steps = np.arange(t_all)
            labels[i] = np.where((steps >= first[:, None]) & (steps <= t[i][:, None]), state[i][:, None], labels[i])
            before = source[i, first, state[i]]
            t[i], state[i] = first - 1, np.where(first > 0, before, state[i])
            left[i] = first > 0
        return labels, best[:, -1].max(1)

    def likelihood(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihoods whose last segment may go on beyond the end."""
        pi, a, dur = self._logs()
        after = np.log(np.cumsum(self.durations[:, ::-1], 1)[:, ::-1])  # P(duration >= d)
        run = self._running(x)
        n, t_all = x.shape[:2]
        most = min(self.durations.shape[1], t_all)
        entry, done = np.empty((n, t_all, self.k)), np.empty((n, t_all, self.k))
        entry[:, 0] = pi
        for t in range(t_all):
            if t:
                entry[:, t] = log_sum(done[:, t - 1, :, None] + a, 1)
            starts = np.arange(t, max(t - most, -1), -1)
            done[:, t] = log_sum(entry[:, starts] - run[:, starts] + dur.T[: len(starts)], 1) + run[:, t + 1]
        starts = np.arange(t_all - 1, max(t_all - 1 - most, -1), -1)
        last = entry[:, starts] - run[:, starts] + after.T[: len(starts)] + run[:, t_all][:, None]
        return log_sum(last.reshape(n, -1), 1)

    def statistics(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Counts of the best segmentation: emissions, changes, starts and runs."""
        labels, scores = self.viterbi(x)
        n, t_all = labels.shape
        flat, k = x.reshape(-1, x.shape[-1]), self.k
        one = np.eye(k)[labels.ravel()]
        changed = labels[:, 1:] != labels[:, :-1]
        moves = np.zeros((k, k))
        np.add.at(moves, (labels[:, :-1][changed], labels[:, 1:][changed]), 1)
        begins = np.concatenate([np.ones((n, 1), bool), changed], 1).ravel()
        at = np.flatnonzero(begins)
        lengths, states = np.diff(np.append(at, n * t_all)), labels.ravel()[at]
        power = lambda p: np.bincount(states, lengths.astype(float) ** p, k)
        return {"n": one.sum(0), "x": one.T @ flat, "xx": one.T @ (flat * flat), "moves": moves, "starts": np.bincount(labels[:, 0], minlength=k).astype(float), "runs": power(0), "len": power(1), "len2": power(2), "score": np.array([scores.sum()])}


def initial(sequences: DataFrame, k: int, most: int, seed: int) -> HSMM:
    means, variances = start_means(sequences, k, seed)
    return HSMM(np.full(k, 1 / k), row_shares(np.zeros((k, k)), ~np.eye(k, dtype=bool)), means, np.tile(variances + MIN_COVAR, (k, 1)), duration_pmf(np.full(k, 3.0), np.full(k, 2.0), most))


def improved(m: HSMM, s: dict[str, np.ndarray]) -> HSMM:
    """Parameters from the counts; states with at most one step keep their emissions, states without a run last 3 steps (variance 2)."""
    steps, runs, smooth = s["n"][:, None], s["runs"], 1e-3
    seen = steps[:, 0] > 1
    means, variances = m.means.copy(), m.vars.copy()
    means[seen] = s["x"][seen] / steps[seen]
    variances[seen] = np.maximum(s["xx"][seen] / steps[seen] - means[seen] ** 2, 0) + MIN_COVAR
    length, spread = np.full(m.k, 3.0), np.full(m.k, 2.0)
    np.divide(s["len"], runs, out=length, where=runs > 0)
    often = runs > 1
    spread[often] = s["len2"][often] / runs[often] - length[often] ** 2
    start = row_shares(s["starts"][None] + smooth, np.ones((1, m.k), bool))[0]
    return HSMM(start, row_shares(s["moves"], ~np.eye(m.k, dtype=bool)), means, variances, duration_pmf(length, spread, m.durations.shape[1]))


def fit(sequences: DataFrame, k: int, most: int, n_iter: int = 25, tol: float = 1e-2, seed: int = 42) -> HSMM:
    """Hard EM: stops when the best paths' score changes by less than tol of itself, after the third round at the earliest."""
    m, last, history, converged = initial(sequences, k, most, seed), -np.inf, [], False
    for i in range(n_iter):
        s = summed(sequences, m.statistics)
        if not s:
            return m
        m = improved(m, s)
        history.append(float(s["score"][0]))
        if i > 2 and abs(history[-1] - last) < tol * abs(last):
            converged = True
            break
        last = history[-1]
    m.log_likelihood, m.history, m.converged = score(sequences, m), history, converged
    return m


def best_of(sequences: DataFrame, k: int, most: int, reinits: int = 5, seed: int = 42, **options) -> tuple[HSMM, list[HSMM]]:
    fits = [fit(sequences, k, most, seed=seed + 31 * r, **options) for r in range(reinits)]
    return max(fits, key=lambda f: f.log_likelihood), fits


def score(sequences: DataFrame, model: HSMM) -> float:
    s = summed(sequences, lambda x: {"ll": np.array([model.likelihood(x).sum()])})
    return float(s["ll"][0]) if s else 0.0


def decode(sequences: DataFrame, model: HSMM, keys: list[str]) -> DataFrame:
    """keys, labels, the best path's score and the censored log-likelihood of each sequence."""

    def run(x: np.ndarray) -> list[list]:
        labels, scores = model.viterbi(x)
        return [labels.tolist(), scores.tolist(), model.likelihood(x).tolist()]

    return per_sequence(sequences, keys, "labels array<int>, path_score double, log_likelihood double", run)
