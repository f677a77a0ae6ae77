"""Model comparison: a sweep of state numbers, sticky priors, the semi-Markov model and a topic model side by side."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave import constants as C
from gridweave.functions import columns as X
from gridweave.operators import agreement, inference, sequences
from gridweave.operators.models import hmm, hsmm

KAPPAS = (1, 10, 50, 100)


def long_labels(decoded: DataFrame, keys: list[str]) -> DataFrame:
    return decoded.select(*keys, F.posexplode("labels").alias("t", "state"))


def mean_reinit_ari(train: DataFrame, models: list, decode, keys: list[str]) -> float:
    """Mean adjusted Rand index over the pairs of fits."""
    if len(models) < 2:
        return float("nan")
    own = [long_labels(decode(train, m, keys), keys).withColumnRenamed("state", f"s{i}") for i, m in enumerate(models)]
    j = own[0]
    for o in own[1:]:
        j = j.join(o, [*keys, "t"])
    return float(np.mean([agreement.adjusted_rand(j, f"s{a}", f"s{b}").first()["ari"] for a, b in combinations(range(len(models)), 2)]))


def _row(name: str, model, fits: list, module, train: DataFrame, holdout: DataFrame, keys: list[str]) -> dict:
    steps = train.agg(F.sum(F.size("x"))).first()[0] or 0
    held = holdout.agg(F.sum(F.size("x"))).first()[0] or 0
    ll = module.score(holdout, model)
    labels = long_labels(module.decode(train, model, keys), keys)
    coherence = sequences.coherence(labels, keys, "t").first()["coherence"]
    most = model.durations.shape[1] if hasattr(model, "durations") else train.agg(F.max(F.size("x"))).first()[0]
    spark = train.sparkSession
    if hasattr(model, "durations"):
        implied = spark.createDataFrame([(k, d + 1, float(model.durations[k, d])) for k in range(model.k) for d in range(most)], "state int, duration int, q double")
    else:
        stay = spark.createDataFrame([(k, float(model.trans[k, k])) for k in range(model.k)], "state int, a double")
        implied = sequences.geometric_pmf(stay, most)
    pmf = sequences.duration_pmf(sequences.runs(labels, keys, "t"), most)
    kl = sequences.duration_kl(pmf, implied, labels.groupBy("state").agg(F.count("*").cast("double").alias("w")), most).first()["duration_kl"]
    return {
        "model": name,
        "k": model.k,
        "n_params": model.n_params(),
        "train_ll": model.log_likelihood,
        "bic": inference.information_criterion(model.log_likelihood, model.n_params(), max(steps, 1)),
        "holdout_avg_ll": ll / held if held else float("nan"),
        "holdout_perplexity": float(np.exp(min(-ll / held, 700))) if held else float("nan"),
        "reinit_ari": mean_reinit_ari(train, fits, module.decode, keys),
        "ll_spread": float(max(f.log_likelihood for f in fits) - min(f.log_likelihood for f in fits)),
        "coherence": coherence,
        "duration_kl": kl,
    }


def state_sweep(train: DataFrame, holdout: DataFrame, keys: list[str], ks=range(4, 10), reinits: int = 5, n_iter: int = 40) -> list[dict]:
    """One row a number of states."""
    out = []
    for k in ks:
        best, fits = hmm.best_of(train, k, reinits, C.SEED + 1000 * k, n_iter=n_iter)
        out.append(_row(f"HMM{k}", best, fits, hmm, train, holdout, keys))
    return out


def ladder(train: DataFrame, holdout: DataFrame, keys: list[str], k: int = 7, most: int = 19, reinits: int = 5, n_iter: int = 30, kappas=KAPPAS) -> list[dict]:
    """Plain HMMs of k and k - 1 states, sticky ones, and the semi-Markov model. Its criterion and perplexity are not comparable with the others'."""
    out = []
    for name, states, kappa in [(f"HMM{k}", k, 0.0), (f"HMM{k - 1}", k - 1, 0.0), *((f"sticky{c:g}", k, float(c)) for c in kappas)]:
        best, fits = hmm.best_of(train, states, reinits, n_iter=n_iter, kappa=kappa)
        out.append(_row(name, best, fits, hmm, train, holdout, keys))
    best, fits = hsmm.best_of(train, k, most, reinits)
    out.append(_row("HSMM", best, fits, hsmm, train, holdout, keys))
    return out


def token_vectors(rows: DataFrame, vocabulary: int) -> DataFrame:
    """rows(tokens) with `features`, a count of each token."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(vocabulary - 1)), lambda v: F.size(F.filter("tokens", lambda t: t == v)).cast("double"))
    return rows.withColumn("features", array_to_vector(counts))


def topics(train: DataFrame, rows: DataFrame, vocabulary: int, k: int = 7, max_iter: int = 15, seed: int = C.SEED) -> tuple[DataFrame, float]:
    """rows with `state`, their most probable topic, and the perplexity of a token on rows."""
    model = LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online").fit(token_vectors(train, vocabulary))
    vectors = token_vectors(rows, vocabulary)
    out = model.transform(vectors).withColumn("state", X.arg_max(vector_to_array("topicDistribution"))).drop("features", "topicDistribution")
    return out, float(np.exp(model.logPerplexity(vectors)))


def emission_table(means: np.ndarray, parameters: dict[str, float]) -> list[dict]:
    """What each state's mean emission says in counts and shares; parameters is the row of fit_transform_parameters as a dict."""
    out = []
    for k, m in enumerate(means):
        presence, stay = m[0] * parameters["presence_log_s"] + parameters["presence_log_m"], m[1] * parameters["stay_vol_log_s"] + parameters["stay_vol_log_m"]
        block = lambda name, at, n: np.array([m[at + i] * (parameters[f"{name}_{i}_s"] or 1.0) + parameters[f"{name}_{i}_m"] for i in range(n)])  # noqa: E731,B023
        share = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
        mix, dwell = share(block("clr_mix", 2, len(C.MIX))), share(block("clr_dwell", 2 + len(C.MIX), len(C.DWELL)))
        top = sorted(range(len(mix)), key=lambda i: (-mix[i], i))[:3]
        out.append({"state": k, "mean_total_pop": float(np.expm1(presence)), "stay_vol": float(np.expm1(stay)), "short000": float(dwell[0]), "long240": float(dwell[-1]), "dwell_missing": float(m[-2]), "top_demo": ";".join(f"{C.MIX[i][4:]}={mix[i]:.2f}" for i in top)})
    return out
