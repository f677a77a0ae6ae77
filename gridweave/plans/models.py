"""Queries over fitted models: rows-only checks, as fits are iterative."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import features, report
from gridweave.operators.models import hmm, hsmm, ladder
from gridweave.plans import regimes
from gridweave.plans.features import _emission, _rows, rounded
from gridweave.session import ensure_checkpoint_dir
from gridweave.sources.domain import BLOCK

KEYS, SAMPLED = ["cell_id", "date"], 2000


def _sequences(spark, sf):
    """Complete days of blocks of users; none where the tables are too small for any."""
    ensure_checkpoint_dir(spark)  # every round of a fit reads them again
    return features.sequences(features.full_cycles(_rows(spark, sf, BLOCK))).checkpoint()


def hmm_decode(spark, sf):
    seq = _sequences(spark, sf)
    return hmm.decode(seq, hmm.fit(seq, 7), KEYS)


def hsmm_decode(spark, sf):
    """Fitted on sampled training days; all days are decoded with the parameters as they are stored."""
    seq = _sequences(spark, sf)
    keys = features.sample_keys(seq.select(*KEYS, "split"), {"train": SAMPLED})
    stored = hsmm.fit(seq.join(keys.select(*KEYS), KEYS, "left_semi"), 7, 19).to_json()
    return rounded(hsmm.decode(seq, hsmm.HSMM.from_json(stored), KEYS))


def model_ladder(spark, sf):
    seq = _sequences(spark, sf)
    rows = ladder.ladder(seq, seq.where("split = 'holdout'"), KEYS, k=3, reinits=2, n_iter=4, kappas=(10,)) if not seq.isEmpty() else []
    return _compared(spark, rows)


def lda_topics(spark, sf):
    ensure_checkpoint_dir(spark)
    rows = _rows(spark, sf, BLOCK)
    t = features.tokens(rows, features.quantile_edges(rows.where("split = 'train'"), 24), 24).checkpoint()
    out, _ = ladder.topics(t.where("split = 'train'"), t, 122, k=7, max_iter=15)
    return out.groupBy("state").agg(F.count("*").alias("n"))


EMISSIONS = "state int, mean_total_pop double, stay_vol double, short000 double, long240 double, dwell_missing double, top_demo string"
LADDER = "model string, k int, n_params int, train_ll double, bic double, holdout_avg_ll double, holdout_perplexity double, reinit_ari double, ll_spread double, coherence double, duration_kl double"


def _compared(spark, rows):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r.values()) for r in rows], LADDER)


def state_sweep(spark, sf):
    seq = _sequences(spark, sf)
    return _compared(spark, ladder.state_sweep(seq, seq.where("split = 'holdout'"), KEYS, ks=(2, 3), reinits=2, n_iter=4) if not seq.isEmpty() else [])


def state_emissions(spark, sf):
    em = _emission(spark, sf, BLOCK)
    parameters = features.fit_transform_parameters(em).first().asDict()
    seq = _sequences(spark, sf)
    if seq.isEmpty():
        return spark.createDataFrame([], EMISSIONS)
    return spark.createDataFrame(ladder.emission_table(hsmm.fit(seq, 7, 19).means, parameters), EMISSIONS)


def regime_characteristics(spark, sf):
    return rounded(report.regime_characteristics(state_emissions(spark, sf), regimes.state_activation(spark, sf)))


QUERIES = {f.__name__: f for f in (hmm_decode, hsmm_decode, model_ladder, state_sweep, lda_topics, state_emissions, regime_characteristics)}
SQL: dict[str, str] = {}
