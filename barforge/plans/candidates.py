"""Queries of candidates over splits, importance and allocation from a head's parameters, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as cd
from ..operators import cpcv
from ..operators import metrics as mt
from ..operators import models as ml
from ..operators import selection as sl
from . import oracle as o
from .evaluation import _PATHS, _VOL, EVENTS, PRED, SPLIT_A, _metrics, _sh, events_of, predictions_of
from .modelling import _FE, _PREP, features_of
from .technical import bars_of, rounded

#: Columns of the fixed candidates, and their weights with the intercept last.
USED = ["ret_5d", "vol_20d", "price_vs_sma20", "donchian_pos_20d"]
WEIGHTS = {"reversal": (-0.8, 0.1, -0.3, 0.0, 0.05), "trend": (0.6, -0.2, 0.4, 0.3, 0.0), "calm": (0.0, -1.0, 0.1, 0.0, 0.1), "wild": (0.1, 0.9, 0.0, -0.2, -0.1), "position": (0.0, 0.0, 0.3, -0.7, 0.2)}
FIXED = [cd.Candidate(k, "fixed", weights=w) for k, w in WEIGHTS.items()]
LEARNED = [
    cd.Candidate("l2_C0.1__none", "l2", C=0.1), cd.Candidate("l1_C0.1__corr_cluster", "l1", "corr_cluster", 0.1), cd.Candidate("elastic_C1__pca", "elastic", "pca"), cd.Candidate("l2_C1__cluster_pca", "l2", "cluster_pca"),
    cd.Candidate("l2_C0.1__linkage", "l2", "linkage", 0.1), cd.Candidate("vsn__none", "vsn", params=(("epochs", 5), ("hidden", 8))),
]
CUT = "1997-01-01"


def events_with(spark, sf_dir, cols):
    e = events_of(spark, sf_dir).withColumnRenamed("metalabel", "y_true")
    f = features_of(spark, sf_dir).select("date", "instrument", *[(F.round(c, 6) + 0.0).alias(c) for c in cols])
    return e.join(f, ["instrument", "date"])


def oof_of(spark, sf_dir):
    """Out-of-fold scores of the fixed candidates: from six digits on, so that equal scores are equal everywhere."""
    splits = cpcv.splits_by_rows(events_of(spark, sf_dir))
    return cd.run(events_with(spark, sf_dir, USED), splits, USED, FIXED).withColumn("y_proba", F.round("y_proba", 6))


def _scores(spark, sf_dir):
    return rounded(oof_of(spark, sf_dir).select("instrument", "split_id", "block_id", "date", "candidate", "y_true", "y_proba"))


def comparison_of(spark, sf_dir):
    return cd.summary(oof_of(spark, sf_dir))


def _comparison(spark, sf_dir):
    return rounded(comparison_of(spark, sf_dir))


def _ticker(df):
    """Measures of eight digits, as a table of results has them, so that ties are ties everywhere."""
    measures = ("mean_auc", "std_auc", "median_auc", "median_path_trade_sharpe", "path_sharpe_iqr")
    return df.withColumnRenamed("instrument", "ticker").withColumns({c: F.round(c, 8) for c in measures})


def _top3(spark, sf_dir):
    return rounded(mt.top3_then_sharpe(_ticker(comparison_of(spark, sf_dir))).select("ticker", "candidate", "auc_rank", "mean_auc", "median_path_trade_sharpe"))


def _upsert(spark, sf_dir):
    c = _ticker(comparison_of(spark, sf_dir)).select("ticker", "candidate", "mean_auc", "n_folds")
    new = c.where("candidate = 'trend' and mean_auc > 0.5").withColumn("mean_auc", 1 - F.col("mean_auc"))
    return rounded(mt.upsert(c, new, "candidate", "trend"))


def _refit(spark, sf_dir):
    scored = cd.refit(events_with(spark, sf_dir, USED), CUT, USED, FIXED[:2]).withColumn("y_proba", F.round("y_proba", 6))
    return rounded(mt.binary_metrics(scored, ["instrument", "candidate", "part"], p="y_proba").select("instrument", "candidate", "part", "n", "tp", "fp", "accuracy", "roc_auc", "average_precision", "log_loss"))


def _stages(spark, sf_dir):
    folds = mt.binary_metrics(oof_of(spark, sf_dir), ["candidate", "instrument", "split_id"], p="y_proba")
    return cd.stage_summary(folds, ["candidate"], ["roc_auc", "f1", "accuracy"])


def _learned(spark, sf_dir):
    splits = cpcv.splits_by_rows(events_of(spark, sf_dir), n=4).where("split_id <= 3")
    return cd.summary(cd.run(events_with(spark, sf_dir, [*USED, "ret_1d", "ret_20d"]), splits, [*USED, "ret_1d", "ret_20d"], LEARNED))


def _permutation(spark, sf_dir):
    return cd.permutation_importance(events_with(spark, sf_dir, USED), CUT, USED, cd.Candidate("l2", C=0.1), repeats=5)


#: Parameters of a head as training gives them: weight, mean and deviation of each feature, and a bias an instrument.
HEAD = [("vol_20d", 0.4, 0.47, 0.15), ("ret_5d", -0.3, 0.0, 0.07), ("probability_edge", 0.9, 0.1, 0.2), ("bias:A", 0.1, None, None), ("bias:N", -0.2, None, None), ("bias:R", 0.3, None, None)]


def head_rows(spark, sf_dir):
    feats = features_of(spark, sf_dir).select("date", "instrument", *[(F.round(c, 6) + 0.0).alias(c) for c in ("vol_20d", "ret_5d")])
    return ml.head_dataset(predictions_of(spark, sf_dir), feats, bars_of(spark, sf_dir))


def _head_dataset(spark, sf_dir):
    return rounded(head_rows(spark, sf_dir))


def _head_weights(spark, sf_dir):
    params = spark.createDataFrame(HEAD, "feature string, weight double, mean double, std double")
    return rounded(ml.head_weights(head_rows(spark, sf_dir), params).select("date", "instrument", "neural_conviction", "neural_strength", "raw_weight", "capped_weight", "weight"))


def _information(spark, sf_dir):
    return rounded(sl.mutual_information(events_with(spark, sf_dir, USED), USED, "y_true"))


def _linkage(spark, sf_dir):
    cols = [*USED, "ret_1d", "ret_20d", "roc_5d"]
    return rounded(sl.linkage_selection(events_with(spark, sf_dir, cols), cols, "y_true"))


QUERIES = {
    "cpcv_candidate_scores": _scores, "model_comparison": _comparison, "top3_then_sharpe": _top3, "comparison_upsert": _upsert, "refit_metrics": _refit, "stage_summary": _stages, "cpcv_learned": _learned, "permutation_importance": _permutation,
    "head_dataset": _head_dataset, "head_inference": _head_weights, "mutual_information": _information, "linkage_selection": _linkage,
}

# ---- the same in SQL -------------------------------------------------------------------------------------------------

_FEATURES = ", " + _PREP[len(o.BARS) + 2 :].split(", lf AS (")[0]
assert _FEATURES.endswith("FROM p)") and _FE in _PREP


def _scaled(source: str, by: str) -> str:
    """``cs``: rows of ``source`` (with ``by``, role and the columns) with the columns clipped, filled and standardised by the training rows of ``by``."""
    edges = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}, quantile_cont({c}, 0.5) AS md_{c}" for c in USED)
    full = ", ".join(f"CASE WHEN {c} IS NULL THEN coalesce(md_{c}, 0) ELSE greatest(lo_{c}, least(hi_{c}, {c})) END AS x_{c}" for c in USED)
    stats = ", ".join(f"avg(x_{c}) AS mn_{c}, stddev_pop(x_{c}) AS sd_{c}" for c in USED)
    z = ", ".join(f"(x_{c} - mn_{c}) / CASE WHEN sd_{c} > 0 THEN sd_{c} ELSE 1 END AS z_{c}" for c in USED)
    classes = "HAVING count(DISTINCT y_true) = 2"
    return f", cq AS (SELECT {by}, {edges} FROM {source} WHERE role = 'train' GROUP BY {by} {classes}), cx AS (SELECT s.*, {full} FROM {source} s JOIN cq USING ({by})), ct AS (SELECT {by}, {stats} FROM cx WHERE role = 'train' GROUP BY {by}), cs AS (SELECT cx.*, {z} FROM cx JOIN ct USING ({by}))"


def _scored(names) -> str:
    """``co``: a row of ``cs`` for each candidate, with its score."""
    rows = ", ".join(f"('{k}', {', '.join(f'{w!r}::DOUBLE' for w in WEIGHTS[k])})" for k in names)
    dot = " + ".join(f"w{i} * z_{c}" for i, c in enumerate(USED))
    return f", cw AS (SELECT * FROM (VALUES {rows}) z(candidate, {', '.join(f'w{i}' for i in range(len(USED) + 1))})), co AS (SELECT cs.*, candidate, round(1 / (1 + exp(-({dot} + w{len(USED)}))), 6) AS y_proba FROM cs, cw)"


_EV = ", ex AS (SELECT evs.instrument, evs.date, evs.metalabel AS y_true, evs.signed_touch_return, " + ", ".join(USED) + " FROM evs JOIN fe USING (instrument, date))"
_CPCV = SPLIT_A + _FEATURES + _EV + ", rx AS (SELECT rl.split_id, rl.block_id, rl.role, ex.* FROM rl JOIN ex USING (instrument, date))" + _scaled("rx", "instrument, split_id") + _scored(WEIGHTS) + ", oo AS (SELECT * FROM co WHERE role = 'test')"
_COMPARE = (
    _CPCV
    + _metrics("oo", "instrument, candidate, split_id", "y_proba")
    + ", fs AS (SELECT instrument, candidate, avg(roc_auc) AS mean_auc, quantile_cont(roc_auc, 0.5) AS median_auc, stddev_samp(roc_auc) AS std_auc, count(roc_auc) AS n_folds FROM mm GROUP BY instrument, candidate)"
    + _PATHS.format(source="oo")
    + f", pp AS (SELECT instrument, candidate, path_id, {_sh('t')} AS sharpe FROM (SELECT oo.*, path_id, CASE WHEN y_proba >= 0.5 THEN signed_touch_return END AS t FROM oo JOIN ph USING (instrument, split_id, block_id)) GROUP BY instrument, candidate, path_id)"
    + ", ps AS (SELECT instrument, candidate, quantile_cont(sharpe, 0.5) AS median_path_trade_sharpe, avg(sharpe) AS mean_path_trade_sharpe, quantile_cont(sharpe, 0.75) - quantile_cont(sharpe, 0.25) AS path_sharpe_iqr, count(sharpe) AS n_cpcv_paths FROM pp GROUP BY instrument, candidate)"
    + ", cc AS (SELECT * FROM fs JOIN ps USING (instrument, candidate)), cd AS (SELECT instrument AS ticker, candidate, n_folds, round(mean_auc, 8) AS mean_auc, round(std_auc, 8) AS std_auc, round(median_auc, 8) AS median_auc, round(median_path_trade_sharpe, 8) AS median_path_trade_sharpe, round(path_sharpe_iqr, 8) AS path_sharpe_iqr FROM cc)"
)
_r = lambda *cols: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)
_REFIT = EVENTS + _FEATURES + _EV + f", rx AS (SELECT *, CASE WHEN date < DATE '{CUT}' THEN 'train' ELSE 'test' END AS role FROM ex)" + _scaled("rx", "instrument") + _scored([c.candidate for c in FIXED[:2]]) + ", oo AS (SELECT *, role AS part FROM co)"
_HEAD = (
    _VOL
    + _FEATURES
    + f", hn AS (SELECT date, instrument, {o.lead('ret')} AS next_return FROM (SELECT date, instrument, close / {o.lag('close')} - 1 AS ret FROM bars)), hd AS (SELECT pr.date, pr.instrument, primary_signal, greatest(0.0::DOUBLE, least(1.0::DOUBLE, prediction)) AS prediction, vol_20d, ret_5d, next_return, annualized_ewma_vol FROM pr LEFT JOIN fe USING (date, instrument) LEFT JOIN hn USING (date, instrument) LEFT JOIN av USING (date, instrument) WHERE annualized_ewma_vol > 0), hg AS (SELECT *, prediction - 0.5 AS probability_edge, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (prediction - 0.5) / 0.5)) AS probability_confidence, CASE WHEN prediction > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS probability_gate FROM hd)"
)
_z = " + ".join(f"({w!r}::DOUBLE * (coalesce({k}, {m!r}::DOUBLE) - {m!r}::DOUBLE) / {s!r}::DOUBLE)" for k, w, m, s in HEAD if m is not None)
_bias = " ".join(f"WHEN '{k[5:]}' THEN {w!r}::DOUBLE" for k, w, m, _ in HEAD if m is None)
_WEIGHTS = _HEAD + f", h1 AS (SELECT *, tanh((CASE instrument {_bias} END) + {_z}) AS neural_conviction FROM hg), h2 AS (SELECT *, pow(neural_conviction, 2) AS neural_strength, primary_signal * probability_gate * pow(neural_conviction, 2) * 0.10::DOUBLE / annualized_ewma_vol AS raw_weight FROM h1), h3 AS (SELECT *, greatest(-0.25::DOUBLE, least(0.25::DOUBLE, raw_weight)) AS capped_weight FROM h2), h4 AS (SELECT *, sum(abs(capped_weight)) OVER (PARTITION BY date) AS g FROM h3)"
_edges = ", ".join(str(i / 10) for i in range(1, 10))
_long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, y_true FROM ex WHERE {c} IS NOT NULL" for c in USED)

ORACLES = {
    "cpcv_candidate_scores": f"WITH RECURSIVE {_CPCV} SELECT instrument, split_id, block_id, date, candidate, y_true, y_proba FROM oo",
    "model_comparison": f"WITH RECURSIVE {_COMPARE} SELECT instrument, candidate, n_folds, n_cpcv_paths, {_r('mean_auc', 'median_auc', 'std_auc', 'median_path_trade_sharpe', 'mean_path_trade_sharpe', 'path_sharpe_iqr')} FROM cc",
    "top3_then_sharpe": f"WITH RECURSIVE {_COMPARE}, t3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY mean_auc DESC NULLS LAST, std_auc NULLS LAST, median_auc DESC NULLS LAST, candidate) AS INTEGER) AS auc_rank FROM cd), tb AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY median_path_trade_sharpe DESC NULLS LAST, path_sharpe_iqr NULLS LAST, mean_auc DESC NULLS LAST, std_auc NULLS LAST, candidate) AS k FROM t3 WHERE auc_rank <= 3) SELECT ticker, candidate, auc_rank, {_r('mean_auc', 'median_path_trade_sharpe')} FROM tb WHERE k = 1",
    "comparison_upsert": f"WITH RECURSIVE {_COMPARE} SELECT ticker, candidate, n_folds, {_r('mean_auc')} FROM (SELECT ticker, candidate, n_folds, mean_auc FROM cd WHERE candidate <> 'trend' UNION ALL SELECT ticker, candidate, n_folds, 1 - mean_auc FROM cd WHERE candidate = 'trend' AND mean_auc > 0.5)",
    "refit_metrics": f"WITH RECURSIVE {_REFIT}{_metrics('oo', 'instrument, candidate, part', 'y_proba')} SELECT instrument, candidate, part, n, tp, fp, {_r('accuracy', 'roc_auc', 'average_precision', 'log_loss')} FROM mm",
    "stage_summary": f"WITH RECURSIVE {_CPCV}{_metrics('oo', 'candidate, instrument, split_id', 'y_proba')} SELECT candidate, " + ", ".join(f"round(avg({m}), 4) AS {m}_mean, round(stddev_samp({m}), 4) AS {m}_std" for m in ("roc_auc", "f1", "accuracy")) + " FROM mm GROUP BY candidate",
    "head_dataset": f"WITH RECURSIVE {_HEAD} SELECT date, instrument, primary_signal, {_r('prediction', 'vol_20d', 'ret_5d', 'next_return', 'annualized_ewma_vol', 'probability_edge', 'probability_confidence', 'probability_gate')} FROM hg",
    "head_inference": f"WITH RECURSIVE {_WEIGHTS} SELECT date, instrument, {_r('neural_conviction', 'neural_strength', 'raw_weight', 'capped_weight')}, round(capped_weight * CASE WHEN g > 1 THEN 1 / g ELSE 1 END, 6) + 0.0 AS weight FROM h4",
    "mutual_information": f"WITH RECURSIVE {EVENTS}{_FEATURES}{_EV}, ml AS ({_long}), me AS (SELECT feature, quantile_cont(v, [{_edges}]) AS e FROM ml GROUP BY feature), mb AS (SELECT feature, len(list_filter(e, lambda q: q < v)) AS bin, y_true FROM ml JOIN me USING (feature)), mc AS (SELECT feature, bin, y_true, count(*) AS n FROM mb GROUP BY ALL), mt AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y_true) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM mc) SELECT feature, CAST(max(nn) AS BIGINT) AS n, round(sum(n / nn * ln(n * nn / (nb * ny))), 6) + 0.0 AS information FROM mt GROUP BY feature",
}
