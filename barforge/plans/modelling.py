"""Queries of regimes, selection and models, and the same in SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as ml
from ..operators import regimes as rg
from ..operators import selection as sl
from ..operators import signals as sg
from ..operators import technical as ta
from ..sources.bars import signals_from_bars
from . import oracle as o
from .evaluation import EVENTS, events_of, predictions_of
from .labelling import MARKET, MARKET_CTE, RUN_CTE, SIG
from .technical import bars_of, rounded

COLS = ["ret_1d", "ret_5d", "ret_20d", "roc_5d", "vol_20d", "park_vol_20d", "price_vs_sma20", "zscore_20d", "donchian_pos_20d", "hl_range"]


def features_of(spark, sf_dir):
    """A few features, one of them (roc_5d) another's copy."""
    df = ta.prepare(bars_of(spark, sf_dir))
    c = {**ta.returns((1, 5, 20)), **ta.rate_of_change((5,)), **ta.rolling_volatility((20,)), **ta.parkinson((20,)), **ta.sma_vs_price((20,)), **ta.price_zscore((20,)), **ta.donchian((20,)), **ta.price_ranges()}
    return df.select("date", "instrument", *[c[k].alias(k) for k in COLS])


def _rounded_features(spark, sf_dir):
    f = features_of(spark, sf_dir)
    return f.select("date", "instrument", *[(F.round(c, 6) + 0.0).alias(c) for c in COLS])


def model_rows(spark, sf_dir):
    e = events_of(spark, sf_dir).select("instrument", "date", "primary_signal", F.col("metalabel").alias("label"))
    return e.join(features_of(spark, sf_dir), ["instrument", "date"])


def fixed_regimes(spark, sf_dir):
    return rg.filter_fixed(rg.observations(bars_of(spark, sf_dir)))


def _hmm_filter(spark, sf_dir):
    return rounded(fixed_regimes(spark, sf_dir))


def _map(spark, sf_dir):
    return rounded(rg.regime_map(fixed_regimes(spark, sf_dir), bars_of(spark, sf_dir)))


def _mass(spark, sf_dir):
    r = fixed_regimes(spark, sf_dir)
    return rounded(rg.category_mass(r, rg.regime_map(r, bars_of(spark, sf_dir))))


def _observations(spark, sf_dir):
    return rounded(rg.observations(bars_of(spark, sf_dir)))


def _hmm_fit(spark, sf_dir):
    return rg.detect(rg.observations(bars_of(spark, sf_dir)), "1996-12-31")


def star_of(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    r = fixed_regimes(spark, sf_dir)
    names = rg.regime_map(r, bars)
    labels = names.select("instrument", "hmm_predicted_regime", "hmm_volatility_regime", "hmm_return_regime", "hmm_market_state")
    named = r.join(labels, ["instrument", "hmm_predicted_regime"], "left")
    signals = signals_from_bars(bars).where("primary_signal is not null")
    ret = ta.prepare(bars).select("date", "instrument", ta.simple_return(5).alias("ret_5d"))
    return sg.interactions(sg.encode_regimes(sg.star_matrix(signals, bars, ret, named, rg.category_mass(r, names), sg.market_features(bars), sg.signal_behaviour(signals))))


def _star(spark, sf_dir):
    return rounded(star_of(spark, sf_dir))


def _profile(spark, sf_dir):
    return rounded(sl.profile(_rounded_features(spark, sf_dir), COLS), 8)  # quantiles between values of six digits


def _families(spark, sf_dir):
    return rounded(sl.missing_by_family(_rounded_features(spark, sf_dir), COLS))


def _pairs(method):
    return lambda spark, sf_dir: rounded(sl.pair_correlations(_rounded_features(spark, sf_dir), COLS, method))


def _target(spark, sf_dir):
    f = _rounded_features(spark, sf_dir)
    p = predictions_of(spark, sf_dir).select("instrument", "date", "y_true")
    return rounded(sl.target_correlations(f.join(p, ["instrument", "date"]), COLS, "y_true"))


def _clusters(spark, sf_dir):
    f = _rounded_features(spark, sf_dir)
    return sl.clusters(sl.pair_correlations(f, COLS), COLS, 0.8)


def _duplicates(spark, sf_dir):
    return sl.duplicate_columns(_rounded_features(spark, sf_dir), COLS, "date", "instrument")


def _representatives(spark, sf_dir):
    f = _rounded_features(spark, sf_dir)
    p = predictions_of(spark, sf_dir).select("instrument", "date", "y_true")
    scores = sl.target_correlations(f.join(p, ["instrument", "date"]), COLS, "y_true")
    return sl.representatives(sl.clusters(sl.pair_correlations(f, COLS), COLS, 0.8), sl.profile(f, COLS), scores)


def _pca(spark, sf_dir):
    return sl.principal_components(features_of(spark, sf_dir).na.drop(), [c for c in COLS if c != "roc_5d"])[0]


def _loadings(spark, sf_dir):
    return sl.top_loadings(sl.principal_components(features_of(spark, sf_dir).na.drop(), [c for c in COLS if c != "roc_5d"])[1])


def _model(kind, **params):
    def query(spark, sf_dir):
        rows = model_rows(spark, sf_dir)
        cut = F.col("date") < F.lit("1997-01-01").cast("date")
        out, _ = ml.fit_predict(rows.where(cut), rows.where(~cut), COLS, kind, **params)
        return out.select("instrument", "date", "label", "y_proba")

    return query


def _importance(kind):
    def query(spark, sf_dir):
        rows = model_rows(spark, sf_dir)
        cut = F.col("date") < F.lit("1997-01-01").cast("date")
        _, model = ml.fit_predict(rows.where(cut), rows.where(~cut).limit(1), COLS, kind)
        return ml.cluster_importance(ml.importance(model, COLS, spark), _clusters(spark, sf_dir))

    return query


#: Columns of a head's rows that it doesn't learn from.
NOT_LEARNED = ("primary_signal", "prediction", "next_return", "annualized_ewma_vol", "open", "high", "low", "close", "volume", "open_interest")


def _head(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    rows = ml.head_dataset(predictions_of(spark, sf_dir), ta.build_all_features(bars), bars).where("next_return is not null")
    return ml.train_head(rows, sl.least_missing(rows, sl.numeric_columns(rows, ("date", "instrument", *NOT_LEARNED))))


QUERIES = {
    "hmm_observations": _observations, "hmm_filter": _hmm_filter, "regime_map": _map, "category_mass": _mass, "star_matrix": _star, "profile_columns": _profile, "missing_by_family": _families, "corr_pairs": _pairs("pearson"), "corr_pairs_spearman": _pairs("spearman"),
    "target_corr": _target, "corr_clusters": _clusters, "cluster_representatives": _representatives, "duplicate_columns": _duplicates, "hmm_fit": _hmm_fit, "pca_scores": _pca, "pca_loadings": _loadings, "logistic": _model("l2", C=0.1), "logistic_l1": _model("l1"), "forest": _model("forest"),
    "boosting": _model("boosting"), "network": _model("network"), "forest_importance": _importance("forest"), "logistic_importance": _importance("l2"), "neural_head": _head,
}

# ---- the same in SQL -------------------------------------------------------------------------------------------------

_OBS = SIG + f", ob0 AS (SELECT *, ln(close) - {o.lag('ln(close)')} AS ret_1d, CASE WHEN volume > 0 THEN ln(volume) END AS lv, CASE WHEN open_interest > 0 THEN ln(open_interest) END AS lo FROM bars), ob AS (SELECT date, instrument, ret_1d, ln(close / open) AS intraday_ret, ln(high / low) AS range, lv - {o.lag('lv')} AS volume_chg, lo - {o.lag('lo')} AS open_interest_chg, {o.agg('stddev_samp', 'ret_1d', 20, 10)} AS vol_20d, close FROM ob0)"
_m, _s, _stay, _move = rg.FIXED["mean"], rg.FIXED["sd"], rg.FIXED["stay"], rg.FIXED["move"]
_dens = lambda k: f"exp(-0.5::DOUBLE * (ln(2 * pi() * {_s[k] ** 2!r}::DOUBLE) + pow(x - ({_m[k]!r}::DOUBLE), 2) / {_s[k] ** 2!r}::DOUBLE))"
_HMM = (
    _OBS
    + f", hx AS (SELECT date, instrument, ret_1d AS x, row_number() OVER ({o.W}) AS rn FROM ob WHERE ret_1d IS NOT NULL), hd AS (SELECT *, {', '.join(f'{_dens(k)} AS d{k}' for k in range(4))} FROM hx)"
    + f", hf AS (SELECT instrument, rn, {', '.join(f'd{k} / (d0 + d1 + d2 + d3) AS p{k}' for k in range(4))} FROM hd WHERE rn = 1 UNION ALL SELECT instrument, rn, {', '.join(f'u{k} / (u0 + u1 + u2 + u3)' for k in range(4))} FROM (SELECT d.instrument, d.rn, {', '.join(f'd{k} * ({_move!r}::DOUBLE * (p0 + p1 + p2 + p3 - p{k}) + {_stay!r}::DOUBLE * p{k}) AS u{k}' for k in range(4))} FROM hf JOIN hd d ON d.instrument = hf.instrument AND d.rn = hf.rn + 1) z)"
    + ", hr AS (SELECT date, instrument, p0, p1, p2, p3, greatest(p0, p1, p2, p3) AS conf, CAST(CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END AS INTEGER) AS regime FROM hf JOIN hx USING (instrument, rn))"
)
_MAP = (
    _HMM
    + f", rt AS (SELECT date, instrument, close / {o.lag('close')} - 1 AS dr FROM bars), rv AS (SELECT *, {o.agg('stddev_samp', 'dr', 20, 10)} AS v20 FROM rt), rp AS (SELECT instrument, regime AS hmm_predicted_regime, count(*) AS days, avg(dr) AS avg_daily_return, avg(abs(dr)) AS avg_abs_return, avg(v20) AS avg_realized_vol_20d, avg(conf) AS avg_confidence FROM hr JOIN rv USING (date, instrument) WHERE dr IS NOT NULL AND v20 IS NOT NULL GROUP BY ALL)"
    + f", rl2 AS (SELECT *, {list(sg.VOLATILITY_LABELS)!r}[row_number() OVER (PARTITION BY instrument ORDER BY avg_realized_vol_20d, hmm_predicted_regime)] AS hmm_volatility_regime, {list(sg.RETURN_LABELS)!r}[row_number() OVER (PARTITION BY instrument ORDER BY avg_daily_return, hmm_predicted_regime)] AS hmm_return_regime FROM rp)"
    + ", rm AS (SELECT *, CASE WHEN hmm_volatility_regime IN ('high_vol', 'extreme_vol') THEN CASE WHEN hmm_return_regime IN ('downside', 'weak') THEN 'stress' ELSE 'upside_breakout' END WHEN hmm_return_regime IN ('positive', 'strong_upside') THEN 'calm_positive' ELSE 'calm_negative' END AS hmm_market_state FROM rl2)"
)
_NAMES = [("hmm_volatility_regime", v) for v in sg.VOLATILITY_LABELS] + [("hmm_return_regime", v) for v in sg.RETURN_LABELS] + [("hmm_market_state", v) for v in sg.MARKET_LABELS]
_MASS = (
    _MAP
    + ", hl AS (SELECT date, instrument, k AS hmm_predicted_regime, p FROM (SELECT date, instrument, unnest([0, 1, 2, 3]) AS k, unnest([p0, p1, p2, p3]) AS p FROM hr)), cm0 AS (SELECT hl.date, hl.instrument, "
    + ", ".join(f"coalesce(sum(p) FILTER ({c} = '{v}'), 0.0) AS hmm_prob_{v}" for c, v in _NAMES)
    + " FROM hl LEFT JOIN rm USING (instrument, hmm_predicted_regime) GROUP BY ALL), cm AS (SELECT *, hmm_prob_high_vol + hmm_prob_extreme_vol AS hmm_prob_high_or_extreme_vol, hmm_prob_low_vol + hmm_prob_normal_vol AS hmm_prob_low_or_normal_vol, hmm_prob_downside + hmm_prob_weak AS hmm_prob_downside_or_weak, hmm_prob_positive + hmm_prob_strong_upside AS hmm_prob_positive_or_strong_upside, 1 - hmm_prob_stress AS hmm_prob_not_stress FROM cm0)"
)
_MASSES = [f"hmm_prob_{v}" for _, v in _NAMES] + [f"hmm_prob_{v}" for v in ("high_or_extreme_vol", "low_or_normal_vol", "downside_or_weak", "positive_or_strong_upside", "not_stress")]
_ret = lambda n: f"close / nullif({o.lag('close', n)}, 0) - 1"
_lowhigh = f"({o.agg('max', 'high', 20)}) - ({o.agg('min', 'low', 20)})"
_FSQL = {
    "ret_1d": _ret(1), "ret_5d": _ret(5), "ret_20d": _ret(20), "roc_5d": _ret(5), "vol_20d": f"({o.agg('stddev_samp', 'lr', 20)}) * sqrt(252)", "park_vol_20d": f"sqrt(({o.agg('avg', 'hl2', 20)}) / (4 * ln(2)) * 252)", "price_vs_sma20": o.div(f"close - {o.agg('avg', 'close', 20)}", o.agg("avg", "close", 20)),
    "zscore_20d": o.zscore("close", 20), "donchian_pos_20d": o.div(f"close - ({o.agg('min', 'low', 20)})", _lowhigh), "hl_range": "high - low",
}
_FE = ", fe AS (SELECT date, instrument, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in _FSQL.items()) + " FROM p)"
_LONG = ", lf AS (" + " UNION ALL ".join(f"SELECT date, instrument, '{c}' AS feature, {c} AS value FROM fe" for c in COLS) + ")"
_PREP = o.PREPARED + _FE + _LONG
_PROF = ", pf AS (SELECT feature, avg(CAST(value IS NULL AS INTEGER)) AS missing_rate, count(DISTINCT value) AS nunique, var_samp(value) AS variance, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, count(DISTINCT value) <= 1 AS constant FROM lf GROUP BY feature)"
_PAIR = ", pq AS (SELECT " + "x.feature AS a, y.feature AS b, x.value AS x, y.value AS y FROM lf x JOIN lf y USING (date, instrument) WHERE list_position(" + repr(COLS) + ", x.feature) < list_position(" + repr(COLS) + ", y.feature) AND x.value IS NOT NULL AND y.value IS NOT NULL)"
_CORR = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
ORACLES = {
    "hmm_observations": f"WITH {_OBS} SELECT date, instrument, " + o.rounded(["ret_1d", "intraday_ret", "range", "volume_chg", "open_interest_chg", "vol_20d"]).replace(", 6) AS", ", 6) + 0.0 AS") + " FROM ob",
    "hmm_filter": f"WITH RECURSIVE {_HMM} SELECT date, instrument, regime AS hmm_predicted_regime, round(conf, 6) AS hmm_regime_confidence, " + ", ".join(f"round(p{k}, 6) + 0.0 AS hmm_regime_prob_{k}" for k in range(4)) + " FROM hr",
    "regime_map": f"WITH RECURSIVE {_MAP} SELECT instrument, hmm_predicted_regime, days, hmm_volatility_regime, hmm_return_regime, hmm_market_state, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("avg_daily_return", "avg_abs_return", "avg_realized_vol_20d", "avg_confidence")) + " FROM rm",
    "category_mass": f"WITH RECURSIVE {_MASS} SELECT date, instrument, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _MASSES) + " FROM cm",
    "profile_columns": f"WITH {_PREP}{_PROF} SELECT feature, nunique, constant, " + ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in ("missing_rate", "variance", "q25", "median", "q75")) + " FROM pf",
    "missing_by_family": f"WITH {_PREP}{_PROF}, fm AS (SELECT *, CASE WHEN regexp_matches(feature, 'vol|atr|range') THEN 'vol' WHEN regexp_matches(feature, '^(ret|roc|mom|log_ret)') THEN 'momentum' WHEN regexp_matches(feature, 'sma|ema|macd') THEN 'trend' WHEN regexp_matches(feature, 'rsi|stoch|williams|cci|mfi|^uo') THEN 'oscillator' WHEN regexp_matches(feature, 'bb_|donchian|zscore') THEN 'band' ELSE 'other' END AS family FROM pf) SELECT family, count(*) AS features, round(avg(missing_rate), 6) AS mean_missing_rate FROM fm GROUP BY family",
    "corr_pairs": f"WITH {_PREP}{_PAIR} SELECT a, b, count(*) AS n, round({_CORR}, 6) + 0.0 AS corr FROM pq GROUP BY a, b",
    "corr_pairs_spearman": f"WITH {_PREP}{_PAIR}, rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS y FROM pq) SELECT a, b, count(*) AS n, round({_CORR}, 6) + 0.0 AS corr FROM rk GROUP BY a, b",
    "duplicate_columns": f"WITH {_PREP}, pt AS (SELECT feature, md5(string_agg(coalesce(CAST(value AS VARCHAR), '-'), ',' ORDER BY date, instrument)) AS print FROM lf GROUP BY feature) SELECT min(feature) AS kept, string_agg(feature, ';' ORDER BY feature) AS features FROM pt GROUP BY print HAVING count(*) > 1",
}
ORACLES["target_corr"] = (
    "WITH RECURSIVE " + EVENTS + ", " + _PREP[len(o.BARS) + 2 :] + f", tg AS (SELECT feature, value AS x, metalabel AS y FROM lf JOIN evs USING (date, instrument) WHERE value IS NOT NULL) SELECT feature, count(*) AS n, round(abs({_CORR}), 6) AS score FROM tg GROUP BY feature"
)

_EDGES = f", pc AS (SELECT a, b, {_CORR} AS corr FROM pq GROUP BY a, b HAVING count(*) >= 20), ed AS (SELECT a, b FROM pc WHERE abs(corr) >= 0.8 UNION ALL SELECT b, a FROM pc WHERE abs(corr) >= 0.8), rc AS (SELECT unnest({COLS!r}) AS feature, unnest({COLS!r}) AS r UNION SELECT rc.feature, ed.b FROM rc JOIN ed ON rc.r = ed.a), cl AS (SELECT feature, min(r) AS cluster FROM rc GROUP BY feature)"
ORACLES["corr_clusters"] = f"WITH RECURSIVE {_PREP}{_PAIR}{_EDGES} SELECT feature, cluster FROM cl"
ORACLES["cluster_representatives"] = (
    "WITH RECURSIVE "
    + EVENTS
    + ", "
    + _PREP[len(o.BARS) + 2 :]
    + _PAIR
    + _EDGES
    + _PROF
    + f", tg AS (SELECT feature, value AS x, metalabel AS y FROM lf JOIN evs USING (date, instrument) WHERE value IS NOT NULL), sc AS (SELECT feature, abs({_CORR}) AS score FROM tg GROUP BY feature HAVING count(*) >= 3), rk AS (SELECT cl.*, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 12) DESC NULLS LAST, missing_rate, nunique DESC, round(variance, 12) DESC NULLS LAST, feature) AS k, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM cl LEFT JOIN pf USING (feature) LEFT JOIN sc USING (feature)) SELECT cluster, feature AS representative, cluster_size FROM rk WHERE k = 1"
)


def _star_sql() -> str:
    six = lambda c, x=None: f"round({x or c}, 6) + 0.0 AS {c}"
    labels = {"hmm_volatility_regime": ("hmm_volatility", sg.VOLATILITY_LABELS), "hmm_return_regime": ("hmm_return", sg.RETURN_LABELS), "hmm_market_state": ("hmm_market", sg.MARKET_LABELS)}
    cols = ["date", "instrument", "primary_signal", *map(six, ("open", "high", "low", "close", "volume", "open_interest", "ret_5d")), "regime AS hmm_predicted_regime", six("hmm_regime_confidence", "conf"), *[six(f"hmm_regime_prob_{k}", f"p{k}") for k in range(4)]]
    cols += [*map(six, _MASSES), *map(six, MARKET), "signal_changed", "days_since_signal_change", *map(six, ("signal_rolling_mean_5d", "signal_rolling_mean_20d", "signal_abs_rolling_sum_20d"))]
    cols += ["CAST(regime IS NULL AS INTEGER) AS hmm_regime_missing", *[f"CAST(regime = {k} AS INTEGER) AS hmm_regime_{k}" for k in range(4)]]
    for source, (prefix, values) in labels.items():
        cols += [f"CAST(list_position({list(values)!r}, {source}) - 1 AS DOUBLE) AS {source}_code", f"CAST({source} IS NULL AS INTEGER) AS {source}_missing", *[f"CAST({source} = '{v}' AS INTEGER) AS {prefix}_{v}" for v in values]]
    products = {
        "signal_x_hmm_confidence": "primary_signal * conf", "ret_5d_x_hmm_confidence": "ret_5d * conf", "vol_20d_x_hmm_confidence": "vol_20d_for_interaction * conf", "signal_x_hmm_prob_stress": "primary_signal * hmm_prob_stress",
        "signal_x_hmm_prob_high_or_extreme_vol": "primary_signal * hmm_prob_high_or_extreme_vol", "signal_x_hmm_prob_positive_or_strong_upside": "primary_signal * hmm_prob_positive_or_strong_upside",
    }
    cols += [six(k, v) for k, v in products.items()]
    market = ", ".join(f"{v} AS {k}" for k, v in MARKET.items())
    behaviour = f"SELECT date, instrument, chg AS signal_changed, CAST(row_number() OVER (PARTITION BY instrument, run ORDER BY date) - 1 AS INTEGER) AS days_since_signal_change, {o.agg('avg', 'primary_signal', 5, 1)} AS signal_rolling_mean_5d, {o.agg('avg', 'primary_signal', 20, 1)} AS signal_rolling_mean_20d, CAST({o.agg('sum', 'abs(primary_signal)', 20, 1)} AS DOUBLE) AS signal_abs_rolling_sum_20d FROM g"
    sides = f"{_MASS}{o.PREPARED[len(o.BARS) :]}{MARKET_CTE}{RUN_CTE}, mk AS (SELECT date, instrument, {market} FROM q), bh AS ({behaviour}), r5 AS (SELECT date, instrument, {_ret(5)} AS ret_5d FROM p), nm AS (SELECT instrument, hmm_predicted_regime AS regime, hmm_volatility_regime, hmm_return_regime, hmm_market_state FROM rm)"
    join = "sig LEFT JOIN bars USING (date, instrument) LEFT JOIN r5 USING (date, instrument) LEFT JOIN hr USING (date, instrument) LEFT JOIN nm USING (instrument, regime) LEFT JOIN cm USING (date, instrument) LEFT JOIN mk USING (date, instrument) LEFT JOIN bh USING (date, instrument)"
    return f"WITH RECURSIVE {sides} SELECT {', '.join(cols)} FROM {join}"


ORACLES["star_matrix"] = _star_sql()
