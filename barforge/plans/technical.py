"""Queries of the technical features, one for each family, and the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import mean, staged, zscore
from ..operators import technical as ta
from ..sources.bars import bars_from_ticks
from . import oracle as o


def bars_of(spark, sf_dir: str) -> DataFrame:
    return bars_from_ticks(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero, as the SQL side does."""
    return df.select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def _family(make, *, stage=None, ewm=None):
    """A query: prepared bars, the grouped pass if ``ewm`` says so, a stage of helper columns, then the family."""

    def query(spark, sf_dir: str) -> DataFrame:
        df = ta.prepare(bars_of(spark, sf_dir))
        if ewm:
            df = ta.with_ewm(df, *ewm())
        if stage:
            df = df.withColumns(stage())
        with staged() as frames:
            cols = make()
        df = df.withColumns(frames) if frames else df
        return rounded(df.select("date", "instrument", *[v.cast("double").alias(k) for k, v in cols.items()]))

    return query


def _macd(spark, sf_dir):
    df = ta.with_ewm(ta.prepare(bars_of(spark, sf_dir)), *ta.ema_specs((12, 26)), *ta.macd_specs()).withColumns(ta.macd())
    return rounded(df.select("date", "instrument", "macd_line", "macd_signal", "macd_hist", "macd_hist_chg", "macd_zscore"))


def _atr_specs():
    return [s for s in ta.ewm_specs() if s.name.startswith("_atr")]


def _rsi_specs():
    return [s for s in ta.ewm_specs() if s.of in ("_gain", "_loss")]


def _vol_specs():
    return [s for s in ta.ewm_specs() if s.kind == "std"]


def _bars(spark, sf_dir):
    return bars_of(spark, sf_dir)


def _latest(spark, sf_dir):
    """Each instrument's last bar with its one-day return, distance from the mean of 20 and volatility."""
    from pyspark.sql.window import Window

    df = ta.prepare(bars_of(spark, sf_dir))
    df = df.select("date", "instrument", "close", ta.simple_return(1).alias("ret_1d"), ta.sma_vs_price((20,))["price_vs_sma20"].alias("price_vs_sma20"), ta.rolling_volatility((20,))["vol_20d"].alias("vol_20d"))
    last = F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("date")))
    return rounded(df.withColumn("n", last).where("n = 1").drop("n"))


def _matrix(spark, sf_dir):
    out = ta.build_all_features(bars_of(spark, sf_dir))
    return rounded(out.select("date", "instrument", *[F.col(c).cast("double").alias(c) for c in ta.FEATURES]))


QUERIES = {
    "bars": _bars,
    "latest_features": _latest,
    "returns": _family(lambda: {**ta.returns(), **ta.rate_of_change()}),
    "momentum_signs": _family(ta.momentum_signs),
    "return_spreads": _family(ta.return_spreads),
    "sma_family": _family(lambda: {**ta.sma_vs_price(), **ta.sma_crosses()}),
    "ema_family": _family(lambda: {**ta.ema_vs_price(), **ta.ema_crosses()}, ewm=ta.ema_specs),
    "ma_slopes": _family(ta.ma_slopes, ewm=lambda: ta.ema_specs((20, 50)), stage=lambda: {f"_sma{n}": mean("close", n) for n in (20, 50, 100)}),
    "macd": _macd,
    "vol_family": _family(lambda: {**ta.rolling_volatility(), **ta.volatility_ratio()}),
    "ewma_vol": _family(lambda: {f"ewma_vol_{n}d": F.col(f"ewma_sd_{n}") * math.sqrt(ta.YEAR) for n in ta.SHORT_VOLS}, ewm=_vol_specs),
    "parkinson_gk": _family(lambda: {**ta.parkinson(), **ta.garman_klass()}),
    "ranges": _family(ta.price_ranges),
    "atr": _family(ta.atr, ewm=_atr_specs),
    "rsi": _family(ta.rsi, ewm=_rsi_specs, stage=lambda: {f"_rsi{n}": ta.rsi_value(n) for n in ta.RSIS}),
    "stoch_williams": _family(lambda: {"stoch_k_14d": F.col("_k"), "stoch_d_14d": mean("_k", 3), **ta.williams_r()}, stage=lambda: {"_k": ta.position(14) * 100}),
    "cci": _family(ta.cci),
    "mfi": _family(ta.mfi),
    "ultimate_osc": _family(ta.ultimate_oscillator),
    "price_zscore": _family(ta.price_zscore),
    "bollinger": _family(lambda: {**{k: F.col(k) for k in ("bb_upper_dist", "bb_lower_dist", "bb_position", "bb_width")}, "bb_width_zscore": zscore("bb_width", 20)}, stage=ta.bollinger_width),
    "donchian": _family(ta.donchian),
    "feature_matrix_108": _matrix,
}

# ---- the same in SQL -------------------------------------------------------------------------------------------------

_ret = lambda n: f"close / nullif({o.lag('close', n)}, 0) - 1"
_sign = lambda n: f"CASE WHEN {_ret(n)} IS NULL THEN NULL WHEN {_ret(n)} > 0 THEN 1 ELSE -1 END"
_sma = lambda n: o.agg("avg", "close", n)
_std = lambda n: o.agg("stddev_samp", "lr", n)
_low, _high = lambda n: o.agg("min", "low", n), lambda n: o.agg("max", "high", n)
_pos = lambda n: o.div(f"close - {_low(n)}", f"{_high(n)} - {_low(n)}")
_y = f"sqrt({ta.YEAR})"
_span = lambda n: 2 / (n + 1)
_J = lambda cte: f"(SELECT * FROM p JOIN {cte} USING (instrument, rn)) x"
_EMA = o.PREPARED + ", " + o.ewm_means("p", "em", {f"ema{n}": ("close", _span(n), 0) for n in (5, 10, 12, 20, 26, 50, 100)})
_ATR = o.PREPARED + ", " + o.ewm_means("p", "em", {f"atr{n}": ("tr", 1 / n, n) for n in ta.ATRS})
_RSI = o.PREPARED + ", " + o.ewm_means("p", "em", {f"{k}{n}": (k, 1 / n, n) for n in ta.RSIS for k in ("gain", "loss")}) + ", q AS (SELECT p.date, p.instrument, " + ", ".join(f"CASE WHEN em.loss{n} = 0 THEN CASE WHEN em.gain{n} > 0 THEN 100.0 END ELSE 100 - 100 / (1 + em.gain{n} / nullif(em.loss{n}, 0)) END AS rsi{n}" for n in ta.RSIS) + " FROM p JOIN em USING (instrument, rn))"
_MACD = _EMA + ", ml AS (SELECT p.date, p.instrument, p.rn, ema12 - ema26 AS macd_line FROM p JOIN em USING (instrument, rn)), " + o.ewm_means("ml", "sg", {"macd_signal": ("macd_line", _span(9), 0)}) + ", mh AS (SELECT ml.*, macd_signal, macd_line - macd_signal AS macd_hist FROM ml JOIN sg USING (instrument, rn))"
_VOL = o.PREPARED + ", " + o.ewm_stds("p", "em", "lr", {f"sd{n}": (_span(n), n, True) for n in ta.SHORT_VOLS})


def _mad(n: int) -> str:
    mean_ = f"(list_sum(list(tp) OVER {o.frame(n)}) / {n})"
    return f"(list_sum(list_transform(list(tp) OVER {o.frame(n)}, lambda v: abs(v - {mean_}))) / {n})"


_bb_up, _bb_dn = f"({_sma(20)} + 2 * {o.agg('stddev_samp', 'close', 20)})", f"({_sma(20)} - 2 * {o.agg('stddev_samp', 'close', 20)})"
_BB = o.PREPARED + f", q AS (SELECT date, instrument, {o.div(_bb_up + ' - close', 'close')} AS bb_upper_dist, {o.div('close - ' + _bb_dn, 'close')} AS bb_lower_dist, {o.div('close - ' + _bb_dn, _bb_up + ' - ' + _bb_dn)} AS bb_position, {o.div(_bb_up + ' - ' + _bb_dn, _sma(20))} AS bb_width FROM p)"
_SLOPE = _EMA + f", q AS (SELECT p.date, p.instrument, {', '.join(f'{_sma(n)} AS sma{n}' for n in (20, 50, 100))}, ema20, ema50 FROM p JOIN em USING (instrument, rn))"
_K = o.PREPARED + f", q AS (SELECT *, 100 * ({_pos(14)}) AS k FROM p)"
_CCI = o.PREPARED + ", q AS (SELECT *, " + ", ".join(f"list(tp) OVER {o.frame(n)} AS l{n}" for n in ta.CCIS) + " FROM p), q2 AS (SELECT *, " + ", ".join(f"list_sum(l{n}) / {n} AS m{n}" for n in ta.CCIS) + " FROM q), q3 AS (SELECT *, " + ", ".join(f"(SELECT sum(abs(u - m{n})) / {n} FROM unnest(l{n}) z(u)) AS mad{n}" for n in ta.CCIS) + " FROM q2)"

_S = {
    "returns": (o.PREPARED, "p", {"log_ret": "lr", **{f"ret_{n}d": _ret(n) for n in ta.RETURNS}, **{f"roc_{n}d": _ret(n) for n in ta.ROC}}),
    "momentum_signs": (o.PREPARED, "p", {f"mom_sign_{n}d": _sign(n) for n in ta.MOM_SIGNS}),
    "return_spreads": (o.PREPARED, "p", {f"ret_spread_{a}_{b}": f"({_ret(a)}) - ({_ret(b)})" for a, b in ((5, 20), (20, 63))}),
    "sma_family": (o.PREPARED, "p", {**{f"price_vs_sma{n}": o.div(f"close - {_sma(n)}", _sma(n)) for n in ta.SMAS}, **{f"sma{a}_vs_sma{b}": o.div(f"{_sma(a)} - {_sma(b)}", _sma(b)) for a, b in ta.SMA_CROSSES}}),
    "ema_family": (_EMA, _J("em"), {**{f"price_vs_ema{n}": o.div(f"close - ema{n}", f"ema{n}") for n in ta.EMAS}, **{f"ema{a}_vs_ema{b}": o.div(f"ema{a} - ema{b}", f"ema{b}") for a, b in ta.EMA_CROSSES}}),
    "ma_slopes": (_SLOPE, "q", {f"{x}_slope": o.div(f"{x} - {o.lag(x)}", o.lag(x)) for x in ("sma20", "sma50", "sma100", "ema20", "ema50")}),
    "macd": (_MACD, "mh", {"macd_line": "macd_line", "macd_signal": "macd_signal", "macd_hist": "macd_hist", "macd_hist_chg": f"macd_hist - {o.lag('macd_hist')}", "macd_zscore": o.zscore("macd_line", 63)}),
    "vol_family": (o.PREPARED, "p", {**{f"vol_{n}d": f"({_std(n)}) * {_y}" for n in ta.VOLS}, **{f"vol_ratio_{a}_{b}d": o.div(_std(a), _std(b)) for a, b in ta.VOL_RATIOS}}),
    "ewma_vol": (_VOL, _J("em"), {f"ewma_vol_{n}d": f"sd{n} * {_y}" for n in ta.SHORT_VOLS}),
    "parkinson_gk": (o.PREPARED, "p", {**{f"park_vol_{n}d": f"sqrt(({o.agg('avg', 'hl2', n)}) / (4 * ln(2)) * {ta.YEAR})" for n in ta.SHORT_VOLS}, **{f"gk_vol_{n}d": f"sqrt(CASE WHEN ({o.agg('avg', 'gk', n)}) IS NOT NULL THEN greatest({o.agg('avg', 'gk', n)}, 0) END * {ta.YEAR})" for n in ta.SHORT_VOLS}}),
    "ranges": (o.PREPARED, "p", {"hl_range": "high - low", "co_range": "close - open", "intraday_ret": "ln(close / open)", "overnight_ret": "ln(open / prev)", "true_range": "tr"}),
    "atr": (_ATR, _J("em"), {k: v for n in ta.ATRS for k, v in ((f"atr_{n}d", f"atr{n}"), (f"atr_{n}d_pct", o.div(f"atr{n}", "close")))}),
    "rsi": (_RSI, "q", {k: v for n in ta.RSIS for k, v in ((f"rsi_{n}d", f"rsi{n}"), (f"rsi_{n}d_change", f"rsi{n} - {o.lag(f'rsi{n}')}"))}),
    "stoch_williams": (_K, "q", {"stoch_k_14d": "k", "stoch_d_14d": o.agg("avg", "k", 3), "williams_r_14d": f"-100 * ({o.div(f'{_high(14)} - close', f'{_high(14)} - {_low(14)}')})"}),
    "cci": (_CCI, "q3", {f"cci_{n}d": f"CASE WHEN len(l{n}) >= {n} THEN {o.div(f'tp - {o.agg("avg", "tp", n)}', f'0.015 * mad{n}')} END" for n in ta.CCIS}),
    "mfi": (o.PREPARED, "p", {"mfi_14d": f"CASE WHEN ({o.agg('sum', 'neg', 14)}) = 0 THEN CASE WHEN ({o.agg('sum', 'pos', 14)}) > 0 THEN 100.0 END ELSE 100 - 100 / (1 + ({o.agg('sum', 'pos', 14)}) / nullif({o.agg('sum', 'neg', 14)}, 0)) END"}),
    "ultimate_osc": (o.PREPARED, "p", {"uo": "100 * (" + " + ".join(f"{w} * ({o.div(o.agg('sum', 'bp', n), o.agg('sum', 'utr', n))})" for w, n in ((4, 7), (2, 14), (1, 28))) + ") / 7"}),
    "price_zscore": (o.PREPARED, "p", {f"zscore_{n}d": o.zscore("close", n) for n in ta.ZSCORES}),
    "bollinger": (_BB, "q", {**{k: k for k in ("bb_upper_dist", "bb_lower_dist", "bb_position", "bb_width")}, "bb_width_zscore": o.zscore("bb_width", 20)}),
    "donchian": (o.PREPARED, "p", {f"donchian_pos_{n}d": _pos(n) for n in ta.DONCHIAN}),
}
ORACLES = {k: o.select(*v) for k, v in _S.items()}
ORACLES["bars"] = f"WITH {o.BARS} SELECT * FROM bars"
ORACLES["latest_features"] = o.select(
    o.PREPARED + f", q AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS n, {_ret(1)} AS ret_1d, {o.div(f'close - {_sma(20)}', _sma(20))} AS price_vs_sma20, ({_std(20)}) * {_y} AS vol_20d FROM p)",
    "q WHERE n = 1",
    {k: k for k in ("close", "ret_1d", "price_vs_sma20", "vol_20d")},
)

#: Families whose columns, all of them, make the matrix.
_MATRIX = [k for k in _S if k != "latest_features"]
ORACLES["feature_matrix_108"] = (
    "SELECT date, instrument, " + ", ".join(ta.FEATURES) + " FROM " + " JOIN ".join(f"({ORACLES[k]}) f{i}" + (" USING (date, instrument)" if i else "") for i, k in enumerate(_MATRIX))
)
