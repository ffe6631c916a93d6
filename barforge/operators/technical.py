"""Technical features of daily bars: 108 columns from staged window projections over one partitioning by instrument."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ewm import Ewm, with_ewm
from ..functions.windows import high, lag, last_values, low, mean, safe_div, staged, std, total, zscore

YEAR = 252
RETURNS = (1, 2, 3, 5, 10, 20, 63, 126, 252)
MOM_SIGNS = (5, 20, 63, 126, 252)
ROC = (5, 20, 63)
SMAS = (5, 10, 20, 50, 100, 200)
EMAS = (5, 10, 20, 50)
SMA_CROSSES = ((5, 20), (10, 50), (20, 50), (50, 100), (50, 200), (100, 200))
EMA_CROSSES = ((5, 20), (12, 26), (20, 50), (20, 100))
VOLS = (5, 10, 20, 63, 126, 252)
SHORT_VOLS = (5, 10, 20, 63)
VOL_RATIOS = ((5, 20), (20, 63), (63, 126))
ATRS = (5, 10, 14, 20)
RSIS = (7, 14, 21)
CCIS = (14, 20)
ZSCORES = (20, 63, 126)
DONCHIAN = (20, 52, 252)


def log_return() -> Column:
    return F.log(safe_div("close", lag("close")))


def log_ratio(a: str, b: str) -> Column:
    return F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(F.col(a) / F.col(b)))


def simple_return(n: int) -> Column:
    return safe_div("close", lag("close", n)) - 1


def sign_of(r: Column) -> Column:
    """1 above 0, else -1; null for null."""
    return F.when(r.isNull(), None).when(r > 0, 1).otherwise(-1)


def prepare(bars: DataFrame) -> DataFrame:
    """Bars with what several families need: the log return, gains and losses, true range, typical price, money flows."""
    diff = F.col("close") - lag("close")
    prev = lag("close")
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.withColumns({
        "_lr": log_return(), "_gain": F.greatest(diff, F.lit(0.0)), "_loss": F.greatest(-diff, F.lit(0.0)), "_prev": prev,
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)), "_tp": tp,
    })
    # greatest() skips nulls; a first bar has neither gain nor loss.
    out = out.withColumns({"_gain": F.when(F.col("_prev").isNotNull(), F.col("_gain")), "_loss": F.when(F.col("_prev").isNotNull(), F.col("_loss"))})
    flow, before = F.col("_tp") * F.col("volume"), lag("_tp")
    return out.withColumns({
        "_pos": F.when(F.coalesce(F.col("_tp") > before, F.lit(False)), flow).otherwise(0.0), "_neg": F.when(F.coalesce(F.col("_tp") < before, F.lit(False)), flow).otherwise(0.0),
        "_bp": F.col("close") - F.least("low", "_prev"), "_utr": F.greatest("high", "_prev") - F.least("low", "_prev"),
        "_hl2": F.pow(log_ratio("high", "low"), 2), "_gk": 0.5 * F.pow(log_ratio("high", "low"), 2) - (2 * math.log(2) - 1) * F.pow(log_ratio("close", "open"), 2),
    })


def returns(periods=RETURNS) -> dict[str, Column]:
    return {"log_ret": F.col("_lr"), **{f"ret_{n}d": simple_return(n) for n in periods}}


def momentum_signs(periods=MOM_SIGNS) -> dict[str, Column]:
    return {f"mom_sign_{n}d": sign_of(simple_return(n)) for n in periods}


def rate_of_change(periods=ROC) -> dict[str, Column]:
    return {f"roc_{n}d": simple_return(n) for n in periods}


def return_spreads() -> dict[str, Column]:
    return {f"ret_spread_{a}_{b}": simple_return(a) - simple_return(b) for a, b in ((5, 20), (20, 63))}


def sma_vs_price(periods=SMAS) -> dict[str, Column]:
    return {f"price_vs_sma{n}": safe_div(F.col("close") - mean("close", n), mean("close", n)) for n in periods}


def sma_crosses(pairs=SMA_CROSSES) -> dict[str, Column]:
    return {f"sma{a}_vs_sma{b}": safe_div(mean("close", a) - mean("close", b), mean("close", b)) for a, b in pairs}


def ema_specs(spans=(5, 10, 12, 20, 26, 50, 100)) -> list[Ewm]:
    return [Ewm(f"_ema{n}", "close", span=n) for n in spans]


def ema_vs_price(periods=EMAS) -> dict[str, Column]:
    return {f"price_vs_ema{n}": safe_div(F.col("close") - F.col(f"_ema{n}"), f"_ema{n}") for n in periods}


def ema_crosses(pairs=EMA_CROSSES) -> dict[str, Column]:
    return {f"ema{a}_vs_ema{b}": safe_div(F.col(f"_ema{a}") - F.col(f"_ema{b}"), f"_ema{b}") for a, b in pairs}


def ma_slopes() -> dict[str, Column]:
    """Needs _sma20, _sma50, _sma100 as columns: a lag of a frame takes two stages."""
    slope = lambda x: safe_div(F.col(x) - lag(x), lag(x))
    return {**{f"sma{n}_slope": slope(f"_sma{n}") for n in (20, 50, 100)}, **{f"ema{n}_slope": slope(f"_ema{n}") for n in (20, 50)}}


def rolling_volatility(windows=VOLS) -> dict[str, Column]:
    return {f"vol_{n}d": std("_lr", n) * math.sqrt(YEAR) for n in windows}


def volatility_ratio(pairs=VOL_RATIOS) -> dict[str, Column]:
    return {f"vol_ratio_{a}_{b}d": safe_div(std("_lr", a), std("_lr", b)) for a, b in pairs}


def parkinson(windows=SHORT_VOLS) -> dict[str, Column]:
    return {f"park_vol_{n}d": F.sqrt(mean("_hl2", n) / (4 * math.log(2)) * YEAR) for n in windows}


def garman_klass(windows=SHORT_VOLS) -> dict[str, Column]:
    clipped = lambda n: F.when(mean("_gk", n).isNotNull(), F.greatest(mean("_gk", n), F.lit(0.0)))
    return {f"gk_vol_{n}d": F.sqrt(clipped(n) * YEAR) for n in windows}


def price_ranges() -> dict[str, Column]:
    return {
        "hl_range": F.col("high") - F.col("low"), "co_range": F.col("close") - F.col("open"), "intraday_ret": log_ratio("close", "open"), "overnight_ret": log_ratio("open", "_prev"), "true_range": F.col("_tr"),
    }


def atr(windows=ATRS) -> dict[str, Column]:
    return {k: v for n in windows for k, v in ((f"atr_{n}d", F.col(f"_atr{n}")), (f"atr_{n}d_pct", safe_div(f"_atr{n}", "close")))}


def rsi_value(n: int) -> Column:
    gain, loss = F.col(f"_gain{n}"), F.col(f"_loss{n}")
    return F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + safe_div(gain, loss)))


def rsi(windows=RSIS) -> dict[str, Column]:
    """Needs _rsi7, _rsi14, _rsi21 as columns."""
    return {k: v for n in windows for k, v in ((f"rsi_{n}d", F.col(f"_rsi{n}")), (f"rsi_{n}d_change", F.col(f"_rsi{n}") - lag(f"_rsi{n}")))}


def position(n: int) -> Column:
    """Where the close stands between the lowest low and the highest high of n bars."""
    return safe_div(F.col("close") - low("low", n), high("high", n) - low("low", n))


def williams_r(windows=(14,)) -> dict[str, Column]:
    return {f"williams_r_{n}d": safe_div(high("high", n) - F.col("close"), high("high", n) - low("low", n)) * -100 for n in windows}


def _mean_distance(values: Column, n: int) -> Column:
    """Mean absolute distance of an array's n values from their mean."""
    add = lambda acc, x: acc + x
    centre = F.aggregate(values, F.lit(0.0), add) / n
    return F.aggregate(F.transform(values, lambda x: F.abs(x - centre)), F.lit(0.0), add) / n


def cci(windows=CCIS) -> dict[str, Column]:
    """The frame's typical prices are an array here, for the mean distance from its own mean."""
    return {f"cci_{n}d": F.when(mean("_tp", n).isNotNull(), safe_div(F.col("_tp") - mean("_tp", n), 0.015 * _mean_distance(last_values("_tp", n), n))) for n in windows}


def mfi(windows=(14,)) -> dict[str, Column]:
    out = {}
    for n in windows:
        pos, neg = total("_pos", n), total("_neg", n)
        out[f"mfi_{n}d"] = F.when(neg == 0, F.when(pos > 0, 100.0)).otherwise(100 - 100 / (1 + safe_div(pos, neg)))
    return out


def ultimate_oscillator(short: int = 7, mid: int = 14, long: int = 28) -> dict[str, Column]:
    r = lambda n: safe_div(total("_bp", n), total("_utr", n))
    return {"uo": 100 * (4 * r(short) + 2 * r(mid) + r(long)) / 7}


def price_zscore(windows=ZSCORES) -> dict[str, Column]:
    return {f"zscore_{n}d": zscore("close", n) for n in windows}


def donchian(windows=DONCHIAN) -> dict[str, Column]:
    return {f"donchian_pos_{n}d": position(n) for n in windows}


def bollinger_width(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = mean("close", n), std("close", n)
    up, down = mid + k * sd, mid - k * sd
    return {
        "bb_upper_dist": safe_div(up - F.col("close"), "close"), "bb_lower_dist": safe_div(F.col("close") - down, "close"), "bb_position": safe_div(F.col("close") - down, up - down), "bb_width": safe_div(up - down, mid),
    }


def macd_specs(fast: int = 12, slow: int = 26, signal: int = 9) -> list[Ewm]:
    """After the two means of the close."""
    return [Ewm("macd_line", (f"_ema{fast}", f"_ema{slow}"), "minus"), Ewm("macd_signal", "macd_line", span=signal), Ewm("macd_hist", ("macd_line", "macd_signal"), "minus")]


def macd(window: int = 63) -> dict[str, Column]:
    return {"macd_hist_chg": F.col("macd_hist") - lag("macd_hist"), "macd_zscore": zscore("macd_line", window)}


def ewm_specs() -> list[Ewm]:
    """Every exponentially weighted column of the matrix, for one pass."""
    return [
        *ema_specs(),
        *macd_specs(),
        *[Ewm(f"ewma_sd_{n}", "_lr", "std", span=n, adjust=True, least=n) for n in SHORT_VOLS],
        *[Ewm(f"_atr{n}", "_tr", alpha=1 / n, least=n) for n in ATRS],
        *[Ewm(f"_{k}{n}", f"_{k}", alpha=1 / n, least=n) for n in RSIS for k in ("gain", "loss")],
    ]


def build_all_features(bars: DataFrame) -> DataFrame:
    """date, instrument and the 108 features. One shuffle by instrument serves every window and the grouped pass.

    Every frame is computed once, in one window stage, and the features are expressions of them; frames of features (slopes, %D, width
    z-scores) make a second stage. NaN and infinities never arise: divisions are safe and logarithms guarded.
    """
    df = with_ewm(prepare(bars), *ewm_specs())
    with staged() as frames:
        first = {
            **returns(), **momentum_signs(), **rate_of_change(), **return_spreads(), **sma_vs_price(), **sma_crosses(), **ema_vs_price(), **ema_crosses(), **macd(), **{f"_sma{n}": mean("close", n) for n in (20, 50, 100)},
            **rolling_volatility(), **volatility_ratio(), **parkinson(), **garman_klass(), **{f"ewma_vol_{n}d": F.col(f"ewma_sd_{n}") * math.sqrt(YEAR) for n in SHORT_VOLS}, **price_ranges(), **atr(),
            **{f"_rsi{n}": rsi_value(n) for n in RSIS}, "stoch_k_14d": position(14) * 100, **williams_r(), **cci(), **mfi(), **ultimate_oscillator(), **price_zscore(), **donchian(), **bollinger_width(),
        }
    later = ["_sma20", "_sma50", "_sma100", "_ema20", "_ema50", "macd_line", "macd_signal", "macd_hist", *[f"_rsi{n}" for n in RSIS]]
    df = df.withColumns(frames).select("date", "instrument", *[v.alias(k) for k, v in first.items()], *[c for c in later if c not in first])
    with staged() as frames:
        second = {**ma_slopes(), **rsi(), "stoch_d_14d": mean("stoch_k_14d", 3), "bb_width_zscore": zscore("bb_width", 20)}
    return df.withColumns(frames).select("date", "instrument", *[second.get(c, F.col(c)).alias(c) for c in FEATURES])


FEATURES = [
    "log_ret", *[f"ret_{n}d" for n in RETURNS], *[f"mom_sign_{n}d" for n in MOM_SIGNS], *[f"roc_{n}d" for n in ROC], "ret_spread_5_20", "ret_spread_20_63",
    *[f"price_vs_sma{n}" for n in SMAS], *[f"price_vs_ema{n}" for n in EMAS], *[f"sma{a}_vs_sma{b}" for a, b in SMA_CROSSES], *[f"ema{a}_vs_ema{b}" for a, b in EMA_CROSSES],
    *[f"sma{n}_slope" for n in (20, 50, 100)], "ema20_slope", "ema50_slope", "macd_line", "macd_signal", "macd_hist", "macd_hist_chg", "macd_zscore",
    *[f"vol_{n}d" for n in VOLS], *[f"ewma_vol_{n}d" for n in SHORT_VOLS], *[f"vol_ratio_{a}_{b}d" for a, b in VOL_RATIOS], *[f"park_vol_{n}d" for n in SHORT_VOLS], *[f"gk_vol_{n}d" for n in SHORT_VOLS],
    "hl_range", "co_range", "intraday_ret", "overnight_ret", "true_range", *[x for n in ATRS for x in (f"atr_{n}d", f"atr_{n}d_pct")], *[x for n in RSIS for x in (f"rsi_{n}d", f"rsi_{n}d_change")],
    "stoch_k_14d", "stoch_d_14d", "williams_r_14d", *[f"cci_{n}d" for n in CCIS], "mfi_14d", "uo", *[f"zscore_{n}d" for n in ZSCORES],
    "bb_upper_dist", "bb_lower_dist", "bb_position", "bb_width", "bb_width_zscore", *[f"donchian_pos_{n}d" for n in DONCHIAN],
]
