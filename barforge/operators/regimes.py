"""Market regimes: observations, a Gaussian hidden Markov model by instrument, causal filtering, named categories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.windows import lag, safe_div, std
from .signals import MARKET_LABELS, RETURN_LABELS, VOLATILITY_LABELS
from .technical import log_ratio

OBSERVATIONS = ("ret_1d", "intraday_ret", "range", "volume_chg", "open_interest_chg", "vol_20d")
STATES = 4


def observations(bars: DataFrame) -> DataFrame:
    """date, instrument and the six observed series; volatility from 10 of 20 returns on."""
    pos = lambda x: F.when(F.col(x) > 0, F.log(x))
    df = bars.withColumn("ret_1d", pos("close") - lag(pos("close")))
    return df.select(
        "date", "instrument", "ret_1d", log_ratio("close", "open").alias("intraday_ret"), log_ratio("high", "low").alias("range"), (pos("volume") - lag(pos("volume"))).alias("volume_chg"),
        (pos("open_interest") - lag(pos("open_interest"))).alias("open_interest_chg"), std("ret_1d", 20, 10).alias("vol_20d"),
    )


def _emissions(x: np.ndarray, means: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log-densities of rows under each state's diagonal normal distribution."""
    return -0.5 * (np.log(2 * np.pi * var).sum(1) + (((x[:, None, :] - means) ** 2) / var).sum(2))


def _forward(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float]:
    """P(state | observations so far), and the log-likelihood of all; scaled at each step."""
    out, total = np.empty_like(log_b), 0.0
    prior = start
    for t, row in enumerate(log_b):
        top = row.max()
        a = prior * np.exp(row - top)
        s = a.sum()
        out[t] = a / s
        total += np.log(s) + top
        prior = out[t] @ trans
    return out, total


def baum_welch(x: np.ndarray, states: int = STATES, rounds: int = 100, tol: float = 1e-4) -> dict[str, np.ndarray]:
    """Parameters of a hidden Markov model with diagonal normal states, from a start by quantiles of the first series."""
    n, d = x.shape
    group = np.argsort(np.argsort(x[:, 0], kind="stable")) * states // n
    means = np.stack([x[group == k].mean(0) for k in range(states)])
    var = np.stack([x[group == k].var(0) for k in range(states)]) + 1e-3
    start, trans = np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    before = -np.inf
    for _ in range(rounds):
        log_b = _emissions(x, means, var)
        alpha, total = _forward(log_b, start, trans)
        b = np.exp(log_b - log_b.max(1, keepdims=True))
        beta = np.ones((n, states))
        for t in range(n - 2, -1, -1):
            v = trans @ (b[t + 1] * beta[t + 1])
            beta[t] = v / v.sum()
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        xi = alpha[:-1, :, None] * trans[None] * (b[1:] * beta[1:])[:, None, :]
        xi = (xi / xi.sum((1, 2), keepdims=True)).sum(0)
        weight = gamma.sum(0)[:, None]
        start, trans = gamma[0], xi / xi.sum(1, keepdims=True)
        means = gamma.T @ x / weight
        var = np.maximum(gamma.T @ (x * x) / weight - means**2, 0) + 1e-3
        if total - before < tol:
            break
        before = total
    return {"start": start, "trans": trans, "means": means, "var": var}


_OUT = T.StructType([T.StructField("date", T.DateType()), T.StructField("instrument", T.StringType()), T.StructField("hmm_predicted_regime", T.IntegerType()), T.StructField("hmm_regime_confidence", T.DoubleType()), *[T.StructField(f"hmm_regime_prob_{k}", T.DoubleType()) for k in range(STATES)]])


def _rows(part: pd.DataFrame, probs: np.ndarray) -> pd.DataFrame:
    out = part[["date", "instrument"]].copy()
    out["hmm_predicted_regime"] = probs.argmax(1).astype("int32")
    out["hmm_regime_confidence"] = probs.max(1)
    for k in range(probs.shape[1]):
        out[f"hmm_regime_prob_{k}"] = probs[:, k]
    return out


def detect(obs: DataFrame, training_end: str, cols=OBSERVATIONS, least: int = 20 * STATES) -> DataFrame:
    """Regimes of every bar with all observations: fitted by instrument up to ``training_end``, filtered causally over all.

    States are numbered by mean return, then mean volatility. One group is one instrument's bars. An instrument of fewer than ``least``
    training rows has all its rows, with nulls: so few don't tell four states.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        known = pd.to_datetime(part["date"]) <= pd.Timestamp(training_end)
        if known.sum() < least:
            none = part[["date", "instrument"]].copy()
            for f in _OUT.fields[2:]:
                none[f.name] = pd.array([None] * len(none), "Int32" if f.name == "hmm_predicted_regime" else "Float64")
            return none
        x = part[list(cols)].to_numpy(float)
        mean, sd = x[known].mean(0), x[known].std(0)
        x = (x - mean) / np.where(sd > 0, sd, 1)
        m = baum_welch(x[known.to_numpy()])
        probs, _ = _forward(_emissions(x, m["means"], m["var"]), m["start"], m["trans"])
        order = np.lexsort((m["means"][:, list(cols).index("vol_20d")], m["means"][:, list(cols).index("ret_1d")]))
        return _rows(part, probs[:, order])

    return obs.na.drop(subset=list(cols)).groupBy("instrument").applyInPandas(run, _OUT)


#: Fixed parameters of a one-series filter, for checks: means and deviations of the return by state, and transitions.
FIXED = {"mean": (-0.03, -0.005, 0.005, 0.03), "sd": (0.03, 0.015, 0.015, 0.03), "stay": 0.91, "move": 0.03}


def filter_fixed(obs: DataFrame, col: str = "ret_1d") -> DataFrame:
    """P(state | returns so far) under FIXED, in the same linear pass."""
    means, var = np.array(FIXED["mean"])[:, None], np.array(FIXED["sd"])[:, None] ** 2
    trans = np.full((STATES, STATES), FIXED["move"]) + (FIXED["stay"] - FIXED["move"]) * np.eye(STATES)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        x = part[[col]].to_numpy(float)
        probs, _ = _forward(_emissions(x, means, var), np.full(STATES, 0.25), trans)
        return _rows(part, probs)

    return obs.na.drop(subset=[col]).select("date", "instrument", col).groupBy("instrument").applyInPandas(run, _OUT)


def ranked_label(stat: str, labels):
    """The label at a state's rank by ``stat`` within its instrument."""
    w = Window.partitionBy("instrument").orderBy(stat, "hmm_predicted_regime")
    return F.element_at(F.array(*map(F.lit, labels)), F.row_number().over(w))


def market_state(ret: str, vol: str):
    wild, up = F.col(vol).isin("high_vol", "extreme_vol"), F.col(ret).isin("positive", "strong_upside")
    known = F.col(ret).isNotNull() & F.col(vol).isNotNull()
    return F.when(~known, "chop").when(wild & ~up, "stress").when(wild, "upside_breakout").when(up, "calm_positive").otherwise("calm_negative")


def regime_map(regimes: DataFrame, bars: DataFrame) -> DataFrame:
    """Names of each instrument's states by their mean volatility and return, with the figures behind them."""
    stats = bars.withColumn("daily_return", safe_div("close", lag("close")) - 1)
    stats = stats.withColumn("realized_vol_20d", std("daily_return", 20, 10)).select("date", "instrument", "daily_return", "realized_vol_20d")
    panel = regimes.join(stats, ["date", "instrument"]).na.drop(subset=["hmm_predicted_regime", "daily_return", "realized_vol_20d"])
    agg = panel.groupBy("instrument", "hmm_predicted_regime").agg(
        F.count("*").alias("days"), F.avg("daily_return").alias("avg_daily_return"), F.avg(F.abs("daily_return")).alias("avg_abs_return"), F.avg("realized_vol_20d").alias("avg_realized_vol_20d"), F.avg("hmm_regime_confidence").alias("avg_confidence"),
    )
    agg = agg.withColumns({"hmm_volatility_regime": ranked_label("avg_realized_vol_20d", VOLATILITY_LABELS), "hmm_return_regime": ranked_label("avg_daily_return", RETURN_LABELS)})
    return agg.withColumn("hmm_market_state", market_state("hmm_return_regime", "hmm_volatility_regime"))


def category_mass(regimes: DataFrame, names: DataFrame) -> DataFrame:
    """Probabilities of the named categories: sums over the states that bear a name; null where all states' are."""
    long = regimes.select("date", "instrument", F.posexplode(F.array(*[f"hmm_regime_prob_{k}" for k in range(STATES)])).alias("hmm_predicted_regime", "p"))
    named = long.join(names.select("instrument", "hmm_predicted_regime", "hmm_volatility_regime", "hmm_return_regime", "hmm_market_state"), ["instrument", "hmm_predicted_regime"], "left")
    # Null only if every probability is: then the count of known ones is 0.
    some = F.count("p") > 0
    mass = lambda c, v: F.when(some, F.coalesce(F.sum(F.when(F.col(c) == v, F.col("p"))), F.lit(0.0))).alias(f"hmm_prob_{v}")
    out = named.groupBy("date", "instrument").agg(*[mass("hmm_volatility_regime", v) for v in VOLATILITY_LABELS], *[mass("hmm_return_regime", v) for v in RETURN_LABELS], *[mass("hmm_market_state", v) for v in MARKET_LABELS])
    p = lambda v: F.col(f"hmm_prob_{v}")
    return out.withColumns({
        "hmm_prob_high_or_extreme_vol": p("high_vol") + p("extreme_vol"), "hmm_prob_low_or_normal_vol": p("low_vol") + p("normal_vol"), "hmm_prob_downside_or_weak": p("downside") + p("weak"),
        "hmm_prob_positive_or_strong_upside": p("positive") + p("strong_upside"), "hmm_prob_not_stress": 1 - p("stress"),
    })
