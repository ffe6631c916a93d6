"""Triple-barrier labels: volatility, barriers, first touch, sweeps, the high/low variant and parameter choice."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ewm import Ewm, with_ewm
from ..functions.windows import by_date, mean, safe_div, std
from .technical import log_ratio, log_return

#: Names of the volatility methods, with what else they are called.
METHODS = {"ewma": "ewma", "rolling": "rolling", "rolling_std": "rolling", "parkinson": "parkinson", "garman_klass": "garman_klass", "gk": "garman_klass"}


class Config(NamedTuple):
    config_name: str
    volatility_method: str
    ewma_span: int = 100
    volatility_window: int = 20
    num_days: int = 10
    take_profit_mult: float = 2.0
    stop_loss_mult: float = 2.0


SWEEP = (
    Config("ewma_10d_tp2_sl2", "ewma"), Config("ewma_5d_tp2_sl2", "ewma", num_days=5), Config("ewma_10d_tp1_5_sl1_5", "ewma", take_profit_mult=1.5, stop_loss_mult=1.5),
    Config("rolling_10d_tp2_sl2", "rolling"), Config("parkinson_10d_tp2_sl2", "parkinson"), Config("garman_klass_10d_tp2_sl2", "garman_klass"),
)


def daily_volatility(bars: DataFrame, span: int = 100, window: int = 20) -> DataFrame:
    """Bars with vol_ewma, vol_rolling, vol_parkinson and vol_garman_klass, not annualised; null where a mean square is negative."""
    df = with_ewm(bars.withColumn("_lr", log_return()), Ewm("vol_ewma", "_lr", "std", span=span, adjust=True, least=span))
    hl, co = log_ratio("high", "low"), log_ratio("close", "open")
    df = df.withColumns({"_hl2": hl * hl / (4 * math.log(2)), "_gk": 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co})
    root = lambda x: F.when(x >= 0, F.sqrt(x))
    return df.withColumns({"vol_rolling": std("_lr", window), "vol_parkinson": root(mean("_hl2", window)), "vol_garman_klass": root(mean("_gk", window))}).drop("_lr", "_hl2", "_gk")


def _first_touch(path: Column, upper: Column, lower: Column) -> Column:
    """The first (date, high, low, price) of a path that reaches a barrier; barriers count when met."""
    hits = F.filter(path, lambda p: (p["high"] >= upper) | (p["low"] <= lower))
    return F.try_element_at(hits, F.lit(1))


def label_events(priced: DataFrame, vol: str = "vol", num_days: int = 10, take_profit: float | Column = 2.0, stop_loss: float | Column = 2.0) -> DataFrame:
    """Events of signals -1 and 1 with their barriers, first touch and labels. ``priced``: bars with primary_signal and volatility.

    Touches are looked for in the closes of the next ``num_days`` bars, an array frame on the bars' own partitions: no
    join of events with prices. The upper barrier goes first; no touch is a time-out at the last close. Events without
    ``num_days`` bars after them are left out.
    """
    tp, sl = (x if isinstance(x, Column) else F.lit(float(x)) for x in (take_profit, stop_loss))
    ahead = by_date().rowsBetween(1, num_days)
    path = F.collect_list(F.struct("date", F.col("close").alias("high"), F.col("close").alias("low"), "close")).over(ahead)
    s = F.col("primary_signal")
    df = priced.withColumn("_path", path).where(s.isin(-1, 1) & F.col(vol).isNotNull() & (F.size("_path") == num_days))
    df = df.withColumns({
        "tp": F.col("close") * (1 + s * tp * F.col(vol)), "sl": F.col("close") * (1 - s * sl * F.col(vol)),
        "timeout_date": F.try_element_at("_path", F.lit(-1))["date"], "timeout_close": F.try_element_at("_path", F.lit(-1))["close"],
    })
    df = df.withColumns({"_upper": F.greatest("tp", "sl"), "_lower": F.least("tp", "sl")})
    df = df.withColumn("_touch", _first_touch(F.col("_path"), F.col("_upper"), F.col("_lower")))
    price = F.coalesce(F.col("_touch.close"), F.col("timeout_close"))
    up = F.col("_touch.close") >= F.col("_upper")
    df = df.withColumns({"touch_date": F.coalesce(F.col("_touch.date"), F.col("timeout_date")), "touch_price": price, "touched_barrier": F.when(F.col("_touch").isNull(), "timeout").when(up, "upper").otherwise("lower")})
    label = F.when(F.col("touched_barrier") == "upper", 1).when(F.col("touched_barrier") == "lower", -1).otherwise(0)
    raw = F.col("touch_price") / F.col("close") - 1
    df = df.withColumns({"triple_barrier_label": label, "raw_touch_return": raw, "signed_touch_return": raw * s})
    df = df.withColumns({"metalabel": (F.col("signed_touch_return") > 0).cast("int"), "holding_period_days": F.date_diff("touch_date", "date")})
    return df.drop("_path", "_touch", "_upper", "_lower")


LABEL_COLUMNS = [
    "instrument", "signal_column", "training_end", "date", "close", "primary_signal", "vol", "tp", "sl", "timeout_date", "timeout_close", "touch_date", "touch_price", "touched_barrier", "triple_barrier_label", "metalabel",
    "volatility_method", "ewma_span", "volatility_window", "num_days", "take_profit_mult", "stop_loss_mult", "holding_period_days", "raw_touch_return", "signed_touch_return",
]


def label_pipeline(bars: DataFrame, signals: DataFrame, config: Config, training_end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The 25-column label table of every instrument. Bars and signals from ``training_end`` on don't count, before volatility.

    Raises ValueError for an unknown volatility method or an unknown column in ``columns``.
    """
    if config.volatility_method not in METHODS:
        raise ValueError(f"unknown volatility method {config.volatility_method!r}; known are {sorted(METHODS)}")
    if unknown := set(columns or ()) - set(LABEL_COLUMNS):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    if training_end:
        bars, signals = (d.where(F.col("date") < F.lit(training_end).cast("date")) for d in (bars, signals))
    method = METHODS[config.volatility_method]
    priced = daily_volatility(bars, config.ewma_span, config.volatility_window).withColumn("vol", F.col(f"vol_{method}"))
    priced = priced.join(signals.select("date", "instrument", "primary_signal"), ["date", "instrument"], "left")
    out = label_events(priced, "vol", config.num_days, config.take_profit_mult, config.stop_loss_mult)
    more = {"signal_column": F.col("instrument"), "training_end": F.lit(training_end).cast("date"), "volatility_method": F.lit(method), **{k: F.lit(getattr(config, k)) for k in ("ewma_span", "volatility_window", "num_days", "take_profit_mult", "stop_loss_mult")}}
    return out.withColumns(more).select(*(columns or LABEL_COLUMNS))


def label_sweep(bars: DataFrame, signals: DataFrame, configs=SWEEP, training_end: str | None = None) -> DataFrame:
    """Labels of all configurations in one plan: four volatilities once, one path frame for the longest horizon, then one row a configuration.

    The configurations are exploded next to each event, so bars are read, shuffled and joined once for all of them.
    """
    if training_end:
        bars, signals = (d.where(F.col("date") < F.lit(training_end).cast("date")) for d in (bars, signals))
    spans_ = {(c.ewma_span, c.volatility_window) for c in configs}
    if len(spans_) != 1:
        raise ValueError("configurations of one sweep share ewma_span and volatility_window")
    (span, window), longest = spans_.pop(), max(c.num_days for c in configs)
    priced = daily_volatility(bars, span, window).join(signals.select("date", "instrument", "primary_signal"), ["date", "instrument"], "left")
    path = F.collect_list(F.struct("date", "close")).over(by_date().rowsBetween(1, longest))
    s = F.col("primary_signal")
    df = priced.withColumn("_path", path).where(s.isin(-1, 1))
    methods = F.create_map(*[x for m in ("ewma", "rolling", "parkinson", "garman_klass") for x in (F.lit(m), F.col(f"vol_{m}"))])
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c._asdict().items()]) for c in configs])
    df = df.withColumn("_c", F.explode(grid)).select("instrument", "date", "close", "primary_signal", "_path", methods[F.col("_c.volatility_method")].alias("vol"), "_c.*")
    df = df.where(F.col("vol").isNotNull() & (F.size("_path") >= F.col("num_days"))).withColumn("_path", F.slice("_path", 1, F.col("num_days")))
    up, down = F.col("close") * (1 + F.greatest(s * F.col("take_profit_mult"), -s * F.col("stop_loss_mult")) * F.col("vol")), F.col("close") * (1 + F.least(s * F.col("take_profit_mult"), -s * F.col("stop_loss_mult")) * F.col("vol"))
    df = df.withColumns({"_up": up, "_down": down}).withColumn("_touch", F.try_element_at(F.filter("_path", lambda p: (p["close"] >= F.col("_up")) | (p["close"] <= F.col("_down"))), F.lit(1)))
    end = F.coalesce(F.col("_touch"), F.try_element_at("_path", F.lit(-1)))
    label = F.when(F.col("_touch").isNull(), 0).when(F.col("_touch.close") >= F.col("_up"), 1).otherwise(-1)
    df = df.withColumns({"touch_date": end["date"], "touch_price": end["close"], "triple_barrier_label": label})
    signed = (F.col("touch_price") / F.col("close") - 1) * s
    return df.withColumns({"signed_touch_return": signed, "holding_period_days": F.date_diff("touch_date", "date")}).withColumn("metalabel", (F.col("signed_touch_return") > 0).cast("int")).drop("_path", "_touch", "_up", "_down")


def sweep_summary(labels: DataFrame) -> DataFrame:
    """Counts and rates of labels by instrument and configuration."""
    tb = lambda k: F.count_if(F.col("triple_barrier_label") == k)
    return labels.groupBy("instrument", "config_name").agg(
        F.count("*").alias("rows"), F.count_if(F.col("metalabel") == 0).alias("metalabel_0_count"), F.count_if(F.col("metalabel") == 1).alias("metalabel_1_count"), F.avg("metalabel").alias("metalabel_1_rate"),
        tb(-1).alias("tb_label_neg1_count"), tb(0).alias("tb_label_0_count"), tb(1).alias("tb_label_1_count"), F.avg("holding_period_days").alias("avg_holding_period_days"),
    )


def label_high_low(bars: DataFrame, horizon: int = 10, up: float = 2.0, down: float = 2.0, span: int = 20, least: int = 10) -> DataFrame:
    """Long-side labels of every bar by its next highs and lows: 1 if a high reaches the upper barrier first, -1 for the lower, else 0.

    A bar that straddles both counts as up. Bars without a volatility or a full horizon have label 0.
    """
    df = with_ewm(bars.withColumn("_ret", safe_div("close", F.lag("close").over(by_date())) - 1), Ewm("vol", "_ret", "std", span=span, adjust=True, least=least))
    path = F.collect_list(F.struct("date", "high", "low", "close")).over(by_date().rowsBetween(1, horizon))
    df = df.withColumns({"_path": path, "upper": F.col("close") * (1 + up * F.col("vol")), "lower": F.col("close") * (1 - down * F.col("vol"))})
    df = df.withColumn("_t", _first_touch(F.col("_path"), F.col("upper"), F.col("lower")))
    full = (F.size("_path") == horizon) & F.col("vol").isNotNull()
    label = F.when(~full | F.col("_t").isNull(), 0).when(F.col("_t.high") >= F.col("upper"), 1).otherwise(-1)
    return df.select("date", "instrument", "close", "vol", "upper", "lower", label.alias("label"), F.when(full, F.coalesce(F.col("_t.date"), F.try_element_at("_path", F.lit(-1))["date"])).alias("t1"))


def barrier_balance(labels: DataFrame, by: list[str], positive: str = "metalabel") -> DataFrame:
    """1 - 2 |p - 1/2| of the share p of positive labels, for each parameter set."""
    return labels.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(positive).alias("p")).withColumn("balance", 1 - 2 * F.abs(F.col("p") - 0.5))


def best_balanced(balance: DataFrame, by: list[str], param: str) -> DataFrame:
    """The parameter of the best balance in each group; ties go to the first by name."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("balance"), param)
    return balance.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def forward_signed_return(bars: DataFrame, horizon: int, side: Column) -> Column:
    """Percent return over the next ``horizon`` rows of ``bars`` in the direction of ``side``; 0 where the horizon isn't complete.

    Rows are counted as they come: over a cleaned panel those that survived, over all bars every bar.
    """
    return F.coalesce(100 * side * (safe_div(F.lead("close", horizon).over(by_date()), "close") - 1), F.lit(0.0))
