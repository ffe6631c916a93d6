"""Volatility-targeted weights from probabilities and signals, caps, and comparisons of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ewm import Ewm, with_ewm
from ..functions.scalars import probability_size
from ..functions.windows import lag, safe_div
from .cpcv import sharpe

TARGET_VOL, MAX_WEIGHT, MAX_GROSS, SPAN, LEAST = 0.10, 0.25, 1.0, 60, 20


def annual_vol(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """date, instrument, annualized_ewma_vol: of simple returns up to and with each date."""
    df = with_ewm(bars.withColumn("_ret", safe_div("close", lag("close")) - 1), Ewm("_v", "_ret", "std", span=span, least=LEAST))
    return df.select("date", "instrument", (F.col("_v") * 252**0.5).alias("annualized_ewma_vol"))


def cap(x: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def gross_capped(df: DataFrame, weight: str = "capped_weight", most: float = MAX_GROSS, out: str = "weight") -> DataFrame:
    """Weights scaled down by date where their absolute values add up to more than ``most``."""
    gross = F.sum(F.abs(weight)).over(Window.partitionBy("date"))
    return df.withColumn(out, F.col(weight) * F.when(gross > most, most / F.nullif(gross, F.lit(0.0))).otherwise(1.0))


def allocate(predictions: DataFrame, signals: DataFrame, vol: DataFrame, method: str = "ncdf", threshold: float = 0.5, most_gross: float = MAX_GROSS) -> DataFrame:
    """Direction x size x target volatility / volatility, capped by instrument and then by date; the full diagnostics."""
    df = predictions.join(signals, ["date", "instrument"], "left").join(vol, ["date", "instrument"], "left")
    df = df.withColumn("primary_signal", F.coalesce("primary_signal", F.lit(0))).withColumn("size", probability_size(F.col("prediction"), method, threshold))
    active = F.col("primary_signal").isin(-1, 1) & (F.col("annualized_ewma_vol") > 0)
    raw = F.when(active, F.col("primary_signal") * F.col("size") * TARGET_VOL / F.nullif("annualized_ewma_vol", F.lit(0.0))).otherwise(0.0)
    return gross_capped(df.withColumn("raw_weight", raw).withColumn("capped_weight", cap(F.col("raw_weight"), MAX_WEIGHT)), most=most_gross)


def head_weight(score: Column, side: Column, most: float = MAX_WEIGHT) -> Column:
    """A tanh head's weight: side x cap x tanh(score) squared."""
    return side * most * F.pow(F.tanh(score), 2)


def align_weights(fixed: DataFrame, neural: DataFrame, next_returns: DataFrame) -> DataFrame:
    """Both strategies' weights side by side (a missing one is 0), their difference, sign agreement and profits."""
    df = fixed.select("date", "instrument", F.col("weight").alias("fixed_weight")).join(neural.select("date", "instrument", F.col("weight").alias("neural_weight")), ["date", "instrument"], "full_outer")
    df = df.join(next_returns, ["date", "instrument"], "left").na.fill(0.0, ["fixed_weight", "neural_weight"])
    return df.withColumns({
        "weight_diff": F.col("neural_weight") - F.col("fixed_weight"), "same_sign": F.signum("fixed_weight") == F.signum("neural_weight"),
        "fixed_pnl": F.col("fixed_weight") * F.col("next_return"), "neural_pnl": F.col("neural_weight") * F.col("next_return"),
    })


def strategy_summary(aligned: DataFrame, pnl_agg: str = "row_mean") -> DataFrame:
    """Exposure and annualised performance of each strategy.

    ``pnl_agg``: a day's profit is the mean over its rows ("row_mean", for compatibility) or their sum ("portfolio_sum", the portfolio's return).
    """
    if pnl_agg not in ("row_mean", "portfolio_sum"):
        raise ValueError(f"unknown pnl_agg {pnl_agg!r}")
    long = aligned.selectExpr("date", "stack(2, 'fixed', fixed_weight, fixed_pnl, 'neural', neural_weight, neural_pnl) as (strategy, w, pnl)")
    day = long.groupBy("strategy", "date").agg(F.count("*").alias("rows"), F.sum(F.abs("w")).alias("gross"), F.sum("w").alias("net"), (F.avg if pnl_agg == "row_mean" else F.sum)("pnl").alias("pnl"), F.count_if(F.col("w") != 0).alias("active"), F.max(F.abs("w")).alias("top"))
    return day.groupBy("strategy").agg(
        F.sum("rows").alias("rows"), F.sum("active").alias("nonzero_weights"), F.try_divide(F.sum("gross"), F.sum("rows")).alias("mean_abs_weight"), F.max("top").alias("max_abs_weight"), F.avg("gross").alias("mean_daily_gross"), F.max("gross").alias("max_daily_gross"),
        F.avg("net").alias("mean_daily_net"), F.avg("active").alias("mean_active_count"), F.avg("pnl").alias("mean_daily_pnl"), (F.stddev_samp("pnl") * 252**0.5).alias("annualized_vol"), sharpe(F.col("pnl"), 252**0.5).alias("annualized_sharpe"), F.sum("pnl").alias("cumulative_pnl"),
    )


def instrument_summary(aligned: DataFrame) -> DataFrame:
    """Mean and largest weights, differences, sign agreement and, where both vary, the correlation of weights."""
    vary = (F.stddev_samp("fixed_weight") > 0) & (F.stddev_samp("neural_weight") > 0)
    cov = F.covar_samp("fixed_weight", "neural_weight")
    sd = F.nullif(F.stddev_samp("fixed_weight") * F.stddev_samp("neural_weight"), F.lit(0.0))
    return aligned.groupBy("instrument").agg(
        F.count("*").alias("rows"), F.avg(F.abs("fixed_weight")).alias("fixed_mean_abs_weight"), F.avg(F.abs("neural_weight")).alias("neural_mean_abs_weight"), F.avg("weight_diff").alias("mean_weight_diff"), F.avg(F.abs("weight_diff")).alias("mean_abs_weight_diff"),
        F.avg(F.col("same_sign").cast("int")).alias("same_sign_rate"), F.when(vary, cov / sd).alias("weight_correlation"),
    )


def daily_panel(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("date").agg(*[F.sum(F.abs(f"{k}_weight")).alias(f"{k}_gross") for k in ("fixed", "neural")], *[F.sum(f"{k}_weight").alias(f"{k}_net") for k in ("fixed", "neural")], *[F.avg(f"{k}_pnl").alias(f"{k}_pnl") for k in ("fixed", "neural")])
