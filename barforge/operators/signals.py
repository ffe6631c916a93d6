"""Signals and market features: unpivot, run lengths, volume and candle features, spans, encodings, the joined matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import by_date, lag, mean, safe_div, std, total, zscore

VOLATILITY_LABELS = ("low_vol", "normal_vol", "high_vol", "extreme_vol")
RETURN_LABELS = ("downside", "weak", "positive", "strong_upside")
MARKET_LABELS = ("stress", "upside_breakout", "calm_positive", "calm_negative", "chop")


def unpivot_signals(wide: DataFrame, value: str = "primary_signal", name: str = "instrument") -> DataFrame:
    """date, instrument (lower-case), value: one row for each date and column, nulls kept."""
    cols = [c for c in wide.columns if c != "date"]
    return wide.unpivot("date", cols, name, value).withColumn(name, F.lower(name))


def active_instruments(signals: DataFrame) -> DataFrame:
    """Rows, span and active signals of each instrument."""
    return signals.groupBy("instrument").agg(F.count("*").alias("rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count_if(F.col("primary_signal") != 0).alias("active_signals"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, null too, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))


def signal_behaviour(signals: DataFrame) -> DataFrame:
    """Whether the signal changed (never at the first row), rows since it did, and means and sums of recent ones."""
    w = by_date()
    before = F.lag("primary_signal").over(w)
    first = F.row_number().over(w) == 1
    # A missing signal differs from anything, another missing one included.
    same = F.coalesce(F.col("primary_signal") == before, F.lit(False))
    changed = F.when(first, 0).otherwise((~same).cast("int"))
    out = signals.withColumn("signal_changed", changed)
    out = out.withColumn("_run", F.sum("signal_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("instrument", "_run").orderBy("date")
    s = F.col("primary_signal").cast("double")
    return out.select(
        "date", "instrument", "signal_changed", (F.row_number().over(run) - 1).alias("days_since_signal_change"),
        mean(s, 5, 1).alias("signal_rolling_mean_5d"), mean(s, 20, 1).alias("signal_rolling_mean_20d"), total(F.abs(s), 20, 1).alias("signal_abs_rolling_sum_20d"),
    )


def _positive(x: str) -> Column:
    return F.when(F.col(x) > 0, F.col(x))


def market_features(bars: DataFrame) -> DataFrame:
    """Volume and open interest changes and z-scores, candle shape, gap, and the volatility used in interactions."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    out = bars.withColumn("_ret", safe_div("close", lag("close")) - 1)
    return out.select(
        "date", "instrument",
        (F.log(_positive("volume")) - F.log(lag(_positive("volume")))).alias("volume_log_change"), (F.log(_positive("open_interest")) - F.log(lag(_positive("open_interest")))).alias("open_interest_log_change"),
        *[zscore(x, n).alias(f"{x}_zscore_{n}d") for x in ("volume", "open_interest") for n in (20, 63)],
        safe_div("volume", "open_interest").alias("volume_to_open_interest"), safe_div(F.col("high") - F.col("low"), "close").alias("range_pct"), safe_div(F.col("close") - F.col("open"), "open").alias("body_pct"),
        safe_div(F.col("high") - top, "close").alias("upper_wick_pct"), safe_div(bottom - F.col("low"), "close").alias("lower_wick_pct"),
        safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("close_position_in_bar"), (safe_div("open", lag("close")) - 1).alias("gap_open_pct"), std("_ret", 20).alias("vol_20d_for_interaction"),
    )


def spans(df: DataFrame, value: str) -> DataFrame:
    """start, end, rows of each stretch of equal values; stretches of nulls are left out."""
    w = by_date()
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    out = df.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col(value).isNotNull()).groupBy("instrument", "_run").agg(F.first(value).alias(value), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("rows")).drop("_run")


def switches(df: DataFrame, value: str) -> DataFrame:
    """How often the value differs from that of the row before, by instrument."""
    before = F.lag(value).over(by_date())
    return df.withColumn("_s", (F.col(value) != before).cast("int")).groupBy("instrument").agg(F.count("*").alias("rows"), F.coalesce(F.sum("_s"), F.lit(0)).alias("switches"))


def category_code(source: str, labels) -> Column:
    """A label's place in ``labels``, as a double; null for others."""
    found = F.array_position(F.array(*map(F.lit, labels)), F.col(source))
    return F.when(found > 0, (found - 1).cast("double"))


def one_hot(source: str, prefix: str, values) -> dict[str, Column]:
    """A flag for a missing value, and one for each value that is null where the value is missing."""
    return {f"{source}_missing": F.col(source).isNull().cast("int"), **{f"{prefix}_{v}": (F.col(source) == F.lit(v)).cast("int") for v in values}}


def encode_regimes(df: DataFrame) -> DataFrame:
    """Codes and flags of the regime labels, in place of the labels."""
    flags = {"hmm_regime_missing": F.col("hmm_predicted_regime").isNull().cast("int"), **{f"hmm_regime_{k}": (F.col("hmm_predicted_regime") == k).cast("int") for k in range(4)}}
    kinds = (("hmm_volatility_regime", "hmm_volatility", VOLATILITY_LABELS), ("hmm_return_regime", "hmm_return", RETURN_LABELS), ("hmm_market_state", "hmm_market", MARKET_LABELS))
    for source, prefix, labels in kinds:
        flags |= {f"{source}_code": category_code(source, labels), **one_hot(source, prefix, labels)}
    return df.withColumns(flags).drop(*[k for k, _, _ in kinds])


def interactions(df: DataFrame) -> DataFrame:
    """Six products of signals, returns and volatility with regime confidence and probabilities."""
    pairs = {
        "signal_x_hmm_confidence": ("primary_signal", "hmm_regime_confidence"), "ret_5d_x_hmm_confidence": ("ret_5d", "hmm_regime_confidence"), "vol_20d_x_hmm_confidence": ("vol_20d_for_interaction", "hmm_regime_confidence"),
        "signal_x_hmm_prob_stress": ("primary_signal", "hmm_prob_stress"), "signal_x_hmm_prob_high_or_extreme_vol": ("primary_signal", "hmm_prob_high_or_extreme_vol"),
        "signal_x_hmm_prob_positive_or_strong_upside": ("primary_signal", "hmm_prob_positive_or_strong_upside"),
    }
    return df.withColumns({k: F.col(a) * F.col(b) for k, (a, b) in pairs.items()})


def mapping_catalog(spark) -> DataFrame:
    """The codes of the regime labels, one row for each."""
    rows = [(s, f"{s}_code", v, i, kind) for s, labels, kind in (("hmm_volatility_regime", VOLATILITY_LABELS, "ordered"), ("hmm_return_regime", RETURN_LABELS, "ordered"), ("hmm_market_state", MARKET_LABELS, "nominal")) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "source_column string, encoded_column string, category_label string, numeric_value int, mapping_type string")


def feature_catalog(spark, groups: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """feature_name, feature_group, source of named groups of columns, each name once: its first group keeps it. Sorted by group and name."""
    seen: dict[str, tuple[str, str, str]] = {}
    for group, (source, cols) in groups.items():
        for c in cols:
            seen.setdefault(c, (c, group, source))
    rows = sorted(seen.values(), key=lambda r: (r[1], r[0]))
    return spark.createDataFrame(rows, "feature_name string, feature_group string, source string")


def first_of_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key: the first in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def validation_vector(matrix: DataFrame, features: list[str], signal_rows: int) -> DataFrame:
    """One row of checks of a matrix: size, dates, instruments, missing feature columns, keys that repeat, infinite values and rows without a close."""
    numeric = [f.name for f in matrix.schema if f.dataType.typeName() in ("double", "float")]
    infinite = sum((F.coalesce((F.abs(F.col(f"`{c}`")) == float("inf")).cast("long"), F.lit(0)) for c in numeric), F.lit(0).cast("long"))
    keys = matrix.groupBy("date", "instrument").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicate_date_instrument_keys"))
    out = matrix.agg(
        F.count("*").alias("rows"), F.lit(len(matrix.columns)).alias("columns"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count_distinct("instrument").alias("instrument_count"),
        F.lit(len(set(features) & set(matrix.columns))).alias("technical_feature_count"), F.lit(len(set(features) - set(matrix.columns))).alias("missing_ta_columns"), F.sum(infinite).alias("infinite_numeric_values"), F.count_if(F.col("close").isNull()).alias("missing_close_rows"),
        (F.count("*") == signal_rows).alias("keeps_signal_rows"),
    )
    return out.join(F.broadcast(keys), F.lit(True))  # a row each


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def validate_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself; raises if a key repeats. For tests and small dimension tables: it runs a job."""
    if duplicate_keys(df, *keys).limit(1).count():
        raise ValueError(f"keys {keys} repeat")
    return df


def star_matrix(signals: DataFrame, *sides: DataFrame) -> DataFrame:
    """Signals with the columns of every side by (date, instrument), left joins: a signal without a bar stays.

    Columns that a side shares with those before it are taken from the first.
    """
    out = signals
    for side in sides:
        out = out.join(side.drop(*[c for c in side.columns if c in out.columns and c not in ("date", "instrument")]), ["date", "instrument"], "left")
    return out
