"""Schemas of the tables the library reads, and daily bars from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Schemas as DDL, for spark.read.schema().
BARS = "date DATE, instrument STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, open_interest DOUBLE"
SIGNALS_LONG = "date DATE, instrument STRING, primary_signal INT"
PREDICTIONS = "date DATE, instrument STRING, prediction DOUBLE"
#: Order keys in a piece of a day's ticks.
SPAN = 1 << 18


def bars_from_ticks(lineitem: DataFrame) -> DataFrame:
    """Daily open, high, low, close, volume and open interest of each return flag, an instrument here.

    A line's discount less five percent is a tick's shock; a day's shocks add up in the order of its lines, scaled by
    the root of their number, to a path of log prices from the close of the day before. Running sums, whole numbers, go over pieces of a
    day, runs of SPAN order keys, and a piece begins where the sums of those before it end: no task sorts a busy day's ticks.
    Only days, not ticks, enter the window of an instrument.
    """
    shock = F.round(F.col("l_discount") * 100).cast("int") - 5
    ticks = lineitem.select(
        F.col("l_returnflag").alias("instrument"), F.col("l_shipdate").cast("date").alias("date"), shock.alias("shock"),
        F.floor(F.col("l_orderkey") / SPAN).alias("piece"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    )
    piece = ("instrument", "date", "piece")
    order = Window.partitionBy(*piece).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    run = F.sum("shock").over(order.rowsBetween(Window.unboundedPreceding, 0))
    pieces = ticks.withColumn("run", run).groupBy(*piece).agg(
        F.count("*").alias("n"), F.sum("shock").alias("s"), F.min("run").alias("lo"), F.max("run").alias("hi"), F.sum("l_quantity").alias("volume"), F.count_distinct("l_orderkey").alias("orders"),
    )
    so_far = F.coalesce(F.sum("s").over(Window.partitionBy("instrument", "date").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = pieces.withColumns({"lo": so_far + F.col("lo"), "hi": so_far + F.col("hi")}).groupBy("instrument", "date").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.least(F.lit(0), F.min("lo")).alias("lo"), F.greatest(F.lit(0), F.max("hi")).alias("hi"), F.sum("volume").alias("volume"), F.sum("orders").cast("double").alias("open_interest"),
    )
    before = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.lit(0.01) * F.col("s") / F.sqrt(F.col("n").cast("double"))).over(before), F.lit(0.0))
    price = lambda k: F.round(100 * F.exp(F.col("base") + F.lit(0.01) * F.col(k) / F.sqrt(F.col("n").cast("double"))), 4)
    return days.withColumn("base", base).select(
        "date", "instrument", F.round(100 * F.exp("base"), 4).alias("open"), price("hi").alias("high"), price("lo").alias("low"), price("s").alias("close"), "volume", "open_interest",
    )


def signals_from_bars(bars: DataFrame, days: int = 5, dead: float = 0.01) -> DataFrame:
    """date, instrument, primary_signal: the sign of the return over ``days`` bars, 0 within ``dead``; null before there is one."""
    w = Window.partitionBy("instrument").orderBy("date")
    r = F.try_divide("close", F.lag("close", days).over(w)) - 1
    return bars.select("date", "instrument", F.when(r > dead, 1).when(r < -dead, -1).when(r.isNotNull(), 0).alias("primary_signal"))


def signals_wide(signals: DataFrame, instruments: list[str]) -> DataFrame:
    """One column of signals for each instrument, one row for each date."""
    return signals.groupBy("date").pivot("instrument", instruments).agg(F.max("primary_signal"))
