"""Exact quantiles of long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_quantiles(long: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``by``, share, quantile: linear between the two nearest values; nulls don't count, and a group without values has no rows.

    Values are counted first, with a map-side combine, so equal ones move once a task. A group's different values are sorted, which
    spills, rather than held: only the rows around each share go on.
    """
    counts = long.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = counts.withColumn("_upto", upto).join(totals, by)
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    at = at.select("*", wanted).withColumn("_at", F.col("share") * (F.col("_all") - 1))
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    low, high = F.floor("_at"), F.ceil("_at")
    at = at.where((first <= high) & (last >= low))
    pick = lambda place: F.max(F.when((first <= place) & (last >= place), F.col("_v")))
    out = at.groupBy(*by, "share").agg(pick(low).alias("_lo"), pick(high).alias("_hi"), F.max(F.col("_at") - low).alias("_w"))
    return out.select(*by, "share", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias("quantile"))
