"""Small relational operators: pivoted counts, modes, even samples, grids, combinations, clipping, joins by position."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """How often each pair of values occurs, a column for each of ``values``, 0 where it doesn't."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def mode_by(df: DataFrame, by: str, column: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals."""
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).count()
    return counts.groupBy(by).agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias("mode"))


def evenly_spaced(df: DataFrame, n: int) -> DataFrame:
    """Of each instrument, the rows at ``n`` positions spread evenly from its first to its last by date; one position is the first, none are none."""
    if n < 1:
        return df.limit(0)
    w = Window.partitionBy("instrument")
    rows = df.withColumns({"_at": F.row_number().over(w.orderBy("date")) - 1, "_n": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(1, n - 1)))
    return rows.where(F.array_contains(wanted, F.col("_at").cast("bigint"))).drop("_at", "_n")


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of some parameters' values."""
    return spark.createDataFrame([tuple(x) for x in product(*axes.values())], list(axes))


def clip_to(df: DataFrame, train: DataFrame, cols: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns clipped to quantiles of the training rows, nulls kept: one row of bounds, broadcast."""
    bounds = train.agg(*[F.percentile(c, q).alias(f"_{c}_{k}") for c in cols for k, q in (("lo", low), ("hi", high))])
    out = df.join(F.broadcast(bounds), F.lit(True))
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.col(f"_{c}_lo"), F.least(F.col(f"_{c}_hi"), F.col(c)))) for c in cols}).select(df.columns)


def issue_flags(df: DataFrame, **rules) -> DataFrame:
    """``df`` with issues, the names of the rules that hold for a row, joined by semicolons."""
    return df.withColumn("issues", F.concat_ws(";", *[F.when(rule, name) for name, rule in rules.items()]))


def missing_names(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with missing, the names of its columns that are null, joined by semicolons."""
    return df.withColumn("missing", F.concat_ws(";", *[F.when(F.col(c).isNull(), c) for c in cols]))


def present(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``df`` whose keys ``other`` has; null keys aren't there."""
    return df.join(other.select(*keys), list(keys), "left_semi")


def absent(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``df`` whose keys ``other`` doesn't have."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def column_sets(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Column names of both, of the first only and of the second only, each in their order."""
    return [c for c in a.columns if c in b.columns], [c for c in a.columns if c not in b.columns], [c for c in b.columns if c not in a.columns]
