"""Exponentially weighted means and deviations of an instrument's series, one linear pass for all of them."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Ewm(NamedTuple):
    """One output column: ``kind`` is "mean" or "std" of column ``of``; the decay is given by ``span`` or ``alpha``. "minus": the difference of two columns."""

    name: str
    of: str | tuple[str, str]
    kind: str = "mean"
    span: float | None = None
    alpha: float | None = None
    adjust: bool = False
    least: int = 0


def with_ewm(df: DataFrame, *specs: Ewm) -> DataFrame:
    """``df`` with the columns of ``specs``, each over an instrument's rows by date; a spec may use one before it.

    Leading nulls are skipped and the first value seeds the recursion. One group is one instrument's bars, a few
    thousand rows a decade; Spark sends it in one Arrow batch, and all columns share that pass.
    """
    schema = T.StructType([*df.schema, *[T.StructField(s.name, T.DoubleType()) for s in specs]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", kind="stable")
        for s in specs:
            if s.kind == "minus":
                rows[s.name] = rows[s.of[0]] - rows[s.of[1]]
                continue
            e = rows[s.of].astype(float).ewm(span=s.span, alpha=s.alpha, adjust=s.adjust, min_periods=s.least)
            rows[s.name] = e.mean() if s.kind == "mean" else e.std()
        return rows

    out = df.groupBy("instrument").applyInPandas(run, schema)
    return out.withColumns({s.name: F.when(~F.isnan(s.name), F.col(s.name)) for s in specs})


def ewm_mean_native(values: Column, alpha: float) -> Column:
    """The last exponentially weighted mean (not adjusted) of an array without nulls, inside the JVM."""
    return F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), lambda acc, v: (1 - alpha) * acc + alpha * v)
