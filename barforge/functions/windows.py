"""Window primitives over an instrument's bars: lags, full frames, safe division."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_stages: list[dict[str, Column]] = []


@contextmanager
def staged() -> Iterator[dict[str, Column]]:
    """Collects the window columns that the functions here make of named columns, by a name each, and gives back references to them.

    ``df.withColumns(stage)`` then computes every frame once, in one window stage, however many expressions use it.
    """
    _stages.append({})
    try:
        yield _stages[-1]
    finally:
        _stages.pop()


def _shared(name: str, x: Column | str, window: Column) -> Column:
    if not _stages or not isinstance(x, str):
        return window
    _stages[-1].setdefault(name, window)
    return F.col(name)


def by_date():
    return Window.partitionBy("instrument").orderBy("date")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(n: int):
    """The last n rows, this one included."""
    return by_date().rowsBetween(-(n - 1), 0)


def lag(x: Column | str, n: int = 1) -> Column:
    return _shared(f"_lag_{n}_{x}", x, F.lag(c(x), n).over(by_date()))


def lead(x: Column | str, n: int = 1) -> Column:
    return F.lead(c(x), n).over(by_date())


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(c(a), c(b))


def over(agg, x: Column | str, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n rows, null until ``least`` (else n) of them are not null."""
    known = _shared(f"_count_{n}_{x}", x, F.count(c(x)).over(frame(n)))
    return F.when(known >= (least or n), _shared(f"_{agg.__name__}_{n}_{x}", x, agg(c(x)).over(frame(n))))


def last_values(x: Column | str, n: int) -> Column:
    """The values of the last n rows as an array, nulls left out."""
    return _shared(f"_list_{n}_{x}", x, F.collect_list(c(x)).over(frame(n)))


def mean(x, n: int, least: int | None = None) -> Column:
    return over(F.avg, x, n, least)


def std(x, n: int, least: int | None = None) -> Column:
    return over(F.stddev_samp, x, n, least)


def total(x, n: int, least: int | None = None) -> Column:
    return over(F.sum, x, n, least)


def low(x, n: int, least: int | None = None) -> Column:
    return over(F.min, x, n, least)


def high(x, n: int, least: int | None = None) -> Column:
    return over(F.max, x, n, least)


def zscore(x, n: int) -> Column:
    """Distance from the mean of the last n rows in their deviations; null where these are equal."""
    return safe_div(c(x) - mean(x, n), std(x, n))


def finite(x: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
