"""Scalar functions: normal distribution, bet sizes, logistic, log-sum-exp, hash draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the error function's rational approximation (Abramowitz and Stegun 7.1.26); absolute error 1.5e-7.
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    p, *a = ERF
    t = 1 / (1 + p * F.abs(x))
    poly = ((((a[4] * t + a[3]) * t) + a[2]) * t + a[1]) * t + a[0]
    return F.signum(x) * (1 - poly * t * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


def probability_size(p: Column, method: str = "ncdf", threshold: float = 0.5) -> Column:
    """0 up to the threshold; above it 1, the probability, or the normal distribution of its distance from a half."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    root = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)))
    sizes = {"all_or_nothing": F.lit(1.0), "model_confidence": p, "ncdf": normal_cdf((p - 0.5) / root)}
    if method not in sizes:
        raise ValueError(f"unknown sizing method {method!r}; known are {sorted(sizes)}")
    return F.when(p <= threshold, 0.0).otherwise(sizes[method])


def sigmoid(x: Column) -> Column:
    x = F.greatest(F.lit(-709.0), F.least(F.lit(709.0), x))
    return 1 / (1 + F.exp(-x))


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by bars; the same on every run and engine."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
