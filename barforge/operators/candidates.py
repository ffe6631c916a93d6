"""Candidates over cross-validation splits: fold-local features, a model and out-of-fold scores, one task for each instrument and split."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import metrics, network
from .cpcv import path_sharpes, stitch

METHODS = ("none", "corr_cluster", "linkage", "pca", "cluster_pca")
MODELS = ("fixed", "l1", "l2", "elastic", "vsn")
#: Columns are clipped to these quantiles of the training rows, and to this size.
CLIP, CAP = (0.01, 0.99), 1e6


class Candidate(NamedTuple):
    """A model and a way to make its features. ``weights`` (fixed models): one a column of the standardised features, the intercept last."""

    candidate: str
    model: str = "l2"
    method: str = "none"
    C: float = 1.0
    l1_ratio: float = 0.5
    weights: tuple[float, ...] = ()
    corr: float = 0.9
    share: float = 0.95
    protected: tuple[str, ...] = ()
    params: tuple[tuple[str, float], ...] = ()


# ---- one fold, in numpy ----------------------------------------------------------------------------------------------


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks, from 1."""
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2.0)[inverse]


def pair_corr(x: np.ndarray, method: str = "spearman", least: int = 20) -> np.ndarray:
    """Correlations of all pairs of columns over the rows that have both; nan below ``least`` rows or for a constant."""
    d = x.shape[1]
    out = np.full((d, d), np.nan)
    known = ~np.isnan(x)
    for i in range(d):
        for j in range(i, d):
            both = known[:, i] & known[:, j]
            if both.sum() < least:
                continue
            a, b = x[both, i], x[both, j]
            if method == "spearman":
                a, b = ranks(a), ranks(b)
            sd = a.std() * b.std()
            if sd > 0:
                out[i, j] = out[j, i] = ((a - a.mean()) * (b - b.mean())).mean() / sd
    return out


def linked(corr: np.ndarray, least: float) -> list[list[int]]:
    """Groups of columns that correlations of ``least`` or more, by size, connect."""
    near = np.nan_to_num(np.abs(corr)) >= least
    np.fill_diagonal(near, True)
    group = np.arange(len(near))
    while True:
        new = np.array([group[r].min() for r in near])
        if (new == group).all():
            return [np.flatnonzero(group == g).tolist() for g in np.unique(group)]
        group = new


def average_linkage(distance: np.ndarray, most: float) -> list[list[int]]:
    """Groups that average linkage has made when the nearest two are further apart than ``most``."""
    groups = [[i] for i in range(len(distance))]
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = divmod(int(d.argmin()), len(groups))
        if d[i, j] > most:
            break
        i, j = min(i, j), max(i, j)
        a, b = len(groups[i]), len(groups[j])
        joined = (a * d[i] + b * d[j]) / (a + b)
        d[i], d[:, i] = joined, joined
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


def mutual_information(x: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    """Of a column, binned between its quantiles, and a class, in nats; rows without a value don't count."""
    known = ~np.isnan(x)
    x, y = x[known], y[known]
    if not len(x):
        return 0.0
    at = np.searchsorted(np.quantile(x, np.arange(1, bins) / bins), x, side="left")
    table = np.zeros((bins, int(y.max()) + 1))
    np.add.at(table, (at, y.astype(int)), 1.0)
    p = table / len(x)
    independent = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    some = p > 0
    return float((p[some] * np.log(p[some] / independent[some])).sum())


def chosen(x: np.ndarray, y: np.ndarray, groups: list[list[int]], score: np.ndarray) -> list[int]:
    """One column of each group: the highest score, then the fewest missing, the most values, the largest variance, the first."""
    def order(c: int):
        v = x[~np.isnan(x[:, c]), c]
        return (-np.nan_to_num(score[c], nan=-np.inf), np.isnan(x[:, c]).mean(), -len(np.unique(v)), -(v.var(ddof=1) if len(v) > 1 else -np.inf), c)

    return sorted(min(g, key=order) for g in groups)


def target_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Absolute correlation of each column with the target."""
    return np.array([abs(pair_corr(np.column_stack([x[:, c], y]), "pearson", 3)[0, 1]) for c in range(x.shape[1])])


class Scaler(NamedTuple):
    low: np.ndarray
    high: np.ndarray
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(np.clip(x, self.low, self.high), -CAP, CAP)
        return (np.where(np.isnan(x), self.median, x) - self.mean) / self.std


def scaler(x: np.ndarray) -> Scaler:
    """Clips to quantiles and CAP, fills with the median and standardises by population deviations, all of the rows it is fitted on."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # columns without values
        low, high = np.nanquantile(x, CLIP[0], axis=0), np.nanquantile(x, CLIP[1], axis=0)
        clipped = np.clip(np.clip(x, low, high), -CAP, CAP)
        median = np.nan_to_num(np.nanmedian(clipped, axis=0))
    full = np.where(np.isnan(clipped), median, clipped)
    sd = full.std(0)
    return Scaler(low, high, median, full.mean(0), np.where(sd > 0, sd, 1.0))


def fold_features(train: np.ndarray, test: np.ndarray, y: np.ndarray, names: list[str], c: Candidate) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Both parts of a fold with the features of the candidate's method, fitted on the training rows alone."""
    if c.method not in METHODS:
        raise ValueError(f"unknown method {c.method!r}; known are {METHODS}")
    fixed = [i for i, n in enumerate(names) if n in c.protected]
    free = [i for i, n in enumerate(names) if n not in c.protected]
    if c.method in ("corr_cluster", "cluster_pca", "linkage") and free:
        corr = pair_corr(train[:, free])
        if c.method == "linkage":
            groups = average_linkage(1 - np.nan_to_num(np.abs(corr)), 1 - c.corr)
            score = np.array([mutual_information(train[:, i], y) for i in free])
        else:
            groups, score = linked(corr, c.corr), target_scores(train[:, free], y)
        free = [free[i] for i in chosen(train[:, free], y, groups, score)]
    if c.method in ("pca", "cluster_pca") and free:
        with np.errstate(invalid="ignore"):
            low, high = np.nanquantile(train[:, free], CLIP[0], axis=0), np.nanquantile(train[:, free], CLIP[1], axis=0)
            sd = np.nanstd(np.clip(train[:, free], low, high), axis=0, ddof=1)
        free = [i for i, s in zip(free, sd, strict=True) if s > 1e-8]
        if not free:
            raise ValueError("no column varies in this fold")
        scale = scaler(train[:, free])
        a, b = scale(train[:, free]), scale(test[:, free])
        centre = a.mean(0)
        _, s, v = np.linalg.svd(a - centre, full_matrices=False)
        k = min(int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), c.share)) + 1, len(s))
        v = v[:k] * np.where(np.abs(v[:k]).max(1) == v[:k].max(1), 1.0, -1.0)[:, None]  # the largest loading is positive
        out = [np.hstack([x[:, fixed], (z - centre) @ v.T]) for x, z in ((train, a), (test, b))]
        return out[0], out[1], [names[i] for i in fixed] + [f"pca_{i + 1:03d}" for i in range(k)]
    keep = sorted(fixed + free)
    return train[:, keep], test[:, keep], [names[i] for i in keep]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def logistic(x: np.ndarray, y: np.ndarray, C: float = 1.0, l1: float = 0.0, balanced: bool = True, rounds: int = 5000, tol: float = 1e-9) -> np.ndarray:
    """Weights, the intercept last, of the least C x weighted log loss + l1 |w| + (1 - l1) |w|^2 / 2, by accelerated proximal steps."""
    n = len(y)
    s = np.where(y == 1, n / (2.0 * max(1, (y == 1).sum())), n / (2.0 * max(1, (y == 0).sum()))) if balanced else np.ones(n)
    a = np.column_stack([x, np.ones(n)])
    step = 1.0 / (0.25 * C * np.linalg.norm(a * np.sqrt(s)[:, None], 2) ** 2 + (1 - l1))
    w = np.zeros(a.shape[1])
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        grad = C * (a.T @ (s * (sigmoid(a @ z) - y)))
        grad[:-1] += (1 - l1) * z[:-1]
        new = z - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0.0)
        if (z - new) @ (new - w) > 0:  # the momentum points uphill
            t = 1.0
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + (before - 1) / t * (new - w)
        moved = np.abs(new - w).max()
        w = new
        if moved < tol:
            break
    return w


def fold_scores(train: np.ndarray, test: np.ndarray, y: np.ndarray, names: list[str], c: Candidate) -> np.ndarray:
    """P(1) of the test rows by the candidate, fitted on the training rows."""
    if c.model not in MODELS:
        raise ValueError(f"unknown model {c.model!r}; known are {MODELS}")
    train, test, used = fold_features(train, test, y, names, c)
    scale = scaler(train)
    a, b = scale(train), scale(test)
    if c.model == "fixed":
        if len(c.weights) != len(used) + 1:
            raise ValueError(f"{len(used)} columns and an intercept take {len(used) + 1} weights")
        w = np.array(c.weights)
    elif c.model == "vsn":
        return network.fit(a, y, **dict(c.params)).predict(b)
    else:
        w = logistic(a, y, c.C, {"l1": 1.0, "l2": 0.0, "elastic": c.l1_ratio}[c.model])
    return sigmoid(b @ w[:-1] + w[-1])


# ---- all folds -------------------------------------------------------------------------------------------------------

_OUT = T.StructType([
    T.StructField(name, kind())
    for name, kind in (
        ("instrument", T.StringType), ("split_id", T.IntegerType), ("block_id", T.IntegerType), ("date", T.DateType), ("candidate", T.StringType), ("part", T.StringType), ("y_true", T.IntegerType), ("signed_touch_return", T.DoubleType), ("y_proba", T.DoubleType),
    )
])


def _scores(part: pd.DataFrame, cols: list[str], candidates: list[Candidate], parts: tuple[str, ...]) -> pd.DataFrame:
    part = part.sort_values("date", kind="stable")
    train = part[part["role"] == "train"]
    x, y = train[cols].to_numpy(float), train["y_true"].to_numpy(int)
    x = np.where(np.isfinite(x), x, np.nan)
    out = []
    if len(np.unique(y)) == 2:
        for name in parts:
            rows = part[part["role"] == name]
            t = rows[cols].to_numpy(float)
            for c in candidates if len(rows) else ():
                p = fold_scores(x, np.where(np.isfinite(t), t, np.nan), y, cols, c)
                out.append(rows[["instrument", "split_id", "block_id", "date", "y_true", "signed_touch_return"]].assign(candidate=c.candidate, part=name, y_proba=p))
    if not out:
        return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in _OUT})
    return pd.concat(out)[[f.name for f in _OUT]].astype({"split_id": "int32", "block_id": "int32", "y_true": "int32", "y_proba": float, "signed_touch_return": float})


def run(events: DataFrame, splits: DataFrame, cols: list[str], candidates: list[Candidate]) -> DataFrame:
    """Out-of-fold scores of every candidate: instrument, split_id, block_id, date, candidate, y_true, signed_touch_return, y_proba.

    ``events`` has the columns, y_true and signed_touch_return; ``splits`` is one row for each event, split and role. A task has one
    instrument's rows of one split, a few thousand, and fits all candidates on them, so rows move once whatever their number. Splits with one class
    among their training rows are left out. Infinite values are missing.
    """
    rows = splits.select("instrument", "split_id", "block_id", "date", "role").join(events.select("instrument", "date", "y_true", "signed_touch_return", *cols), ["instrument", "date"])
    out = rows.groupBy("instrument", "split_id").applyInPandas(lambda part: _scores(part, cols, candidates, ("test",)), _OUT)
    return out.drop("part")


def refit(events: DataFrame, cut: str, cols: list[str], candidates: list[Candidate]) -> DataFrame:
    """Scores of candidates fitted on all events before ``cut``: of these (part "train") and of the later ones ("test"), by instrument."""
    role = F.when(F.col("date") < F.lit(cut).cast("date"), "train").otherwise("test")
    rows = events.select("instrument", "date", "y_true", "signed_touch_return", *cols).withColumns({"role": role, "split_id": F.lit(0), "block_id": F.lit(0)})
    out = rows.groupBy("instrument").applyInPandas(lambda part: _scores(part, cols, candidates, ("train", "test")), _OUT)
    return out.drop("split_id", "block_id")


def summary(oof: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row for each instrument and candidate: its AUC over folds, and the Sharpe ratios of its stitched paths."""
    oof = oof.withColumn("y_pred", (F.col("y_proba") >= threshold).cast("int"))
    keys = ["instrument", "candidate"]
    folds = metrics.binary_metrics(oof, [*keys, "split_id"], p="y_proba", threshold=threshold)
    stats = metrics.candidate_summary(folds, keys)
    named = F.concat_ws("\0", *keys)
    paths = path_sharpes(stitch(oof.withColumn("instrument", named)))
    quartile = lambda q: F.percentile("path_trade_sharpe", q)
    paths = paths.groupBy("instrument").agg(
        quartile(0.5).alias("median_path_trade_sharpe"), F.avg("path_trade_sharpe").alias("mean_path_trade_sharpe"), (quartile(0.75) - quartile(0.25)).alias("path_sharpe_iqr"), F.count("path_trade_sharpe").alias("n_cpcv_paths"),
    )
    parts = F.split("instrument", "\0")
    return stats.join(paths.withColumns({"candidate": parts[1], "instrument": parts[0]}), keys)


def stage_summary(folds: DataFrame, by: list[str], measures: list[str], digits: int = 4) -> DataFrame:
    """Mean and deviation of each measure over folds, rounded."""
    return folds.groupBy(*by).agg(*[F.round(f(m), digits).alias(f"{m}_{k}") for m in measures for k, f in (("mean", F.avg), ("std", F.stddev_samp))])


def best_of(folds: DataFrame, by: str, measure: str) -> DataFrame:
    """The key of the best mean measure, the smallest of equals, as one row: ``by`` and the mean."""
    means = folds.groupBy(by).agg(F.avg(measure).alias("mean"))
    return means.where(F.col("mean").isNotNull()).agg(F.min(F.struct((-F.col("mean")).alias("m"), by)).alias("b")).select(f"b.{by}", (-F.col("b.m")).alias("mean"))


def permutation_importance(events: DataFrame, cut: str, cols: list[str], candidate: Candidate, repeats: int = 10) -> DataFrame:
    """instrument, feature, baseline, mean and deviation of the AUC with the feature's later values dealt anew, and importance, their difference.

    One task an instrument fits the candidate once and scores all columns and repeats; draws come from a fixed seed. One class: null.
    """
    schema = "instrument string, feature string, baseline_score double, mean_permuted_score double, std_permuted_score double, importance double"

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date", kind="stable")
        early = (pd.to_datetime(part["date"]) < pd.Timestamp(cut)).to_numpy()
        x, y = part[cols].to_numpy(float), part["y_true"].to_numpy(int)
        x = np.where(np.isfinite(x), x, np.nan)
        rows = []
        if len(np.unique(y[early])) == 2:
            def auc(t):
                p, late = fold_scores(x[early], t, y[early], cols, candidate), y[~early]
                n1, n0 = (late == 1).sum(), (late == 0).sum()
                return (ranks(p)[late == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else np.nan

            base, rng = auc(x[~early]), np.random.default_rng(42)
            for i, c in enumerate(cols):
                got = []
                for _ in range(repeats):
                    t = x[~early].copy()
                    t[:, i] = rng.permutation(t[:, i])
                    got.append(auc(t))
                rows.append((part["instrument"].iloc[0], c, base, np.mean(got), np.std(got, ddof=1) if repeats > 1 else 0.0, base - np.mean(got)))
        return pd.DataFrame(rows, columns=["instrument", "feature", "baseline_score", "mean_permuted_score", "std_permuted_score", "importance"])

    out = events.select("instrument", "date", "y_true", *cols).groupBy("instrument").applyInPandas(one, schema)
    return out.na.replace(float("nan"), None)


def rank_candidates(summary_: DataFrame) -> DataFrame:
    """Place of each candidate of an instrument by mean AUC."""
    w = Window.partitionBy("instrument").orderBy(F.desc_nulls_last("mean_auc"), F.asc_nulls_last("std_auc"), "candidate")
    return summary_.withColumn("auc_rank", F.row_number().over(w))
