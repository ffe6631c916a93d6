"""Estimators over cross-validation splits and the small-data heads, as pyspark.ml pipelines and grouped functions."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import exact_quantiles
from ..functions.windows import lag, lead, safe_div
from .allocation import MAX_GROSS, MAX_WEIGHT, TARGET_VOL, annual_vol, cap, gross_capped
from .selection import clusters, long_form, pair_correlations, profile, representatives, target_correlations


def estimator(kind: str, n_features: int, n_rows: int, **params):
    """A classifier by name: logistic (l1, l2, elastic), forest, extra_trees (a forest), boosting, network."""
    if kind in ("l1", "l2", "elastic"):
        mixing = {"l1": 1.0, "l2": 0.0, "elastic": params.get("l1_ratio", 0.5)}[kind]
        return LogisticRegression(regParam=1.0 / (params.get("C", 1.0) * max(1, n_rows)), elasticNetParam=mixing, weightCol="_w", standardization=False, maxIter=50)
    if kind in ("forest", "extra_trees"):
        return RandomForestClassifier(numTrees=params.get("n_estimators", 50), maxDepth=params.get("max_depth", 5), minInstancesPerNode=params.get("min_samples_leaf", 5), weightCol="_w", seed=42)
    if kind == "boosting":
        return GBTClassifier(maxIter=params.get("n_estimators", 20), maxDepth=params.get("max_depth", 3), weightCol="_w", seed=42)
    if kind == "network":
        return MultilayerPerceptronClassifier(layers=[n_features, params.get("hidden", 8), 2], seed=42, maxIter=50)
    raise ValueError(f"unknown model {kind!r}")


def prepared(train: DataFrame, cols: list[str], clip: bool = True) -> dict:
    """Medians and 1% and 99% quantiles of the training rows: three rows a column to the driver. Columns without values have zeros."""
    found = exact_quantiles(long_form(train, cols), ["feature"], "value", [0.5, 0.01, 0.99]).collect()
    at = {(r["feature"], r["share"]): r["quantile"] for r in found}
    return {c: tuple(at.get((c, q), 0.0) for q in (0.5, 0.01, 0.99)) for c in cols}


def filled(df: DataFrame, bounds: dict) -> DataFrame:
    """Missing values take the training median, others are clipped to the training quantiles and to 1e6 in size."""
    edge = lambda x: max(-1e6, min(1e6, float(x)))
    return df.withColumns({c: F.greatest(F.lit(edge(lo)), F.least(F.lit(edge(hi)), F.coalesce(F.col(c).cast("double"), F.lit(edge(m))))) for c, (m, lo, hi) in bounds.items()})


def balanced(train: DataFrame, y: str = "label") -> DataFrame:
    """Weights that make both classes count alike."""
    n = {r[y]: r["count"] for r in train.groupBy(y).count().collect()}
    total = sum(n.values())
    return train.withColumn("_w", F.when(F.col(y) == 1, total / (2.0 * max(1, n.get(1, 0)))).otherwise(total / (2.0 * max(1, n.get(0, 0)))))


def fold_features(
    train: DataFrame, test: DataFrame, cols: list[str], method: str = "none", protected: tuple = (), share: float = 0.95, clip: bool = True, least: float = 0.9, policy: str = "target", y: str = "label",
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both parts of a fold with the features of a method fitted on ``train``, and their names: none, corr_cluster, pca or cluster_pca.

    ``protected`` columns pass. Clusters keep one column each. Components take the place of their columns: clipped to the training
    quantiles and 1e6 if ``clip``, columns of a deviation up to 1e-8 left out, missing values the median, standardised.
    """
    if method not in ("none", "corr_cluster", "pca", "cluster_pca"):
        raise ValueError(f"unknown method {method!r}")
    fixed, free = [c for c in cols if c in protected], [c for c in cols if c not in protected]
    if method in ("corr_cluster", "cluster_pca"):
        grouped = clusters(pair_correlations(train, free), free, least)
        chosen = {r["representative"] for r in representatives(grouped, profile(train, free), target_correlations(train, free, y), policy).collect()}
        free = [c for c in free if c in chosen]
    if method in ("pca", "cluster_pca"):
        q = prepared(train, free)
        edge = lambda c: F.greatest(F.lit(max(q[c][1], -1e6)), F.least(F.lit(min(q[c][2], 1e6)), F.col(c).cast("double")))
        raw = {c: F.when(F.col(c).isNotNull(), edge(c)) if clip else F.col(c).cast("double") for c in free}
        sd = train.agg(*[F.stddev_samp(raw[c]).alias(c) for c in free]).first()
        gone = [c for c in free if not (sd[c] or 0.0) > 1e-8]
        free, old = [c for c in free if c not in gone], free
        if not free:
            raise ValueError("no column varies in this fold")
        full = {c: F.coalesce(raw[c], F.lit(float(q[c][0]))) for c in free}
        at = train.agg(*[F.struct(F.avg(full[c]), F.stddev_pop(full[c])).alias(c) for c in free]).first()
        scaled = lambda df: VectorAssembler(inputCols=[f"_fold_{c}" for c in free], outputCol="_fold_vector").transform(df.withColumns({f"_fold_{c}": (full[c] - at[c][0]) / at[c][1] for c in free}))
        model = PCA(k=len(free), inputCol="_fold_vector", outputCol="_fold_scores").fit(scaled(train))
        k = min(len(free), int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share)) + 1)
        names = [f"pca_{i + 1:03d}" for i in range(k)]
        parts = lambda df: model.transform(scaled(df)).withColumns({n: vector_to_array("_fold_scores")[i] for i, n in enumerate(names)}).drop("_fold_scores", "_fold_vector", *[f"_fold_{c}" for c in free], *old)
        return parts(train), parts(test), [*fixed, *names]
    drop = [c for c in cols if c not in fixed and c not in free]
    return train.drop(*drop), test.drop(*drop), [c for c in cols if c not in drop]


def fit_predict(train: DataFrame, test: DataFrame, cols: list[str], kind: str, **params) -> tuple[DataFrame, object]:
    """``test`` with y_proba, from a model of ``train`` (both with a label column). Training rows are kept while the model is fitted: it reads them again and again."""
    train = train.persist()
    bounds = prepared(train, cols)
    rows = balanced(filled(train, bounds)).withColumn("label", F.col("label").cast("double"))
    stages = [VectorAssembler(inputCols=cols, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), estimator(kind, len(cols), train.count(), **params)]
    model = Pipeline(stages=stages).fit(rows)
    train.unpersist()
    out = model.transform(filled(test, bounds)).withColumn("y_proba", vector_to_array("probability")[1])
    return out.drop("_raw", "features", "rawPrediction", "probability", "prediction"), model


def importance(model, cols: list[str], spark) -> DataFrame:
    """Absolute standardised coefficients, or impurity decreases, by feature."""
    last = model.stages[-1]
    values = np.abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, values, strict=True)], "feature string, importance double")


def cluster_importance(scores: DataFrame, grouped: DataFrame) -> DataFrame:
    """Importance summed by cluster, with its features."""
    return scores.join(grouped, "feature").groupBy("cluster").agg(F.sum("importance").alias("importance"), F.sort_array(F.collect_list("feature")).alias("features"), F.count("*").alias("n_features"))


def grid_search(train: DataFrame, cols: list[str], kind: str, grid: dict[str, list], folds: int = 3, seed: int = 42) -> tuple[dict, object, list[tuple[dict, float]]]:
    """The parameters of the best mean AUC over stratified folds, the pipeline fitted with them on all of ``train``, and every combination's mean AUC.

    Rows are dealt to folds within each class by the order of a hash of instrument and date. Spark's cross-validation fits the combinations, two at a time.
    ``grid``: values of the estimator's own parameters by name, as ``{"regParam": [0.1, 1.0]}``.
    """
    w = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "instrument", "date"), "instrument", "date")
    rows = balanced(filled(train, prepared(train, cols))).withColumns({"label": F.col("label").cast("double"), "_fold": ((F.row_number().over(w) - 1) % folds).cast("int")})
    model = estimator(kind, len(cols), train.count())
    builder = ParamGridBuilder()
    for k, values in grid.items():
        builder = builder.addGrid(model.getParam(k), values)
    maps = builder.build()
    line = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), model])
    search = CrossValidator(estimator=line, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(), numFolds=folds, foldCol="_fold", parallelism=2)
    found = search.fit(rows)
    named = [({p.name: v for p, v in m.items()}, float(a)) for m, a in zip(maps, found.avgMetrics, strict=True)]
    return max(named, key=lambda x: x[1])[0], found.bestModel, named


def save_bundle(model, path: str, **about) -> None:
    """A fitted pipeline and what there is to know of it, as JSON, under one path of any store."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_bundle(path: str):
    """The pipeline and the facts that ``save_bundle`` wrote."""
    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.active().read.text(f"{path}/about").first()[0])


def head_dataset(predictions: DataFrame, features: DataFrame, bars: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of a head: predictions with their primary_signal (none: 0), the features, next_return, the volatility, and the probability's edge, confidence and gate.

    Only rows with a positive volatility; a last bar's next_return is null.
    """
    ret = safe_div("close", lag("close")) - 1
    nxt = bars.select("date", "instrument", ret.alias("_ret")).select("date", "instrument", lead("_ret").alias("next_return"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    rows = predictions.select("date", "instrument", F.coalesce("primary_signal", F.lit(0)).cast("int").alias("primary_signal"), p.alias("prediction"))
    rows = rows.join(features, ["date", "instrument"], "left").join(nxt, ["date", "instrument"], "left").join(annual_vol(bars), ["date", "instrument"], "left")
    edge = F.col("prediction") - threshold
    rows = rows.withColumns({"probability_edge": edge, "probability_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), edge / (1.0 - threshold))), "probability_gate": (F.col("prediction") > threshold).cast("double")})
    return rows.where("annualized_ewma_vol > 0")


def _capped(raw: np.ndarray, day: np.ndarray, cap: float, gross: float) -> np.ndarray:
    """Weights clipped by row, then scaled down by date where they add up to more than ``gross``."""
    w = np.clip(raw, -cap, cap)
    total = np.bincount(day, np.abs(w))
    return w * np.where(total > gross, gross / np.where(total > 0, total, 1), 1.0)[day]


def _head_parts(part: pd.DataFrame, cols: list[str], target_vol: float) -> tuple[np.ndarray, ...]:
    """Features (infinite ones are missing), dates from 0 and what a strength of 1 weighs: side x gate x target volatility / volatility."""
    x = part[cols].to_numpy(float)
    scale = part["primary_signal"].to_numpy(float) * part["probability_gate"].to_numpy(float) * target_vol / part["annualized_ewma_vol"].to_numpy(float)
    return np.where(np.isfinite(x), x, np.nan), pd.factorize(part["date"])[0], scale


def _annual_sharpe(pnl: np.ndarray) -> float:
    sd = pnl.std(ddof=1) if len(pnl) > 1 else 0.0
    return pnl.mean() / sd * 252**0.5 if sd > 0 else np.nan


def train_head(
    rows: DataFrame, cols: list[str], epochs: int = 800, patience: int = 75, rate: float = 0.02, l2: float = 5e-4, exposure: float = 0.10, turnover: float = 0.02,
    cap: float = 0.25, gross: float = 1.0, target_vol: float = 0.10, held: float = 0.25, seed: int = 42,
) -> DataFrame:
    """The parameters of a head that raise the Sharpe ratio of row profits: feature, weight, mean, std; and a ``bias:`` row an instrument.

    weight = side x gate x tanh(x b + bias of the instrument)^2 x target_vol / volatility, capped by row and by date. ``rows`` are
    of ``head_dataset``; those without a next_return are left out. The squares of uncapped weights and of their changes within an
    instrument are penalised; the caps are not in the slope, but a row beyond its own cap has none. Missing features take the
    median where the head is fitted, the mean elsewhere. The last ``held`` of dates stop the training. All rows meet in one
    group: a portfolio's loss isn't a sum over rows. They are daily bars of one portfolio.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna(subset=["next_return"]).sort_values(["date", "instrument"])
        dates = np.unique(part["date"].to_numpy())
        n_held = max(1, int(np.ceil(len(dates) * held))) if len(dates) >= 4 else 0
        late = part["date"].isin(dates[len(dates) - n_held :]).to_numpy()
        fit, val = part[~late], part[late]
        names = sorted(fit["instrument"].unique())
        val = val[val["instrument"].isin(names)]
        x, day, scale = _head_parts(fit, cols, target_vol)
        xv, day_v, scale_v = _head_parts(val, cols, target_vol)
        x = pd.DataFrame(x).pipe(lambda d: d.fillna(d.median()).fillna(0.0)).to_numpy()
        mean, sd = x.mean(0), x.std(0)
        sd = np.where(sd > 0, sd, 1.0)
        x, xv = (x - mean) / sd, (np.where(np.isnan(xv), mean, xv) - mean) / sd
        who, who_v = (d["instrument"].map({k: i for i, k in enumerate(names)}).to_numpy(int) for d in (fit, val))
        r, rv = fit["next_return"].to_numpy(float), val["next_return"].to_numpy(float)
        # Neighbours in time of one instrument, each instrument's changes averaged.
        order = np.argsort(who, kind="stable")
        joined = who[order][1:] == who[order][:-1]
        old, new = order[:-1][joined], order[1:][joined]
        share = 1.0 / np.bincount(who[new], minlength=len(names))[who[new]]
        b, bias = np.random.default_rng(seed).normal(0.0, 0.02, len(cols)), np.zeros(len(names))
        best, kept, wait, n = -np.inf, (b.copy(), bias.copy()), 0, len(x)
        for _ in range(epochs):
            t = np.tanh(x @ b + bias[who])
            raw = scale * t * t
            pnl = _capped(raw, day, cap, gross) * r
            mu = pnl.mean()
            spread = np.sqrt(np.mean((pnl - mu) ** 2) + 1e-8)
            slope = 252**0.5 * (1.0 / (n * spread) - mu * (pnl - mu) / (n * spread**3))
            penalty = 2 * exposure * raw / n
            change = 2 * turnover * share * (raw[new] - raw[old])
            penalty[new] += change
            penalty[old] -= change
            dz = (slope * r - penalty) * scale * 2 * t * (1 - t * t) * (np.abs(raw) <= cap)
            b = b + rate * (x.T @ dz - l2 * b)
            bias = bias + rate * (np.bincount(who, dz, len(names)) - l2 * bias)
            tv = np.tanh(xv @ b + bias[who_v])
            score = _annual_sharpe(_capped(scale_v * tv * tv, day_v, cap, gross) * rv) if len(val) else np.nan
            if np.isnan(score):
                score = mu / spread * 252**0.5
            if score > best + 1e-5:
                best, kept, wait = score, (b.copy(), bias.copy()), 0
            else:
                wait += 1
                if wait >= patience:
                    break
        none = [None] * len(names)
        return pd.DataFrame({"feature": [*cols, *[f"bias:{k}" for k in names]], "weight": np.concatenate(kept), "mean": [*mean, *none], "std": [*sd, *none], "validation_sharpe": best})

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "feature string, weight double, mean double, std double, validation_sharpe double")


def head_weights(rows: DataFrame, params: DataFrame, most: float = MAX_WEIGHT, most_gross: float = MAX_GROSS, target_vol: float = TARGET_VOL) -> DataFrame:
    """``rows`` of ``head_dataset`` of the instruments the head knows, with its conviction, strength, raw, capped and final weight."""
    known = {r["feature"]: r for r in params.collect()}  # a row a feature and an instrument
    biases = rows.sparkSession.createDataFrame([(k[5:], r["weight"]) for k, r in known.items() if k.startswith("bias:")], "instrument string, _bias double")
    z = F.col("_bias")
    for k, r in known.items():
        if not k.startswith("bias:"):
            v = F.col(k).cast("double")
            finite = F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
            z = z + r["weight"] * (F.coalesce(finite, F.lit(r["mean"])) - r["mean"]) / r["std"]
    out = rows.join(biases, "instrument").withColumn("neural_conviction", F.tanh(z)).drop("_bias")
    out = out.withColumn("neural_strength", F.pow("neural_conviction", F.lit(2.0)))
    raw = F.col("primary_signal") * F.col("probability_gate") * F.col("neural_strength") * target_vol / F.col("annualized_ewma_vol")
    return gross_capped(out.withColumn("raw_weight", raw).withColumn("capped_weight", cap(F.col("raw_weight"), most)), most=most_gross)
