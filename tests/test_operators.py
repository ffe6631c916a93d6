"""Invariants of the operators on small tables."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barforge.functions.ewm import Ewm, ewm_mean_native, with_ewm
from barforge.functions.scalars import logsumexp, normal_cdf, probability_size, sigmoid
from barforge.operators import allocation, cpcv, labels, metrics, models, regimes, selection, signals, technical
from barforge.plans.modelling import COLS, model_rows
from barforge.plans.technical import bars_of


def bars_frame(spark, closes, instrument="X", start="2020-01-01"):
    day = dt.date.fromisoformat(start)
    rows = [(day + dt.timedelta(days=i), instrument, float(c), float(c) * 1.01, float(c) * 0.99, float(c), 10.0, 5.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "date date, instrument string, open double, high double, low double, close double, volume double, open_interest double")


def test_bars_in_pieces_equal_whole_days(spark, sf_dir, monkeypatch):
    from barforge.sources import bars

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    whole = sorted(map(tuple, bars.bars_from_ticks(lines).collect()))
    monkeypatch.setattr(bars, "SPAN", 500)
    assert sorted(map(tuple, bars.bars_from_ticks(lines).collect())) == whole


def test_there_are_108_features(spark, sf_dir):
    out = technical.build_all_features(bars_of(spark, sf_dir).where("instrument = 'A'"))
    assert len(technical.FEATURES) == len(set(technical.FEATURES)) == 108
    assert out.columns == ["date", "instrument", *technical.FEATURES]
    bad = out.agg(F.sum(sum(F.when(F.isnan(c) | (F.abs(c) == math.inf), 1).otherwise(0) for c in technical.FEATURES if dict(out.dtypes)[c] == "double")), F.count("*")).first()
    assert bad[0] == 0 < bad[1]


def test_ewm_equals_pandas(spark):
    x = np.r_[[np.nan], np.random.default_rng(1).normal(size=60)]
    bars = bars_frame(spark, range(1, 62)).withColumn("v", F.element_at(F.array(*[F.lit(None if math.isnan(v) else float(v)) for v in x]), F.dayofyear("date")))
    out = with_ewm(bars, Ewm("m", "v", span=5), Ewm("s", "v", "std", span=20, adjust=True, least=20)).orderBy("date").toPandas()
    s = pd.Series(x)
    np.testing.assert_allclose(out["m"].astype(float), s.ewm(span=5, adjust=False).mean())
    np.testing.assert_allclose(out["s"].astype(float), s.ewm(span=20, min_periods=20).std())
    native = spark.createDataFrame([([1.0, 2.0, 4.0],)], "a array<double>").select(ewm_mean_native(F.col("a"), 0.5)).first()[0]
    assert native == pytest.approx(2.75)


def test_flat_and_zero_bars_give_nulls(spark):
    out = technical.build_all_features(bars_frame(spark, [5] * 40).withColumns({"high": F.col("close"), "low": F.col("close"), "volume": F.lit(0.0)})).orderBy("date").toPandas().iloc[-1]
    assert pd.isna(out["rsi_14d"]) and pd.isna(out["stoch_k_14d"]) and pd.isna(out["mfi_14d"]) and out["mom_sign_5d"] == -1 and out["gk_vol_20d"] == 0


def test_scalars(spark):
    row = spark.range(1).select(normal_cdf(F.lit(1.0)), sigmoid(F.lit(-1000.0)), logsumexp(F.array(F.lit(1000.0), F.lit(1000.0))), *[probability_size(F.lit(0.8), m) for m in ("all_or_nothing", "model_confidence", "ncdf")], probability_size(F.lit(0.5))).first()
    assert row[0] == pytest.approx(0.8413447, abs=1e-6) and 0 <= row[1] < 1e-300 and row[2] == pytest.approx(1000 + math.log(2))
    assert row[3] == 1 and row[4] == 0.8 and row[5] == pytest.approx(0.5 * (1 + math.erf(0.75 / math.sqrt(2))), abs=1e-6) and row[6] == 0
    with pytest.raises(ValueError):
        probability_size(F.lit(0.8), "other")


def test_labels_first_touch_and_edges(spark):
    bars = bars_frame(spark, [100, 103, 90, 120, 100, 100])
    priced = bars.withColumns({"primary_signal": F.when(F.dayofmonth("date") == 1, 1).when(F.dayofmonth("date") == 5, -1), "vol": F.lit(0.01)})
    out = labels.label_events(priced, num_days=3).collect()
    assert len(out) == 1  # the event of the fifth has no three bars after it
    r = out[0]
    assert (r["touched_barrier"], r["triple_barrier_label"], r["metalabel"], str(r["touch_date"])) == ("upper", 1, 1, "2020-01-02")
    exact = labels.label_events(priced.withColumn("vol", F.lit(0.015)), num_days=3).first()
    assert exact["tp"] == pytest.approx(103) and exact["touched_barrier"] in ("upper", "lower")


def test_label_pipeline_rejects_and_accepts(spark):
    bars = bars_frame(spark, 100 + np.sin(np.arange(150)) * 5)
    sig = bars.select("date", "instrument", F.lit(1).alias("primary_signal"))
    with pytest.raises(ValueError):
        labels.label_pipeline(bars, sig, labels.Config("c", "none"))
    with pytest.raises(ValueError):
        labels.label_pipeline(bars, sig, labels.Config("c", "ewma"), columns=["nope"])
    for method in labels.METHODS:
        out = labels.label_pipeline(bars, sig, labels.Config("c", method), "2020-05-20")
        assert out.columns == labels.LABEL_COLUMNS
        row = out.agg(F.count("*"), F.max("timeout_date"), F.max("touch_date"), F.count_if((F.col("metalabel") == 1) != (F.col("signed_touch_return") > 0)), F.count_if(F.col("primary_signal") == 0)).first()
        assert row[0] > 0 and str(row[1]) < "2020-05-20" and str(row[2]) < "2020-05-20" and row[3] == 0 and row[4] == 0


def test_splits_are_safe(spark, sf_dir):
    from barforge.plans.evaluation import events_of

    e = events_of(spark, sf_dir)
    blocks = cpcv.blocks(e).groupBy("instrument", "block_id").count().groupBy("instrument").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in blocks)
    s = cpcv.splits_by_rows(e).cache()
    assert s.groupBy("instrument", "split_id", "pos").count().where("count > 1").count() == 0
    both = s.join(e, ["instrument", "date"])
    test = both.where("role = 'test'").groupBy("instrument", "split_id", "block_id").agg(F.min("date").alias("a"), F.max("timeout_date").alias("b"))
    hit = both.where("role = 'train'").drop("block_id").join(test, ["instrument", "split_id"]).where("date <= b and timeout_date >= a")
    assert hit.count() == 0
    paths = cpcv.path_ids(s.where("role = 'test'"))
    cpcv.validate_paths(paths, 8, 2)
    assert {r[0] for r in paths.groupBy("instrument", "path_id").agg(F.count_distinct("block_id").alias("n")).select("n").collect()} == {8}
    with pytest.raises(ValueError):
        cpcv.validate_paths(paths.where("path_id < 6"), 8, 2)


def test_one_class_and_constant_scores(spark):
    df = spark.createDataFrame([("A", 1, 0.7), ("A", 1, 0.7), ("B", 1, 0.5), ("B", 0, 0.5)], "instrument string, y_true int, prediction double")
    out = {r["instrument"]: r for r in metrics.binary_metrics(df, ["instrument"]).collect()}
    assert out["A"]["roc_auc"] is None and out["A"]["average_precision"] is None and out["B"]["roc_auc"] == 0.5


def test_gross_cap_and_weights(spark):
    df = spark.createDataFrame([("2020-01-01", k, w) for k, w in zip("ABCDE", (0.25, -0.25, 0.25, 0.25, 0.25), strict=True)], "date string, instrument string, capped_weight double")
    out = allocation.gross_capped(df).agg(F.sum(F.abs("weight"))).first()[0]
    assert out == pytest.approx(1.0)


def test_spans_and_behaviour_edges(spark):
    rows = [("2020-01-0%d" % (i + 1), "X", v) for i, v in enumerate([1, 1, None, 1, -1])]
    df = spark.createDataFrame(rows, "date string, instrument string, primary_signal int")
    assert signals.spans(df, "primary_signal").count() == 3
    out = signals.signal_behaviour(df).orderBy("date").collect()
    assert [r["signal_changed"] for r in out] == [0, 0, 1, 1, 1] and [r["days_since_signal_change"] for r in out] == [0, 1, 0, 0, 0]
    with pytest.raises(ValueError):
        signals.validate_unique(df.unionByName(df), "date", "instrument")
    assert signals.validate_unique(df, "date", "instrument") is df


def test_selection(spark):
    df = spark.createDataFrame([(i, float(i), float(2 * i), float(-i), 3.0, None if i % 2 else 1.0) for i in range(40)], "date int, a double, b double, c double, k double, m double").withColumn("instrument", F.lit("X"))
    cols = ["a", "b", "c", "k", "m"]
    corr = selection.pair_correlations(df, cols)
    got = {(r["a"], r["b"]): r["corr"] for r in corr.collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "c"] == pytest.approx(-1) and got["a", "k"] is None
    assert {r["feature"]: r["cluster"] for r in selection.clusters(corr, cols).collect()} == {"a": "a", "b": "a", "c": "a", "k": "k", "m": "m"}
    assert selection.clean(df, cols, "date")[0] == ["a"]
    assert selection.numeric_columns(df, ("date",)) == cols
    with pytest.raises(ValueError):
        selection.representatives(None, None, None, "other")


def test_regimes_are_causal(spark, sf_dir):
    obs = regimes.observations(bars_of(spark, sf_dir)).where("instrument = 'A'")
    full = regimes.filter_fixed(obs).orderBy("date").toPandas()
    cut = regimes.filter_fixed(obs.where("date < '1995-01-01'")).orderBy("date").toPandas()
    np.testing.assert_allclose(full["hmm_regime_prob_0"][: len(cut)], cut["hmm_regime_prob_0"])
    fit = regimes.detect(obs, "1996-12-31").toPandas()
    total = fit[[f"hmm_regime_prob_{k}" for k in range(4)]].sum(axis=1)
    assert len(fit) and np.allclose(total, 1) and fit["hmm_predicted_regime"].between(0, 3).all()


def test_a_model_of_each_kind_learns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(f"d{i:03}", "X", int(y[i]), float(x[i, 0]), None if i % 50 == 0 else float(x[i, 1])) for i in range(300)], "date string, instrument string, label int, a double, b double").cache()
    train, test = rows.where("date < 'd200'"), rows.where("date >= 'd200'")
    for kind in ("l2", "forest"):
        out, model = models.fit_predict(train, test, ["a", "b"], kind)
        auc = metrics.binary_metrics(out.withColumn("y_true", F.col("label")), ["instrument"], p="y_proba").first()["roc_auc"]
        imp = {r["feature"]: r["importance"] for r in models.importance(model, ["a", "b"], spark).collect()}
        assert auc > 0.9 and imp["a"] > imp["b"]
    with pytest.raises(ValueError):
        models.estimator("other", 2, 10)


def test_head_and_upsert(spark, sf_dir):
    assert set(COLS) <= set(model_rows(spark, sf_dir).columns)
    t = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    assert sorted(r["v"] for r in metrics.upsert(t, spark.createDataFrame([("b", 9)], "k string, v int"), "k", "b").collect()) == [1, 3, 9]


def plain_head(d, cols, epochs, patience=75, rate=0.02, l2=5e-4, exposure=0.10, turnover=0.02):
    """The head's training row by row and date by date."""
    d = d.sort_values(["date", "instrument"]).reset_index(drop=True)
    dates = sorted(d["date"].unique())
    late = d["date"].isin(dates[-int(np.ceil(len(dates) / 4)) :])
    fit, val = d[~late].reset_index(drop=True), d[late].reset_index(drop=True)
    x = fit[cols].fillna(fit[cols].median())
    mean, sd = x.mean(), x.std(ddof=0)
    x, xv = ((x - mean) / sd).to_numpy(), ((val[cols].fillna(mean) - mean) / sd).to_numpy()
    names = sorted(fit["instrument"].unique())
    b, a = np.random.default_rng(42).normal(0, 0.02, len(cols)), np.zeros(len(names))
    parts = lambda f: (f["instrument"].map(names.index).to_numpy(), (f["primary_signal"] * f["probability_gate"] * 0.10 / f["annualized_ewma_vol"]).to_numpy(), f["next_return"].to_numpy())

    def caps(w, f):
        w = np.clip(w, -0.25, 0.25)
        for day in f["date"].unique():
            at = (f["date"] == day).to_numpy()
            w[at] *= min(1.0, 1.0 / max(np.abs(w[at]).sum(), 1e-300))
        return w

    (who, scale, r), (who_v, scale_v, rv) = parts(fit), parts(val)
    best, kept, wait = -np.inf, None, 0
    for _ in range(epochs):
        t = np.tanh(x @ b + a[who])
        raw = scale * t**2
        pnl = caps(raw, fit) * r
        spread = np.sqrt(pnl.var() + 1e-8)
        slope = 252**0.5 * (1 / (len(r) * spread) - pnl.mean() * (pnl - pnl.mean()) / (len(r) * spread**3))
        penalty = 2 * exposure * raw / len(raw)
        for k in range(len(names)):
            at = np.flatnonzero(who == k)
            step = np.diff(raw[at])
            for i, s in enumerate(step):
                penalty[at[i + 1]] += 2 * turnover * s / len(step)
                penalty[at[i]] -= 2 * turnover * s / len(step)
        dz = (slope * r - penalty) * scale * 2 * t * (1 - t**2) * (np.abs(raw) <= 0.25)
        b = b + rate * (x.T @ dz - l2 * b)
        a = a + rate * (np.array([dz[who == k].sum() for k in range(len(names))]) - l2 * a)
        p = caps(scale_v * np.tanh(xv @ b + a[who_v]) ** 2, val) * rv
        score = p.mean() / p.std(ddof=1) * 252**0.5
        if score > best + 1e-5:
            best, kept, wait = score, (b, a), 0
        elif (wait := wait + 1) >= patience:
            break
    return {**dict(zip(cols, kept[0], strict=True)), **{f"bias:{k}": v for k, v in zip(names, kept[1], strict=True)}}, best


def test_head_trains_with_gate_volatility_caps_biases_and_penalties(spark):
    rng = np.random.default_rng(5)
    n = 80
    cols = ["f", "g"]
    rows = [(f"d{i:03}", k, int(rng.choice([-1, 0, 1])), float(rng.random() > 0.3), float(rng.uniform(0.005, 0.4)), float(rng.normal(0, 0.02)), None if rng.random() < 0.1 else float(rng.normal()), float(rng.normal())) for i in range(n) for k in "XYZ" if rng.random() > 0.1]
    schema = "date string, instrument string, primary_signal int, probability_gate double, annualized_ewma_vol double, next_return double, f double, g double"
    df = spark.createDataFrame(rows, schema)
    got = models.train_head(df, cols, epochs=300)
    have = {r["feature"]: r for r in got.collect()}
    want, best = plain_head(df.toPandas(), cols, 300)
    assert {k: r["weight"] for k, r in have.items()} == pytest.approx(want, rel=1e-6) and have["f"]["validation_sharpe"] == pytest.approx(best, rel=1e-6)
    out = models.head_weights(df, got).toPandas()
    assert len(out) == len(rows) and (out["weight"].abs() <= 0.25).all() and (out.groupby("date")["weight"].apply(lambda w: w.abs().sum()) <= 1 + 1e-9).all()
    row = out[out["f"].notna() & (out["primary_signal"] != 0) & (out["probability_gate"] > 0)].iloc[0]
    z = sum(have[c]["weight"] * (row[c] - have[c]["mean"]) / have[c]["std"] for c in cols) + have[f"bias:{row['instrument']}"]["weight"]
    assert row["raw_weight"] == pytest.approx(row["primary_signal"] * np.tanh(z) ** 2 * 0.1 / row["annualized_ewma_vol"])


def test_head_dataset_and_feature_choice(spark):
    bars = spark.createDataFrame([(f"2020-01-{i + 1:02}", "X", 100.0 + i % 3) for i in range(30)], "date string, instrument string, close double")
    p = spark.createDataFrame([("2020-01-25", "X", 1, 0.75), ("2020-01-26", "X", None, 0.4), ("2020-01-30", "X", -1, 1.5), ("2020-01-05", "X", 1, 0.9)], "date string, instrument string, primary_signal int, prediction double")
    feats = bars.selectExpr("date", "instrument", "1.0D as b", "if(date < '2020-01-26', null, 2.0D) as c", "1.0D as a")
    rows = {r["date"][-2:]: r for r in models.head_dataset(p, feats, bars).collect()}
    assert set(rows) == {"25", "26", "30"} and rows["26"]["primary_signal"] == 0 and rows["30"]["next_return"] is None
    assert [(r["probability_edge"], r["probability_confidence"], r["probability_gate"]) for r in (rows["25"], rows["30"])] == [(0.25, 0.5, 1.0), (0.5, 1.0, 1.0)] and rows["26"]["probability_gate"] == 0.0
    assert selection.least_missing(models.head_dataset(p, feats, bars), ["c", "b", "a"], 2) == ["a", "b"]


def test_clean_by_instrument_passes_twice(spark):
    rows = [(f"d{i}", k, 1, float(i), 5.0 if k == "X" else float(i % 2), (None if i < 2 else float(i)) if k == "X" else 1.0 * i, (9.0 if i > 1 else 1.0), float(i), "s") for k in "XY" for i in range(6)]
    df = spark.createDataFrame(rows, "date string, instrument string, primary_signal int, a double, flat double, gap double, late double, roc_5d double, text string")
    out = selection.clean_by_instrument(df)
    assert out["X"].columns == ["date", "instrument", "primary_signal", "a", "gap", "text"] and sorted(r["date"] for r in out["X"].collect()) == ["d2", "d3", "d4", "d5"]
    assert out["Y"].columns == ["date", "instrument", "primary_signal", "a", "flat", "gap", "late", "text"] and out["Y"].count() == 6
    assert len(selection.HARD_DROPS) == len(set(selection.HARD_DROPS)) == 46


def test_fold_features_are_fitted_on_the_training_part(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2))
    rows = [(i, int(x[i, 0] > 0), float(x[i, 0]), float(2 * x[i, 0]), None if i == 7 else float(x[i, 1]), 1.0, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, label int, a double, b double, c double, k double, p double")
    train, test = df.where("i < 150"), df.where("i >= 150").withColumn("c", F.col("c") * 100)
    cols = ["a", "b", "c", "k", "p"]
    assert models.fold_features(train, test, cols)[2] == cols
    tr, te, names = models.fold_features(train, test, cols, "corr_cluster", protected=("p",))
    assert names == ["b", "c", "k", "p"] and "a" not in te.columns  # alike but for their variance
    tr, te, names = models.fold_features(train, test, cols, "pca", protected=("p",), share=0.999)
    raw = train.toPandas()[["a", "b", "c"]]
    lo, hi = raw.quantile(0.01), raw.quantile(0.99)
    z = raw.clip(lo, hi, axis=1)
    mid = z.median()
    z = z.fillna(mid)
    mean, sd = z.mean(), z.std(ddof=0)
    values, vectors = np.linalg.eigh(np.cov(((z - mean) / sd).T))
    late = ((test.toPandas()[["a", "b", "c"]].clip(lo, hi, axis=1).fillna(mid) - mean) / sd).to_numpy() @ vectors[:, ::-1]
    assert names == ["p", "pca_001", "pca_002"]
    for k, n in enumerate(names[1:]):
        np.testing.assert_allclose(np.abs(te.orderBy("i").toPandas()[n]), np.abs(late[:, k]), atol=1e-6)
    assert models.fold_features(train, test, cols, "cluster_pca", share=1.0)[2] == ["pca_001", "pca_002", "pca_003"]
    with pytest.raises(ValueError):
        models.fold_features(train, test, cols, "other")
