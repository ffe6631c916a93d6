"""Candidates over splits, their fold-local features, networks and selections, against brute force."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barforge.operators import candidates as cd
from barforge.operators import cpcv, metrics, models, network, selection

RNG = np.random.default_rng(11)


def panel(spark, n=120, cols=("a", "b", "c")):
    """Events of two instruments whose label leans on the first column."""
    rng = np.random.default_rng(2)
    rows = []
    for k in "XY":
        x = rng.normal(size=(n, len(cols)))
        y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
        for i in range(n):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
            rows.append((k, day, day + dt.timedelta(days=3), int(y[i]), float(y[i] - 0.5), *[None if i % 17 == j else float(x[i, j]) for j in range(len(cols))]))
    return spark.createDataFrame(rows, "instrument string, date date, timeout_date date, y_true int, signed_touch_return double, " + ", ".join(f"{c} double" for c in cols))


def test_logistic_meets_its_optimality_conditions():
    x = RNG.normal(size=(150, 4))
    y = (x[:, 0] - x[:, 1] + RNG.normal(size=150) > 0.4).astype(int)
    s = np.where(y == 1, 75 / (y == 1).sum(), 75 / (y == 0).sum())
    a = np.column_stack([x, np.ones(150)])
    for C, l1 in ((1.0, 0.0), (0.05, 1.0), (0.1, 0.5)):
        w = cd.logistic(x, y, C, l1)
        g = C * (a.T @ (s * (cd.sigmoid(a @ w) - y)))
        assert abs(g[-1]) < 1e-6
        for j in range(4):
            slope = g[j] + (1 - l1) * w[j]
            assert abs(slope + l1 * np.sign(w[j])) < 1e-6 if w[j] else abs(slope) <= l1 + 1e-6


def test_logistic_equals_spark(spark):
    x = RNG.normal(size=(200, 2))
    y = (x[:, 0] + RNG.normal(size=200) > 0).astype(int)
    rows = spark.createDataFrame([("X", i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(200)], "instrument string, date int, label int, a double, b double")
    test = rows.where("date % 5 = 0")
    got = {r["date"]: r["y_proba"] for r in models.fit_predict(rows, test, ["a", "b"], "l2", C=0.5)[0].collect()}
    c = cd.Candidate("x", "l2", C=0.5)
    want = cd.fold_scores(x, x[::5], y, ["a", "b"], c)
    np.testing.assert_allclose([got[i] for i in range(0, 200, 5)], want, atol=5e-3)  # sample and population deviations differ a little


def test_network_slopes_and_learning():
    net, x, y = network.Network(3, 5, 4, 1), RNG.normal(size=(6, 3)), np.array([0, 1, 1, 0, 1, 0])
    z, known = net.forward(x)
    slopes = net.backward(network.loss(z, y, 1.7)[1], known)
    for k, p in net.p.items():
        for i in itertools.islice(np.ndindex(p.shape), 12):
            old, ends = p[i], []
            for step in (1e-6, -1e-6):
                p[i] = old + step
                ends.append(network.loss(net.forward(x)[0], y, 1.7)[0])
            p[i] = old
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(slopes[k][i], abs=1e-7)
    x = RNG.normal(size=(400, 4))
    y = (x[:, 2] > 0).astype(int)
    net = network.fit(x, y, epochs=30)
    assert ((net.predict(x) > 0.5) == y).mean() > 0.85 and net.gates(x).argmax() == 2 and net.gates(x).sum() == pytest.approx(1)
    np.testing.assert_array_equal(net.predict(x), network.fit(x, y, epochs=30).predict(x))


def test_average_linkage_and_information():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0.0]])
    assert cd.average_linkage(d, 1) == [[0, 1], [2], [3]] and cd.average_linkage(d, 5) == [[0, 1], [2, 3]] and cd.average_linkage(d, 9) == [[0, 1, 2, 3]]
    chain = np.abs(np.subtract.outer([0, 1, 2.4], [0, 1, 2.4]))
    assert cd.average_linkage(chain, 1.5) == [[0, 1], [2]]  # 1.9 away on average, though 1.4 from the nearest
    y = np.arange(1000) % 2
    assert cd.mutual_information(y + 0.1 * RNG.normal(size=1000), y, 2) == pytest.approx(np.log(2), rel=0.02)
    assert cd.mutual_information(RNG.normal(size=1000), y) < 0.02 and cd.mutual_information(np.full(9, np.nan), y[:9]) == 0.0


def test_fold_methods_are_fitted_on_the_training_rows():
    x = RNG.normal(size=(200, 4))
    x[:, 1] = 2 * x[:, 0]
    x[5, 2] = np.nan
    y = (x[:, 0] > 0).astype(int)
    names = ["a", "b", "c", "d"]
    for method, want in (("none", names), ("corr_cluster", ["b", "c", "d"]), ("linkage", ["b", "c", "d"])):
        assert cd.fold_features(x[:150], x[150:], y[:150], names, cd.Candidate("x", method=method))[2] == want
    a, b, used = cd.fold_features(x[:150], x[150:], y[:150], names, cd.Candidate("x", method="pca", share=0.999, protected=("d",)))
    assert used == ["d", "pca_001", "pca_002"] and a.shape == (150, 3) and b.shape == (50, 3)
    np.testing.assert_allclose(a[:, 1:].mean(0), 0, atol=1e-9)
    assert abs(np.corrcoef(a[:, 1], a[:, 2])[0, 1]) < 1e-9
    far = x.copy()
    far[150:] *= 100
    np.testing.assert_allclose(cd.fold_features(far[:150], far[150:], y[:150], names, cd.Candidate("x", method="pca"))[0], cd.fold_features(x[:150], x[150:], y[:150], names, cd.Candidate("x", method="pca"))[0])
    for bad in (cd.Candidate("x", method="other"), cd.Candidate("x", model="other"), cd.Candidate("x", "fixed", weights=(1.0,))):
        with pytest.raises(ValueError):
            cd.fold_scores(x[:150], x[150:], y[:150], names, bad)
    with pytest.raises(ValueError):
        cd.fold_features(np.ones((50, 2)), np.ones((5, 2)), y[:50], ["a", "b"], cd.Candidate("x", method="pca"))


def test_runs_over_splits_equal_plain_folds(spark):
    events = panel(spark)
    splits = cpcv.splits_by_rows(events, n=4, k=2, embargo=2)
    every = [cd.Candidate("l2"), cd.Candidate("l1", "l1", C=0.2), cd.Candidate("pca", "elastic", "pca"), cd.Candidate("fixed", "fixed", weights=(1.0, 0.0, -0.5, 0.1)), cd.Candidate("vsn", "vsn", params=(("epochs", 2),))]
    oof = cd.run(events, splits, ["a", "b", "c"], every)
    got = oof.toPandas()
    e, s = events.toPandas(), splits.toPandas()
    for (k, split), part in s.groupby(["instrument", "split_id"]):
        rows = part.merge(e, on=["instrument", "date"]).sort_values("date")
        train, test = rows[rows["role"] == "train"], rows[rows["role"] == "test"]
        for c in every:
            want = cd.fold_scores(train[["a", "b", "c"]].to_numpy(float), test[["a", "b", "c"]].to_numpy(float), train["y_true"].to_numpy(int), ["a", "b", "c"], c)
            mine = got[(got["instrument"] == k) & (got["split_id"] == split) & (got["candidate"] == c.candidate)].sort_values("date")
            np.testing.assert_allclose(mine["y_proba"], want)
    table = cd.rank_candidates(cd.summary(oof)).toPandas()
    assert len(table) == 10 and (table["n_folds"] == 6).all() and (table["n_cpcv_paths"] == 3).all() and sorted(table["auc_rank"]) == sorted([1, 2, 3, 4, 5] * 2)
    one = got[(got["instrument"] == "X") & (got["candidate"] == "l2")]
    aucs = []
    for _, p in one.groupby("split_id"):
        pos, neg = p.loc[p["y_true"] == 1, "y_proba"].to_numpy(), p.loc[p["y_true"] == 0, "y_proba"].to_numpy()
        aucs.append(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
    row = table[(table["instrument"] == "X") & (table["candidate"] == "l2")].iloc[0]
    assert row["mean_auc"] == pytest.approx(np.mean(aucs)) and row["std_auc"] == pytest.approx(np.std(aucs, ddof=1))


def test_splits_with_one_class_are_left_out(spark):
    events = panel(spark).withColumn("y_true", F.when(F.col("instrument") == "X", 1).otherwise(F.col("y_true")))
    oof = cd.run(events, cpcv.splits_by_rows(events, n=4, k=2, embargo=2), ["a", "b", "c"], [cd.Candidate("l2")])
    assert {r[0] for r in oof.select("instrument").distinct().collect()} == {"Y"}
    both = cd.refit(events, "2020-03-15", ["a", "b", "c"], [cd.Candidate("l2")])
    assert {tuple(r) for r in both.select("instrument", "part").distinct().collect()} == {("Y", "train"), ("Y", "test")}


def test_permutation_importance_finds_the_column(spark):
    got = {(r["instrument"], r["feature"]): r for r in cd.permutation_importance(panel(spark), "2020-03-15", ["a", "b", "c"], cd.Candidate("l2"), 4).collect()}
    assert len(got) == 6 and all(got[k, "a"]["importance"] > got[k, "b"]["importance"] for k in "XY")
    assert got["X", "a"]["importance"] == pytest.approx(got["X", "a"]["baseline_score"] - got["X", "a"]["mean_permuted_score"])


#: The best rows of each ticker in the published comparison of models, to six digits, in their order: mean, deviation and median of the AUC,
#: median and interquartile range of the path Sharpe ratios (fixed values).
COMPARISON = {
    "cl1s": [
        ("forest parkinson corr_cluster shallow", 0.64308, 0.192026, 0.666888, 0.421916, 0.015622), ("forest garman_klass corr_cluster shallow", 0.64308, 0.192026, 0.666888, 0.420381, 0.015978), ("forest parkinson corr_cluster medium", 0.635559, 0.190991, 0.677468, 0.422354, 0.013313),
        ("forest garman_klass corr_cluster medium", 0.635559, 0.190991, 0.677468, 0.419849, 0.014945), ("logistic garman_klass none l1_C0.1", 0.629006, 0.114784, 0.63483, 0.489676, 0.060798),
    ],
    "ho1s": [
        ("logistic garman_klass pca l2_C0.1", 0.736165, 0.159956, 0.75, 0.631422, 0.169486), ("logistic garman_klass corr_cluster l2_C1", 0.728295, 0.162535, 0.733333, 0.55604, 0.112878), ("logistic garman_klass corr_cluster l2_C0.1", 0.726719, 0.15447, 0.75, 0.541245, 0.118433),
        ("logistic garman_klass pca l2_C1", 0.716311, 0.164492, 0.703704, 0.625645, 0.182765),
    ],
    "ng1s": [
        ("logistic garman_klass corr_cluster l1_C1", 0.619671, 0.199402, 0.66807, 0.328293, 0.09842), ("logistic parkinson corr_cluster l1_C1", 0.619671, 0.199402, 0.66807, 0.328038, 0.092174), ("logistic garman_klass pca l2_C1", 0.604495, 0.18018, 0.593651, 0.319655, 0.405498),
        ("logistic garman_klass none l1_C1", 0.602808, 0.197779, 0.589105, 0.327081, 0.144657),
    ],
    "rb1s": [
        ("logistic garman_klass pca l2_C0.1", 0.55184, 0.08623, 0.572871, 0.050307, 0.038364), ("logistic garman_klass pca elastic_C0.1", 0.549664, 0.087317, 0.571509, 0.036851, 0.036525), ("logistic garman_klass pca elastic_C1", 0.547681, 0.086309, 0.568848, 0.045778, 0.025034),
        ("logistic garman_klass pca l2_C1", 0.547411, 0.086651, 0.571085, 0.047533, 0.022164), ("logistic garman_klass pca l1_C1", 0.547184, 0.086001, 0.565722, 0.052059, 0.025384),
    ],
}


def test_top_three_then_sharpe_on_published_rows(spark):
    """The best path Sharpe ratio among the three best by AUC, equal ones in their order, is the published choice of each ticker."""
    rows = [(t, i, *r) for t, part in COMPARISON.items() for i, r in enumerate(part)]
    df = spark.createDataFrame(rows, "ticker string, place int, candidate string, mean_auc double, std_auc double, median_auc double, median_path_trade_sharpe double, path_sharpe_iqr double").repartition(4)
    got = {r["ticker"]: (r["candidate"], r["auc_rank"]) for r in metrics.top3_then_sharpe(df, tie="place").collect()}
    assert got == {"cl1s": ("forest parkinson corr_cluster medium", 3), "ho1s": ("logistic garman_klass pca l2_C0.1", 1), "ng1s": ("logistic garman_klass corr_cluster l1_C1", 1), "rb1s": ("logistic garman_klass pca l2_C0.1", 1)}


def test_grid_search_and_bundle(spark, tmp_path):
    x = RNG.normal(size=(240, 2))
    y = (x[:, 0] + 0.5 * RNG.normal(size=240) > 0).astype(int)
    rows = spark.createDataFrame([("X", i, int(y[i]), float(x[i, 0]), None if i == 3 else float(x[i, 1])) for i in range(240)], "instrument string, date int, label int, a double, b double")
    best, model, table = models.grid_search(rows, ["a", "b"], "l2", {"regParam": [0.01, 100.0]})
    assert best in ({"regParam": 0.01}, {"regParam": 100.0}) and len(table) == 2 and max(a for _, a in table) > 0.9
    models.save_bundle(model, f"{tmp_path}/m", cols=["a", "b"], best=best)
    again, about = models.load_bundle(f"{tmp_path}/m")
    assert about == {"cols": ["a", "b"], "best": best}
    assert again.stages[-1].coefficients == model.stages[-1].coefficients


def test_bootstrap_resamples_each_class(spark):
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.02, 0.03, 80), rng.normal(-0.015, 0.02, 60)
    rows = [("X", i, 1, float(v)) for i, v in enumerate(good)] + [("X", 100 + i, 0, float(v)) for i, v in enumerate(bad)] + [("Z", 1, 1, 0.5), ("Z", 2, 1, None)]
    df = spark.createDataFrame(rows, "instrument string, date int, y_true int, signed_touch_return double")
    got = {r["instrument"]: r for r in metrics.bootstrap_threshold(df, ["instrument"]).collect()}
    means = np.array([(g.mean(), b.mean()) for g, b in ((rng.choice(good, 80), rng.choice(bad, 60)) for _ in range(4000))])
    t = np.clip(-means[:, 1] / (means[:, 0] - means[:, 1]), 0, 1)
    assert got["X"]["samples"] == 2000 and got["Z"]["samples"] == 0 and got["Z"]["median"] is None
    for k, q in (("median", 0.5), ("pct5", 0.05), ("pct95", 0.95)):
        assert got["X"][k] == pytest.approx(np.quantile(t, q), abs=0.02)


def test_metrics_by_bins_equal_plain_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(str(k), int(rng.random() < 0.4), float(np.round(rng.random(), rng.integers(1, 7)))) for k in rng.integers(0, 3, 600)]
    df = spark.createDataFrame(rows, "instrument string, y_true int, prediction double")
    got = {r["instrument"]: r for r in metrics.with_overall(df).collect()}
    data = pd.DataFrame(rows, columns=["k", "y", "p"])
    for name, part in [*data.groupby("k"), ("overall", data)]:
        pos, neg = part.loc[part.y == 1, "p"].to_numpy(), part.loc[part.y == 0, "p"].to_numpy()
        assert got[name]["roc_auc"] == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
        ap = sum((part.p == v).mul(part.y).sum() * part.y[part.p >= v].sum() / (part.p >= v).sum() for v in part.p.unique()) / part.y.sum()
        assert got[name]["average_precision"] == pytest.approx(ap) and got[name]["brier_score"] == pytest.approx(((part.p - part.y) ** 2).mean())
        assert got[name]["tp"] == ((part.p >= 0.5) & (part.y == 1)).sum() and got[name]["n"] == len(part)


def test_exact_quantiles_and_profile(spark):
    from barforge.functions.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 50)] + [("b", 7.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["share"]): r["quantile"] for r in exact_quantiles(df, ["k"], "v", [0.0, 0.01, 0.37, 0.5, 1.0]).collect()}
    a = np.array([v for k, v in rows if k == "a"])
    assert got == {**{("a", q): pytest.approx(np.quantile(a, q)) for q in (0.0, 0.01, 0.37, 0.5, 1.0)}, **{("b", q): 7.0 for q in (0.0, 0.01, 0.37, 0.5, 1.0)}}
    table = {r["feature"]: r for r in selection.profile(spark.createDataFrame([(1.0, None), (2.0, None)], "x double, none double"), ["x", "none"]).collect()}
    assert table["none"]["constant"] and table["none"]["median"] is None and table["none"]["missing_rate"] == 1 and table["x"]["median"] == 1.5


def test_correlations_of_each_kind(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 3)), 1)
    x[:, 1] += x[:, 0]
    rows = [(i, *[None if (i + j) % 13 == 0 else float(v) + 1e6 * (j == 2) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double").repartition(5)
    data = pd.DataFrame(rows, columns=["i", "a", "b", "c"]).set_index("i").astype(float)
    for method in ("pearson", "spearman", "kendall"):
        for r in selection.pair_correlations(df, ["a", "b", "c"], method).collect():
            both = data[[r["a"], r["b"]]].dropna()
            u, v = both.iloc[:, 0].to_numpy(), both.iloc[:, 1].to_numpy()
            if method == "kendall":
                s = np.sign(np.subtract.outer(u, u)), np.sign(np.subtract.outer(v, v))
                want = (s[0] * s[1]).sum() / np.sqrt((s[0] ** 2).sum() * (s[1] ** 2).sum())
            else:
                want = np.corrcoef(cd.ranks(u), cd.ranks(v))[0, 1] if method == "spearman" else np.corrcoef(u, v)[0, 1]
            assert r["n"] == len(both) and r["corr"] == pytest.approx(want, abs=1e-9), method
    with pytest.raises(ValueError):
        selection.pair_correlations(df, ["a", "b"], "other")


def test_cleaner_and_duplicates(spark):
    n = 60
    rows = [(i, float(i), float(i), 3.0, float(-(i**3)), None if i % 3 else 1.0 * i, float((i * 37) % 61), float(i) if i else 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "date int, a double, copy double, k double, rank double, gap double, own double, near double").withColumn("instrument", F.lit("X"))
    cols = ["a", "copy", "k", "rank", "gap", "own", "near"]
    kept, log = selection.clean(df, cols, "date", "instrument")
    assert kept == ["a", "own"] and log == {"copy": "the same as a", "k": "constant", "rank": "ranked like a", "gap": "missing 66.7%", "near": "ranked like a"}
    dup = selection.duplicate_columns(df, cols, "date", "instrument", prefer=("copy",)).collect()
    assert [tuple(r) for r in dup] == [("copy", "a;copy")]
    assert selection.duplicate_columns(df, ["a", "k"], "date").count() == 0


def test_small_column_operations(spark):
    df = spark.createDataFrame([("1.5", "x", 2.0), ("NaN", "7", None)], "hmm_prob_a string, b string, hmm_regime_0 double")
    assert selection.named(df, "hmm_prob_") == ["hmm_prob_a"] and selection.split_protected(df.columns, ("b",), ("hmm_prob_",)) == (["hmm_prob_a", "b"], ["hmm_regime_0"])
    assert [tuple(r) for r in selection.numbers(df, "hmm_prob_a", "b").collect()] == [(1.5, None, 2.0), (None, 7.0, None)]


def test_selections_say_what_they_keep(spark):
    rows = [(i, i % 2, float(i % 2) + 0.01 * i, 2.0 * (i % 2) + 0.02 * i, float((i * 7) % 11), None if i < 30 else 2.0 * (i % 2) + 0.02 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, y int, a double, b double, c double, gap double")
    found = selection.select_by_clusters(df, ["a", "b", "c", "gap"], "y")
    assert len(found.selected) == 2 and "c" in found.selected and len(found.dropped) == 2 and not {*found.selected} & {*found.dropped}
    for policy, kept in (("missing", ["b", "c"]), ("variance", ["b", "c"]), ("name", ["a", "c"])):
        assert selection.select_by_clusters(df, ["a", "b", "c", "gap"], "y", policy=policy).selected == kept
    top = selection.select_top(spark.createDataFrame([("a", 0.1), ("b", 0.4), ("c", 0.1)], "feature string, importance double"), ["a", "b", "c"], 2)
    assert top.selected == ["a", "b"] and top.dropped == ["c"]
