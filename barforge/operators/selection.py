"""Column profiles, correlations over pairs of columns, correlation clusters, duplicates, cleaning, principal components."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.quantiles import exact_quantiles
from .candidates import average_linkage


def numeric_columns(df: DataFrame, denied=("date", "instrument")) -> list[str]:
    """Numeric columns that aren't on the list."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in denied]


def least_missing(df: DataFrame, cols: list[str], n: int = 20) -> list[str]:
    """The ``n`` columns of the smallest missing shares, by name where these are equal. One row reaches the driver."""
    value = lambda c: F.col(f"`{c}`").cast("double")
    share = df.agg(*[F.count_if(value(c).isNull() | F.isnan(value(c))).alias(c) for c in cols]).first()
    return sorted(cols, key=lambda c: (share[c], c))[:n]


def long_form(df: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    """keys, feature, value: one row for each column, nulls left out."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.selectExpr(*keys, f"stack({len(cols)}, {pairs}) as (feature, value)").where("value is not null")


def named(df: DataFrame, *prefixes: str) -> list[str]:
    """Columns whose names begin with one of the prefixes."""
    return [c for c in df.columns if c.startswith(prefixes)]


def split_protected(cols: list[str], protected: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Columns that a reduction must leave alone, by name or prefix, and the others, each in their order."""
    kept = [c for c in cols if c in protected or (prefixes and c.startswith(prefixes))]
    return kept, [c for c in cols if c not in kept]


def numbers(df: DataFrame, *cols: str) -> DataFrame:
    """The columns as doubles; texts that aren't numbers, and NaN, give null."""
    value = lambda c: F.col(f"`{c}`").cast("string").try_cast("double")
    return df.withColumns({c: F.when(~F.isnan(value(c)), value(c)) for c in cols})


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing share, different values, variance and quartiles of each column; whether it is constant."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) as (feature, value)")
    sums = long.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("int")).alias("missing_rate"), F.var_samp("value").alias("variance"))
    kinds = long.groupBy("feature", "value").count().groupBy("feature").agg(F.count("value").alias("nunique"))
    at = exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75])
    quartile = lambda q, name: F.max(F.when(F.col("share") == q, F.col("quantile"))).alias(name)
    quartiles = at.groupBy("feature").agg(quartile(0.25, "q25"), quartile(0.5, "median"), quartile(0.75, "q75"))
    return sums.join(kinds, "feature").join(quartiles, "feature", "left").withColumn("constant", F.col("nunique") <= 1)


def family(feature: str = "feature"):
    """The family of a technical feature by its name."""
    rules = (("vol", "vol|atr|range"), ("momentum", "^(ret|roc|mom|log_ret)"), ("trend", "sma|ema|macd"), ("oscillator", "rsi|stoch|williams|cci|mfi|^uo"), ("band", "bb_|donchian|zscore"))
    out = None
    for name, pattern in rules:
        test = F.col(feature).rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def missing_by_family(df: DataFrame, cols: list[str]) -> DataFrame:
    p = profile(df, cols)
    return p.withColumn("family", family()).groupBy("family").agg(F.count("*").alias("features"), F.avg("missing_rate").alias("mean_missing_rate"))


#: Where a column comes from, by its name: prefixes and names of the workflow's groups, in the order in which they are tried (fixed values).
RAW_MARKET = ("open", "high", "low", "close", "volume", "open_interest")
TECHNICAL = ("ret_", "roc_", "mom_", "slope", "sma", "ema", "macd", "rsi", "stoch", "williams", "cci", "mfi", "uo", "zscore", "bb_", "donchian", "atr", "vol_")
ENGINEERED_MARKET = ("volume_log_change", "open_interest_log_change", "volume_to_open_interest", "range_pct", "body_pct", "upper_wick_pct", "lower_wick_pct", "close_position_in_bar", "gap_open_pct")


def source_family(feature: Column | str) -> Column:
    """hmm, raw_market, technical, engineered_market, engineered_signal or other."""
    f = F.col(feature) if isinstance(feature, str) else feature
    token = f.rlike("|".join(TECHNICAL))
    rules = ((f.startswith("hmm_") | f.contains("_hmm_"), "hmm"), (f.isin(*RAW_MARKET), "raw_market"), (token, "technical"), (f.isin(*ENGINEERED_MARKET), "engineered_market"), (f.startswith("signal_") | f.startswith("days_since_signal"), "engineered_signal"))
    out = F.when(*rules[0])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out.otherwise("other")


def correlation_bucket(a: Column, b: Column) -> Column:
    """What a high correlation between columns of two families speaks of."""
    either = lambda k: (a == k) | (b == k)
    both = lambda k: (a == k) & (b == k)
    return (
        F.when(either("hmm"), "HMM duplicates/redundancies").when(both("technical"), "TA window variants").when(both("raw_market"), "Raw price-level correlations")
        .when(either("technical") & either("engineered_market"), "Engineered-vs-technical overlaps").otherwise("Other high-correlation pairs")
    )


def bucketed(correlations: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs of an absolute correlation of ``least`` or more with both families and their bucket."""
    out = correlations.where(F.abs("corr") >= least).withColumns({"a_family": source_family("a"), "b_family": source_family("b")})
    return out.withColumn("bucket", correlation_bucket(F.col("a_family"), F.col("b_family")))


def _pearson(df: DataFrame, cols: list[str], least: int) -> DataFrame:
    """Sums over pairs of columns: each task adds up its rows as matrices and gives one row a pair, whatever the number of rows."""
    plain = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    centre = np.array([x or 0.0 for x in plain.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))) for c in plain.columns]).first()])
    at = np.array([(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]).reshape(-1, 2)

    def run(batches):
        d = len(centre)
        total = np.zeros((6, d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre if batch.num_rows else np.zeros((0, d))
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        rows = total[:, at[:, 0], at[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), *map(pa.array, rows)], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    sums = plain.mapInArrow(run, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    s = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    sd = F.sqrt(F.greatest(F.col("n") * F.col("xx") - F.col("x") ** 2, F.lit(0.0))) * F.sqrt(F.greatest(F.col("n") * F.col("yy") - F.col("y") ** 2, F.lit(0.0)))
    # What rounding leaves of a constant's deviation is none.
    flat = (F.col("n") * F.col("xx") - F.col("x") ** 2 <= 1e-13 * F.col("n") * F.col("xx")) | (F.col("n") * F.col("yy") - F.col("y") ** 2 <= 1e-13 * F.col("n") * F.col("yy"))
    corr = F.when((F.col("n") >= least) & ~flat, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(sd, F.lit(0.0)))
    name = lambda i: F.element_at(F.array(*map(F.lit, cols)), F.col(i) + 1)
    return s.where("n > 0").select(name("i").alias("a"), name("j").alias("b"), F.col("n").cast("long").alias("n"), corr.alias("corr"))


def tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's rank correlation with ties, by counting inversions while merging."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    ties = lambda *v: sum(c * (c - 1) / 2 for c in np.unique(np.column_stack(v), axis=0, return_counts=True)[1].tolist())
    n = len(x)
    total, tx, ty, txy = n * (n - 1) / 2, ties(x), ties(y), ties(x, y)
    swaps, width = 0, 1
    y = y.copy()
    while width < n:
        for i in range(0, n - width, 2 * width):
            left, right = y[i : i + width], y[i + width : i + 2 * width]
            swaps += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            y[i : i + 2 * width] = np.sort(y[i : i + 2 * width], kind="stable")
        width *= 2
    scale = ((total - tx) * (total - ty)) ** 0.5
    return (total - tx - ty + txy - 2 * swaps) / scale if scale else float("nan")


def pair_correlations(df: DataFrame, cols: list[str], method: str = "pearson", least: int = 20) -> DataFrame:
    """a, b, n, corr of every pair of columns over the rows that have both; null below ``least`` rows or for a constant. Pairs without common rows are left out.

    Pearson: each task adds up all pairs of its rows, and one row a pair and task is shuffled. Spearman and Kendall rank
    anew for each pair over its own rows, so the pairs are exploded first; a task has one pair's rows.
    """
    if method == "pearson":
        return _pearson(df, cols, least)
    if method not in ("spearman", "kendall"):
        raise ValueError(f"unknown method {method!r}")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = df.select(F.explode(items).alias("p")).select("p.*").where("x is not null and y is not null")
    if method == "kendall":

        def one(part: pd.DataFrame) -> pd.DataFrame:
            tau = tau_b(part["x"].to_numpy(), part["y"].to_numpy()) if len(part) >= least else float("nan")
            return pd.DataFrame({"a": part["a"].iloc[:1], "b": part["b"].iloc[:1], "n": len(part), "corr": tau})

        out = long.groupBy("a", "b").applyInPandas(one, "a string, b string, n long, corr double")
        return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
    rank = lambda v: F.rank().over(Window.partitionBy("a", "b").orderBy(v)) + (F.count("*").over(Window.partitionBy("a", "b", v)) - 1) / 2.0
    long = long.withColumns({"_x": rank("x"), "_y": rank("y")}).select("a", "b", F.col("_x").alias("x"), F.col("_y").alias("y"))
    sd = F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))
    return long.groupBy("a", "b").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.covar_pop("x", "y") / sd).alias("corr"))


def mutual_information(df: DataFrame, cols: list[str], y: str, bins: int = 10) -> DataFrame:
    """feature, n, information: of each column, binned between its quantiles, and a class, in nats; rows that miss either don't count."""
    long = long_form(df, cols, y).where(F.col(y).isNotNull())
    edges = exact_quantiles(long, ["feature"], "value", [i / bins for i in range(1, bins)]).groupBy("feature").agg(F.collect_list("quantile").alias("_e"))
    at = long.join(F.broadcast(edges), "feature")  # a row a column
    counts = at.groupBy("feature", y, F.size(F.filter("_e", lambda e: e < F.col("value"))).alias("bin")).agg(F.count("*").alias("c"))
    over = lambda *by: F.sum("c").over(Window.partitionBy("feature", *by))
    parts = counts.withColumns({"nb": over("bin"), "ny": over(y), "n": over()})
    return parts.groupBy("feature").agg(F.max("n").alias("n"), F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("nb") * F.col("ny")))).alias("information"))


def linkage_selection(df: DataFrame, cols: list[str], y: str, least: float = 0.9, most: int = 50) -> DataFrame:
    """feature, cluster, score, cluster_size: of each group of columns by average linkage over 1 - |correlation|, the one that tells most of ``y``; the ``most`` best.

    Correlations and scores, a row a pair and a column, reach the driver, which joins at most as many groups as there are columns.
    """
    at = {c: i for i, c in enumerate(cols)}
    corr = np.eye(len(cols))
    for r in pair_correlations(df, cols).where("corr is not null").collect():
        corr[at[r["a"]], at[r["b"]]] = corr[at[r["b"]], at[r["a"]]] = min(1.0, abs(r["corr"]))
    score = {r["feature"]: r["information"] for r in mutual_information(df, cols, y).collect()}
    rows = []
    for k, group in enumerate(average_linkage(1 - corr, 1 - least), 1):
        best = min(group, key=lambda i: (-score.get(cols[i], 0.0), i))
        rows.append((cols[best], k, float(score.get(cols[best], 0.0)), len(group)))
    rows.sort(key=lambda r: (-r[2], r[0]))
    return df.sparkSession.createDataFrame(rows[:most], "feature string, cluster int, score double, cluster_size int")


def target_correlations(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Absolute correlation of each column with the target; null below three rows or for a constant."""
    long = long_form(df, cols, target).where(F.col(target).isNotNull())
    y = F.col(target).cast("double")
    sd = F.nullif(F.stddev_pop("value") * F.stddev_pop(y), F.lit(0.0))
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.abs(F.covar_pop("value", y) / sd)).alias("score"))


def clusters(correlations: DataFrame, cols: list[str], least: float = 0.9) -> DataFrame:
    """feature, cluster: groups of columns linked by absolute correlations of ``least`` or more; the smallest name stands for each.

    At most as many nodes as the table has columns, so the driver unites them.
    """
    up = {c: c for c in cols}

    def root(c):
        while up[c] != c:
            c = up[c]
        return c

    for r in correlations.where(F.abs("corr") >= least).select("a", "b").collect():
        a, b = root(r["a"]), root(r["b"])
        up[max(a, b)] = min(a, b)
    return correlations.sparkSession.createDataFrame([(c, root(c)) for c in cols], "feature string, cluster string")


def representatives(grouped: DataFrame, stats: DataFrame, scores: DataFrame, policy: str = "target") -> DataFrame:
    """One column of each cluster: by its target correlation, its missing share, its variance or its name; what a policy leaves equal goes on to the others.

    Measures that agree in twelve digits are equal: sums in another order don't change the choice between copies.
    """
    measure = lambda c: F.round(c, 12).desc_nulls_last()
    full, many, wide = F.col("missing_rate"), F.desc("nunique"), measure("variance")
    order = {"target": [measure("score"), full, many, wide], "missing": [full, many, wide], "variance": [wide, full, many], "name": []}
    if policy not in order:
        raise ValueError(f"unknown policy {policy!r}; known are {sorted(order)}")
    w = Window.partitionBy("cluster").orderBy(*order[policy], "feature")
    all_ = grouped.join(stats.select("feature", "missing_rate", "nunique", "variance"), "feature", "left").join(scores.select("feature", "score"), "feature", "left")
    size = F.count("*").over(Window.partitionBy("cluster"))
    return all_.withColumns({"_k": F.row_number().over(w), "cluster_size": size}).where("_k = 1").select("cluster", F.col("feature").alias("representative"), "cluster_size")


class Selection(NamedTuple):
    """Columns that a selection keeps and drops, in their order, and its report."""

    selected: list[str]
    dropped: list[str]
    report: DataFrame


def select_by_clusters(df: DataFrame, cols: list[str], target: str, least: float = 0.9, policy: str = "target", method: str = "spearman") -> Selection:
    """One column of each correlation cluster stays; the report has cluster, representative and cluster_size."""
    report = representatives(clusters(pair_correlations(df, cols, method), cols, least), profile(df, cols), target_correlations(df, cols, target), policy)
    kept = {r["representative"] for r in report.collect()}
    return Selection([c for c in cols if c in kept], [c for c in cols if c not in kept], report)


def select_top(importances: DataFrame, cols: list[str], k: int = 20) -> Selection:
    """The ``k`` columns of the highest importance, by name where it is equal; the report is their importances."""
    report = importances.orderBy(F.desc("importance"), "feature").limit(k)
    kept = {r["feature"] for r in report.collect()}
    return Selection([c for c in cols if c in kept], [c for c in cols if c not in kept], report)


#: Of columns that hold the same, the one to keep if it is among them, in this order (fixed values).
KEEP_FIRST = ("hmm_prob_stress", "hmm_prob_calm_positive", "hmm_prob_calm_negative", "hmm_prob_upside_breakout", "hmm_regime_missing")


def duplicate_columns(df: DataFrame, cols: list[str], *keys: str, prefer: tuple[str, ...] = KEEP_FIRST) -> DataFrame:
    """kept, features: groups of columns that hold the same values in every row, and which to keep: the first preferred one, else the first by name.

    Sums of row-wise hashes, a map-side combine instead of lists of values, propose groups; a second aggregate counts the rows in
    which a column differs from its group's first, and columns that do are no part of it.
    """
    row = F.xxhash64(*keys)
    value = lambda c: F.col(f"`{c}`").cast("double")
    prints = df.agg(*[F.sum((F.xxhash64(F.lit(0), row, value(c)) % 1_000_000_007)).alias(f"p{i}") for i, c in enumerate(cols)]).first()
    groups: dict = {}
    for i, c in enumerate(cols):
        groups.setdefault(prints[i], []).append(c)
    pairs = [(g[0], c) for g in groups.values() for c in g[1:]]
    rows = []
    if pairs:
        off = df.agg(*[F.count_if(~value(a).eqNullSafe(value(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
        same = {pair for pair, n in zip(pairs, off, strict=True) if n == 0}
        for g in groups.values():
            alike = sorted([g[0], *[c for c in g[1:] if (g[0], c) in same]])
            if len(alike) > 1:
                rows.append((next((p for p in prefer if p in alike), alike[0]), ";".join(alike)))
    return df.sparkSession.createDataFrame(rows, "kept string, features string")


def ranked(df: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    """keys and the columns' average ranks over all rows that have a value; each row needs keys of its own."""
    long = long_form(df, cols, *keys)
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    at = counts.select("feature", "value", (upto - (F.col("_n") - 1) / 2.0).alias("_rank"))
    return long.join(at, ["feature", "value"]).groupBy(*keys).pivot("feature", cols).agg(F.max("_rank"))


def clean(df: DataFrame, cols: list[str], *keys: str, most_missing: float = 0.5, most_corr: float = 0.98) -> tuple[list[str], dict[str, str]]:
    """Columns that stay, and why each other one goes: constant, the same as an earlier one, more than half missing, or ranked like an earlier one.

    Columns are ranked once over their own values, then correlated over the rows that both have. A row a column and a pair reach the driver.
    """
    stats = {r["feature"]: r for r in profile(df, cols).collect()}
    log = {c: "constant" for c in cols if stats[c]["constant"]}
    stay = [c for c in cols if c not in log]
    for r in duplicate_columns(df, stay, *keys, prefer=()).collect():
        first, *others = sorted(r["features"].split(";"), key=cols.index)
        log |= {c: f"the same as {first}" for c in others}
    log |= {c: f"missing {stats[c]['missing_rate']:.1%}" for c in stay if c not in log and stats[c]["missing_rate"] > most_missing}
    stay = [c for c in cols if c not in log]
    near = {(r["a"], r["b"]) for r in pair_correlations(ranked(df, stay, *keys), stay, least=2).where(F.abs("corr") >= most_corr).collect()} if len(stay) > 1 else set()
    for i, c in enumerate(stay):
        if c not in log:
            log |= {o: f"ranked like {c}" for o in stay[i + 1 :] if o not in log and (c, o) in near}
    return [c for c in cols if c not in log], {c: log[c] for c in cols if c in log}


#: Columns that the workflow drops before it looks at their values: aliases, codes, labels, flags.
HARD_DROPS = (
    "hmm_prob_chop", "hmm_market_chop", *(f"hmm_{k}_missing" for k in ("volatility_regime", "return_regime", "market_state")),
    *(f"hmm_prob_{k}" for k in ("extreme_vol", "downside", "normal_vol", "positive", "low_vol", "weak", "high_vol", "strong_upside", "not_stress")), *(f"hmm_regime_prob_{k}" for k in range(4)),
    *(f"hmm_regime_{k}" for k in range(4)), *(f"hmm_volatility_{k}" for k in ("extreme_vol", "normal_vol", "low_vol", "high_vol")), *(f"hmm_return_{k}" for k in ("downside", "positive", "weak", "strong_upside")),
    *(f"hmm_{k}{end}" for end in ("", "_code") for k in ("volatility_regime", "return_regime", "market_state")), "roc_5d", "roc_20d", "roc_63d", "bb_position", "overnight_ret", "intraday_ret", "log_ret", "ret_2d", "ret_3d", "ret_10d",
)


def clean_by_instrument(df: DataFrame, hard: tuple = HARD_DROPS, least: float = 1e-8, keys: tuple = ("date", "instrument", "primary_signal")) -> dict[str, DataFrame]:
    """Each instrument's rows and columns that stay: hard drops go, then columns of variance ``least`` or less, rows with a missing value, and columns that these rows leave with such a variance.

    Two aggregates, a row an instrument. A column without a variance (fewer than two values) stays and so its missing rows go.
    """
    features = [c for c in df.columns if c not in keys and c not in hard]
    numeric = numeric_columns(df.select(*features), ())
    value = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) if c in numeric else F.col(c)

    def low(rows):
        out = {r["instrument"]: r for r in rows.groupBy("instrument").agg(*[F.var_samp(value(c)).alias(c) for c in numeric]).collect()}
        return {k: {c for c in numeric if r[c] is not None and r[c] <= least} for k, r in out.items()}

    first = low(df)
    whole = F.lit(False)
    for k, gone in first.items():
        there = F.lit(True)
        for c in features:
            if c not in gone:
                there = there & value(c).isNotNull()
        whole = whole | (F.col("instrument").eqNullSafe(k) & there)
    rows = df.where(whole)
    second = low(rows)
    return {k: rows.where(F.col("instrument").eqNullSafe(k)).select(*[c for c in df.columns if c in keys or (c in features and c not in gone | second.get(k, set()))]) for k, gone in first.items()}


def principal_components(df: DataFrame, cols: list[str], share: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Rows' component scores, and the loadings; as many components as explain ``share`` of the variance. Nulls take the median."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    medians = df.agg(*[F.percentile(c, 0.5).alias(c) for c in cols]).first()
    filled = df.na.fill({c: float(medians[c] or 0.0) for c in cols})
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(filled)
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(vec).transform(vec)
    full = PCA(k=len(cols), inputCol="_s", outputCol="_p").fit(scaled)
    total, k = 0.0, 0
    for v in full.explainedVariance.toArray():
        total, k = total + v, k + 1
        if total >= share:
            break
    arr = vector_to_array("_p")
    scores = full.transform(scaled).select("date", "instrument", *[arr[i].alias(f"pc{i + 1}") for i in range(k)])
    m = full.pc.toArray()
    loads = df.sparkSession.createDataFrame([(i + 1, c, float(m[j, i])) for i in range(k) for j, c in enumerate(cols)], "component int, feature string, loading double")
    return scores, loads


def top_loadings(loads: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return loads.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
