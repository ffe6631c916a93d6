"""Classification and strategy metrics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import exact_quantiles
from .cpcv import sharpe


#: Bins of the scores from 0 to 1: what lies below a score is what lies below its bin and, in the bin, below it.
BINS = 1024


def _from_scores(scores: DataFrame, by: list[str], p: str, threshold: float) -> DataFrame:
    """All metrics from counts of rows (m) and positives (pos) for each different score."""
    s = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    taken, neg = F.col(p) >= threshold, F.col("m") - F.col("pos")
    total = lambda x: F.sum(x).cast("long")
    agg = scores.groupBy(*by).agg(
        total("m").alias("n"), (F.sum("pos") / F.sum("m")).alias("positive_rate"), (F.sum(F.col("m") * F.col(p)) / F.sum("m")).alias("mean_prediction"), (F.sum(F.when(taken, F.col("m")).otherwise(0)) / F.sum("m")).alias("predicted_positive_rate"),
        total(F.when(taken, F.col("pos")).otherwise(0)).alias("tp"), total(F.when(taken, neg).otherwise(0)).alias("fp"), total(F.when(taken, 0).otherwise(neg)).alias("tn"), total(F.when(taken, 0).otherwise(F.col("pos"))).alias("fn"),
        (F.sum(F.col("pos") * F.pow(F.col(p) - 1, 2) + neg * F.pow(F.col(p), 2)) / F.sum("m")).alias("brier_score"), (-F.sum(F.col("pos") * F.log(s) + neg * F.log(1 - s)) / F.sum("m")).alias("log_loss"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    agg = agg.withColumns({
        "accuracy": (tp + tn) / F.col("n"), "balanced_accuracy": (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })
    scores = scores.withColumn("_bin", F.greatest(F.lit(-1), F.least(F.lit(BINS), F.floor(F.col(p) * BINS))))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = scores.groupBy(*by, "_bin").agg(F.sum("m").alias("_m"), F.sum("pos").alias("_p"))
    all_ = Window.partitionBy(*by)
    bins = bins.select(*by, "_bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_m", "_p")], F.sum("_m").over(all_).alias("_m_all"), F.sum("_p").over(all_).alias("_p_all"))
    inside = Window.partitionBy(*by, "_bin").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c, x: F.col(f"{x}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0))
    at = scores.join(bins, [*by, "_bin"]).select(*by, "m", "pos", "_m_all", "_p_all", below("m", "_m").alias("_under"), below("pos", "_p").alias("_p_under"))
    rank = F.col("_under") + (F.col("m") + 1) / 2
    precision = F.col("pos") * (F.col("_p_all") - F.col("_p_under")) / (F.col("_m_all") - F.col("_under"))
    sums = at.groupBy(*by).agg(F.sum(F.col("pos") * rank).alias("_r"), F.sum(precision).alias("_ap"), F.sum("pos").cast("double").alias("_pos"), (F.sum("m") - F.sum("pos")).cast("double").alias("_neg"))
    auc = F.try_divide(F.col("_r") - F.col("_pos") * (F.col("_pos") + 1) / 2, F.col("_pos") * F.col("_neg"))
    ap = F.when(F.col("_neg") > 0, F.try_divide("_ap", "_pos"))
    return agg.join(sums.select(*by, auc.alias("roc_auc"), ap.alias("average_precision")), by)


def _scores(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*by, p).agg(F.count("*").alias("m"), F.sum(y).alias("pos"))


def binary_metrics(df: DataFrame, by: list[str], y: str = "y_true", p: str = "prediction", threshold: float = 0.5) -> DataFrame:
    """Counts, accuracy, precision, recall, F1, Brier score, log loss, AUC (average ranks) and average precision of each group.

    Rows are counted by score with a map-side combine, and all else follows from these counts; scores are ordered bin by bin, so no task
    sorts all of a group's. AUC, balanced accuracy and average precision are null where only one class occurs; precision, recall and F1
    are 0 where they aren't defined.
    """
    return _from_scores(_scores(df, by, y, p), by, p, threshold)


def with_overall(df: DataFrame, key: str = "instrument", y: str = "y_true", p: str = "prediction", threshold: float = 0.5) -> DataFrame:
    """The metrics by ``key``, and once more over all rows as "overall": rows are read and counted once."""
    scores = _scores(df, [key], y, p).withColumn(key, F.explode(F.array(F.col(key), F.lit("overall"))))
    return _from_scores(scores.groupBy(key, p).agg(F.sum("m").alias("m"), F.sum("pos").alias("pos")), [key], p, threshold)


def curve_points(df: DataFrame, by: list[str], y: str = "y_true", p: str = "prediction") -> DataFrame:
    """Points of the ROC and precision-recall curves, one for each different score, from the highest down."""
    scores = df.groupBy(*by, F.col(p).alias("threshold")).agg(F.count("*").alias("m"), F.sum(y).alias("pos"))
    w = Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    tp, taken = F.sum("pos").over(w), F.sum("m").over(w)
    w_all = Window.partitionBy(*by)
    pos, neg = F.sum("pos").over(w_all), F.sum(F.col("m") - F.col("pos")).over(w_all)
    return scores.select(*by, "threshold", tp.alias("tp"), (taken - tp).alias("fp"), F.try_divide(tp, pos).alias("tpr"), F.try_divide(taken - tp, neg).alias("fpr"), (tp / taken).alias("precision"))


def calibration(df: DataFrame, by: list[str], bins: int = 10, y: str = "y_true", p: str = "prediction") -> DataFrame:
    """Mean score and rate of positives in bins between the quantiles of the scores."""
    edges = exact_quantiles(df, by, p, [i / bins for i in range(1, bins)]).groupBy(*by).agg(F.collect_list("quantile").alias("_e"))
    binned = df.join(edges, by).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(p))))
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("fraction_positive"))


def ev_threshold(df: DataFrame, by: list[str], y: str = "y_true", r: str = "signed_touch_return") -> DataFrame:
    """The probability from which a trade's expected return is above 0: -loss / (gain - loss), clipped to [0, 1], 0.5 where it isn't defined."""
    g = df.groupBy(*by).agg(F.avg(F.when(F.col(y) == 1, F.col(r))).alias("r_good"), F.avg(F.when(F.col(y) == 0, F.col(r))).alias("r_bad"), F.count_if(F.col(y) == 1).alias("n_good"), F.count_if(F.col(y) == 0).alias("n_bad"))
    raw = F.when(F.col("r_good") > F.col("r_bad"), -F.col("r_bad") / (F.col("r_good") - F.col("r_bad")))
    return g.withColumn("raw_threshold", raw).withColumn("clipped_threshold", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "raw_threshold")), F.lit(0.5)))


#: Modulus of the draws, a prime below 2^31: squares of numbers below it fit in 64 bits.
PRIME = 2147483647


def draw(sample, place, stratum, seed: int = 11):
    """A whole number from 0 to PRIME - 1 by sample, place and stratum: squarings keep neighbours apart. The same on any engine."""
    z = (sample * F.lit(1000003) + place * F.lit(7919) + stratum * F.lit(104729) + F.lit(seed)) % PRIME
    z = (z * z + 12345) % PRIME
    z = (z * 48271 + place) % PRIME
    return (z * z + sample) % PRIME


def bootstrap_threshold(df: DataFrame, by: list[str], draws: int = 2000, y: str = "y_true", r: str = "signed_touch_return", seed: int = 11) -> DataFrame:
    """Median, 5th and 95th percentile of the threshold over stratified bootstrap samples: each class is drawn from with replacement, as many rows as it has.

    A group's returns of one class, in order of date, are one array (a few thousand events); only samples are exploded, each as a number, so rows
    are neither copied nor shuffled again.
    """
    known = df.where(F.col(r).isNotNull() & F.col(y).isin(0, 1)).select(*by, F.col(y).cast("long").alias("_y"), F.struct("date", F.col(r).alias("r")).alias("_r"))
    classes = known.groupBy(*by, "_y").agg(F.transform(F.sort_array(F.collect_list("_r")), lambda x: x["r"]).alias("_v"))
    classes = classes.withColumns({"_n": F.size("_v").cast("long"), "sample": F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long")))})
    value = lambda j: F.get("_v", (draw(F.col("sample"), j, F.col("_y"), seed) * F.col("_n") / F.lit(PRIME)).cast("int"))
    mean = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), F.lit(0.0), lambda acc, j: acc + value(j)) / F.col("_n")
    sums = classes.select(*by, "sample", "_y", mean.alias("m"))
    both = sums.groupBy(*by, "sample").agg(F.max(F.when(F.col("_y") == 1, F.col("m"))).alias("g"), F.max(F.when(F.col("_y") == 0, F.col("m"))).alias("b"))
    t = F.when(F.col("g") > F.col("b"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.col("b") / (F.col("g") - F.col("b")))))
    return both.withColumn("t", t).groupBy(*by).agg(F.count("t").alias("samples"), F.percentile("t", 0.5).alias("median"), F.percentile("t", 0.05).alias("pct5"), F.percentile("t", 0.95).alias("pct95"))


def threshold_sweep(df: DataFrame, by: list[str], y: str = "y_true", p: str = "prediction", steps: int = 37) -> DataFrame:
    """The threshold from 0.05 to 0.95 of the best F1; the first of equals, and none that predicts one class only.

    Rows are counted by how many thresholds they reach; thresholds are then sums of these few counts.
    """
    steps_ = F.sequence(F.lit(0), F.lit(steps - 1))
    at = lambda i: F.round(0.05 + i * (0.9 / (steps - 1)), 10)
    reached = F.size(F.filter(F.transform(steps_, at), lambda t: t <= F.col(p)))
    counts = df.groupBy(*by, reached.alias("_k")).agg(F.count("*").alias("m"), F.sum(y).alias("pos"))
    rows = counts.withColumn("_i", F.explode(steps_)).withColumn("_p", F.col("_k") > F.col("_i"))
    on = lambda c: F.sum(F.when(F.col("_p"), F.col(c)).otherwise(0))
    g = rows.groupBy(*by, "_i").agg(on("pos").alias("_tp"), on("m").alias("_taken"), F.sum("pos").alias("_pos"), F.sum("m").alias("_n"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("_tp"), F.col("_taken") + F.col("_pos")), F.lit(0.0))
    g = g.where("_taken > 0 and _taken < _n").select(*by, at(F.col("_i")).alias("threshold"), f1.alias("f1"))
    return g.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("f1"), "threshold"))).where("_k = 1").select(*by, "threshold", "f1")


def nav_table(df: DataFrame, threshold: float = 0.5, p: str = "prediction", r: str = "signed_touch_return") -> DataFrame:
    """Net asset values and drawdowns of all trades and of those the model takes, by instrument and date."""
    w = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.where(F.col(r).isNotNull()).withColumn("meta_return", F.when(F.col(p) >= threshold, F.col(r)).otherwise(0.0)).withColumn("primary_return", F.col(r))
    for k in ("primary", "meta"):
        df = df.withColumn(f"{k}_nav", F.exp(F.sum(F.log1p(f"{k}_return")).over(w)))
        df = df.withColumn(f"{k}_drawdown", F.col(f"{k}_nav") / F.max(f"{k}_nav").over(w) - 1)
    return df.select("instrument", "date", "primary_return", "meta_return", "primary_nav", "meta_nav", "primary_drawdown", "meta_drawdown")


def nav_summary(nav: DataFrame, horizon: int = 10) -> DataFrame:
    """Trades, mean return, total profit, annualised Sharpe ratio and deepest drawdown of both strategies."""
    rows = nav.selectExpr("instrument", "date", "stack(2, 'primary', primary_return, primary_nav, primary_drawdown, 'meta', meta_return, meta_nav, meta_drawdown) as (strategy, ret, nav, drawdown)")
    return rows.groupBy("instrument", "strategy").agg(F.count_if(F.col("ret") != 0).alias("n_trades"), F.avg("ret").alias("mean_event_return"), (F.max_by("nav", "date") - 1).alias("total_profit"), sharpe(F.col("ret"), (252 / horizon) ** 0.5).alias("annualised_sharpe"), F.min("drawdown").alias("max_drawdown"))


def return_diagnostics(df: DataFrame, p: str = "prediction", r: str = "signed_touch_return") -> DataFrame:
    """How often the model takes trades, and mean and total returns with and without it."""
    take = (F.col(p) >= 0.5).cast("int")
    return df.groupBy("instrument").agg(F.count("*").alias("n_events"), F.avg(take).alias("take_rate"), F.avg(r).alias("mean_primary_return"), F.avg(take * F.col(r)).alias("mean_meta_return"), F.sum(r).alias("total_primary_return"), F.sum(take * F.col(r)).alias("total_meta_return"))


def decide(opportunity, direction, opp_threshold: float = 0.5, dir_threshold: float = 0.5):
    """1 for a long, -1 for a short, 0 for none: no trade below the first threshold; the second picks the side."""
    return F.when(opportunity < opp_threshold, 0).when(direction >= dir_threshold, 1).otherwise(-1)


def trading_metrics(df: DataFrame, cost: float = 0.001, days: int = 252, signal: str = "signal", pct: str = "return_pct") -> DataFrame:
    """Annual return and volatility, Sharpe ratio before and after costs, deepest drawdown, hit rate and turnover of each instrument's trades."""
    w = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    on = F.col(signal) != 0
    df = df.withColumn("_r", F.when(on, F.col(pct) / 100)).withColumn("_nav", F.exp(F.sum(F.log1p("_r")).over(w)))
    df = df.withColumn("_dd", F.when(on, F.col("_nav") / F.max(F.when(on, F.col("_nav"))).over(w) - 1))
    sd = F.nullif(F.stddev_samp("_r"), F.lit(0.0))
    return df.groupBy("instrument").agg(
        F.count("_r").alias("n_trades"), (F.avg("_r") * days).alias("ann_return"), (F.stddev_samp("_r") * days**0.5).alias("ann_vol"), (F.avg("_r") / sd * days**0.5).alias("sharpe"),
        ((F.avg("_r") - 2 * cost) / sd * days**0.5).alias("sharpe_tc"), F.min("_dd").alias("max_drawdown"), F.avg((F.col("_r") > 0).cast("int")).alias("hit_rate"), (F.count("_r") / F.count("*")).alias("turnover"),
    )


def candidate_summary(folds: DataFrame, by: list[str], metric: str = "roc_auc") -> DataFrame:
    """Mean, median and deviation of a metric over folds."""
    return folds.groupBy(*by).agg(F.avg(metric).alias("mean_auc"), F.percentile(metric, 0.5).alias("median_auc"), F.stddev_samp(metric).alias("std_auc"), F.count(metric).alias("n_folds"))


def top3_then_sharpe(candidates: DataFrame, by: str = "ticker", tie: str = "candidate") -> DataFrame:
    """Of each group's three best by AUC, the one of the best median path Sharpe ratio."""
    auc = Window.partitionBy(by).orderBy(F.desc_nulls_last("mean_auc"), F.asc_nulls_last("std_auc"), F.desc_nulls_last("median_auc"), tie)
    top = candidates.withColumn("auc_rank", F.row_number().over(auc)).where("auc_rank <= 3")
    best = Window.partitionBy(by).orderBy(F.desc_nulls_last("median_path_trade_sharpe"), F.asc_nulls_last("path_sharpe_iqr"), F.desc_nulls_last("mean_auc"), F.asc_nulls_last("std_auc"), tie)
    return top.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def upsert(table: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``table`` without the rows of one key value, and the new rows."""
    return table.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(new, allowMissingColumns=True)


def oof_average(oof: DataFrame) -> DataFrame:
    """One row for each event: its label, mean out-of-fold score and number of folds."""
    return oof.groupBy("instrument", "date").agg(F.min("y_true").alias("y_true"), F.min("signed_touch_return").alias("signed_touch_return"), F.avg("y_proba").alias("y_proba"), F.count("*").alias("n_folds"))
