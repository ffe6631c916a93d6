"""Queries of cross-validation, metrics, selection and allocation, and the same in SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.scalars import ERF, hash_unit, probability_size
from ..functions.windows import by_date
from ..operators import allocation as al
from ..operators import cpcv
from ..operators import labels as lb
from ..operators import metrics as mt
from ..sources.bars import signals_from_bars
from . import oracle as o
from .labelling import TOUCH, events_sql, vols
from .technical import bars_of, rounded


def events_of(spark, sf_dir):
    """Labelled events of the rolling-volatility configuration."""
    bars = bars_of(spark, sf_dir)
    out = lb.label_pipeline(bars, signals_from_bars(bars), lb.Config("rolling", "rolling"))
    return out.select("instrument", "date", "timeout_date", "touch_date", "primary_signal", "metalabel", "signed_touch_return")


def predictions_of(spark, sf_dir):
    """Events with a score in [0, 1]: partly the label, partly a hash."""
    e = events_of(spark, sf_dir)
    p = F.round(0.25 * F.col("metalabel") + 0.75 * hash_unit("p", F.col("instrument"), F.col("date")), 3)
    return e.select("instrument", "date", "primary_signal", F.col("metalabel").alias("y_true"), "signed_touch_return", p.alias("prediction"))


def oof_of(spark, sf_dir):
    e = events_of(spark, sf_dir)
    test = cpcv.splits_by_rows(e).where("role = 'test'")
    p = hash_unit("oof", F.col("instrument"), F.col("date"), F.col("split_id"))
    rows = test.join(e.select("instrument", "date", F.col("metalabel").alias("y_true"), "signed_touch_return"), ["instrument", "date"])
    return rows.withColumn("y_proba", F.round(0.25 * F.col("y_true") + 0.75 * p, 3)).withColumn("y_pred", (F.col("y_proba") >= 0.5).cast("int"))


def _blocks(spark, sf_dir):
    return cpcv.blocks(events_of(spark, sf_dir)).select("instrument", "date", "pos", "block_id")


def _splits(make):
    return lambda spark, sf_dir: make(events_of(spark, sf_dir)).select("instrument", "split_id", "pos", "block_id", "role")


def _counts(spark, sf_dir):
    return cpcv.split_counts(cpcv.splits_by_rows(events_of(spark, sf_dir)))


def _paths(spark, sf_dir):
    return cpcv.path_ids(cpcv.splits_by_rows(events_of(spark, sf_dir)).where("role = 'test'"))


def _path_sharpe(spark, sf_dir):
    return rounded(cpcv.path_sharpes(cpcv.stitch(oof_of(spark, sf_dir))))


def _label_end(spark, sf_dir):
    e = events_of(spark, sf_dir)
    return e.select("instrument", "date", F.when(F.dayofmonth("date") > 20, F.col("timeout_date")).alias("timeout_date"), F.when(F.dayofmonth("date") > 10, F.col("touch_date")).alias("touch_date")).select("instrument", "date", cpcv.label_end().alias("t1"))


def _p(f):
    return lambda spark, sf_dir: rounded(f(predictions_of(spark, sf_dir)))


def _sized(p):
    """Trades of a twentieth of the capital, so that values of thousands of trades stay near 1."""
    return p.withColumn("signed_touch_return", 0.05 * F.col("signed_touch_return"))


def _fold_metrics(spark, sf_dir):
    return rounded(mt.candidate_summary(mt.binary_metrics(oof_of(spark, sf_dir), ["instrument", "split_id"], p="y_proba"), ["instrument"]))


def _ann_vol(spark, sf_dir):
    return rounded(al.annual_vol(bars_of(spark, sf_dir)))


def allocation_of(spark, sf_dir, **more):
    bars, p = bars_of(spark, sf_dir), predictions_of(spark, sf_dir)
    return al.allocate(p.select("date", "instrument", "prediction"), p.select("date", "instrument", "primary_signal"), al.annual_vol(bars), **more)


def _sizing(spark, sf_dir):
    p = predictions_of(spark, sf_dir)
    return rounded(p.select("instrument", "date", *[probability_size(F.col("prediction"), m).alias(m) for m in ("all_or_nothing", "model_confidence", "ncdf")]))


def aligned_of(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    fixed = allocation_of(spark, sf_dir)
    score = 3 * (F.col("prediction") - 0.5)
    neural = al.gross_capped(fixed.where("prediction > 0.3").select("date", "instrument", al.head_weight(score, F.col("primary_signal")).alias("capped_weight"))).select("date", "instrument", "weight")
    nxt = bars.select("date", "instrument", (F.try_divide(F.lead("close").over(by_date()), "close") - 1).alias("next_return"))
    return al.align_weights(fixed, neural, nxt)


def _aligned(f):
    return lambda spark, sf_dir: rounded(f(aligned_of(spark, sf_dir)))


def _trading(spark, sf_dir):
    p = predictions_of(spark, sf_dir)
    s = mt.decide(F.col("prediction"), hash_unit("d", F.col("instrument"), F.col("date")), 0.4)
    return rounded(mt.trading_metrics(p.select("instrument", "date", s.alias("signal"), (100 * F.col("signed_touch_return")).alias("return_pct"))))


QUERIES = {
    "cpcv_blocks": _blocks, "cpcv_splits_a": _splits(cpcv.splits_by_rows), "cpcv_splits_b": _splits(cpcv.splits_by_dates), "cpcv_splits_c": _splits(cpcv.splits_before), "cpcv_train_counts": _counts, "cpcv_paths": _paths, "path_sharpe": _path_sharpe, "label_end": _label_end,
    "clf_metrics": _p(mt.with_overall), "roc_pr_points": _p(lambda p: mt.curve_points(p, ["instrument"])), "calibration": _p(lambda p: mt.calibration(p, ["instrument"])), "ev_threshold": _p(lambda p: mt.ev_threshold(p, ["instrument"])),
    "bootstrap_threshold": _p(lambda p: mt.bootstrap_threshold(p, ["instrument"])), "threshold_sweep": _p(lambda p: mt.threshold_sweep(p, ["instrument"])), "nav_drawdown": _p(lambda p: mt.nav_table(_sized(p))), "nav_summary": _p(lambda p: mt.nav_summary(mt.nav_table(_sized(p)))), "return_diagnostics": _p(mt.return_diagnostics),
    "trading_metrics": _trading, "candidate_summary": _fold_metrics, "oof_average": lambda s, d: rounded(mt.oof_average(oof_of(s, d))), "ewma_ann_vol": _ann_vol, "sizing": _sizing,
    "allocation": lambda s, d: rounded(allocation_of(s, d)), "gross_cap": lambda s, d: rounded(allocation_of(s, d, most_gross=0.2).select("date", "instrument", "capped_weight", "weight")), "weights_compare": _aligned(lambda a: a), "strategy_summary": _aligned(al.strategy_summary),
    "strategy_summary_portfolio": _aligned(lambda a: al.strategy_summary(a, "portfolio_sum")), "instrument_summary": _aligned(al.instrument_summary), "daily_panel": _aligned(al.daily_panel),
}

# ---- the same in SQL -------------------------------------------------------------------------------------------------


def _hash(*parts: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0)"


EVENTS = vols() + events_sql("vol_rolling", "10", "2.0", "2.0") + TOUCH.replace("{more}", "") + ", evs AS (SELECT instrument, date, timeout_date, touch_date, primary_signal, metalabel, signed_touch_return FROM ez)"
PRED = EVENTS + f", pr AS (SELECT instrument, date, primary_signal, metalabel AS y_true, signed_touch_return, round(0.25::DOUBLE * metalabel + 0.75::DOUBLE * {_hash(chr(39) + 'p' + chr(39), 'instrument', 'CAST(date AS VARCHAR)')}, 3) AS prediction FROM evs)"


def _blocked(n: int) -> str:
    return f", bk AS (SELECT *, CAST(row_number() OVER ({o.W}) - 1 AS INTEGER) AS pos, CAST(ntile({n}) OVER ({o.W}) - 1 AS INTEGER) AS block_id FROM evs), st AS (SELECT instrument, block_id, min(date) AS s, max(date) AS l, max(timeout_date) AS e, max(pos) AS lp FROM bk GROUP BY ALL)"


def _combos(n: int, k: int, first: int) -> str:
    rows = ", ".join(f"({first + i}, {b})" for i, c in enumerate(combinations(range(n), k)) for b in c)
    return f", cb AS (SELECT CAST(split_id AS INTEGER) AS split_id, CAST(block_id AS INTEGER) AS block_id FROM (VALUES {rows}) z(split_id, block_id)), ts AS (SELECT cb.split_id, st.* FROM cb JOIN st USING (block_id)), sp AS (SELECT DISTINCT split_id FROM cb)"


def _role(drop: str) -> str:
    return f""", ro AS (SELECT bk.instrument, sp.split_id, bk.pos, bk.block_id, bk.date,
  EXISTS (SELECT 1 FROM cb WHERE cb.split_id = sp.split_id AND cb.block_id = bk.block_id) AS is_test,
  EXISTS (SELECT 1 FROM ts WHERE ts.split_id = sp.split_id AND ts.instrument = bk.instrument AND ({drop})) AS gone FROM bk CROSS JOIN sp),
  rl AS (SELECT instrument, split_id, pos, block_id, date, CASE WHEN is_test THEN 'test' ELSE 'train' END AS role FROM ro WHERE is_test OR NOT gone)"""


_OV = "bk.date <= ts.e AND bk.timeout_date >= ts.s"
SPLIT_A = EVENTS + _blocked(8) + _combos(8, 2, 1) + _role(f"({_OV}) OR (bk.pos > ts.lp AND bk.pos <= ts.lp + 10)")
_DAYS = ", dy AS (SELECT instrument, date, row_number() OVER (PARTITION BY instrument ORDER BY date) AS k FROM (SELECT DISTINCT instrument, date FROM evs)), dm AS (SELECT instrument, max(k) AS m FROM dy GROUP BY instrument), em AS (SELECT dy.instrument, dy.date, d2.date AS emb FROM dy JOIN dm USING (instrument) JOIN dy d2 ON d2.instrument = dy.instrument AND d2.k = least(dy.k + 5, dm.m))"
SPLIT_B = EVENTS + _DAYS + _blocked(6) + _combos(6, 2, 0) + _role(f"({_OV}) OR (bk.date > ts.l AND bk.date <= (SELECT emb FROM em WHERE em.instrument = ts.instrument AND em.date = ts.l))")
SPLIT_C = (
    EVENTS
    + _blocked(4)
    + ", ed AS (SELECT instrument, CAST(greatest(1, ceil(0.01 * greatest(1, date_diff('day', min(date), max(date))))) AS INTEGER) AS days FROM evs GROUP BY instrument)"
    + _combos(4, 2, 0)
    + _role("bk.timeout_date >= (SELECT min(t2.s) FROM ts t2 WHERE t2.split_id = ts.split_id AND t2.instrument = ts.instrument) OR (bk.date > ts.l AND bk.date <= ts.l + (SELECT days FROM ed WHERE ed.instrument = ts.instrument))")
    + ", rc AS (SELECT rl.* FROM rl JOIN (SELECT instrument, split_id FROM rl GROUP BY ALL HAVING count(*) FILTER (role = 'train') > 0) USING (instrument, split_id))"
)
_OOF = SPLIT_A + f", oof AS (SELECT rl.instrument, rl.split_id, rl.block_id, rl.date, evs.metalabel AS y_true, evs.signed_touch_return, round(0.25::DOUBLE * evs.metalabel + 0.75::DOUBLE * {_hash(chr(39) + 'oof' + chr(39), 'rl.instrument', 'CAST(rl.date AS VARCHAR)', 'CAST(rl.split_id AS VARCHAR)')}, 3) AS y_proba FROM rl JOIN evs USING (instrument, date) WHERE role = 'test')"
_PATHS = ", ph AS (SELECT *, CAST(row_number() OVER (PARTITION BY instrument, block_id ORDER BY split_id) - 1 AS INTEGER) AS path_id FROM (SELECT DISTINCT instrument, split_id, block_id FROM {source}))"
_sh = lambda x, k="1.0": f"CASE WHEN count({x}) >= 2 AND stddev_samp({x}) > 0 THEN avg({x}) / nullif(stddev_samp({x}), 0) * {k} END"


def _metrics(source: str, by: str, p: str) -> str:
    """mm: the metrics of each group."""
    s = f"least(greatest({p}, 1e-15), 1 - 1e-15)"
    c = lambda a, b: f"count(*) FILTER (y_true = {a} AND ({p} >= 0.5) = {b})"
    return f""", ma AS (SELECT {by}, count(*) AS n, avg(y_true) AS positive_rate, avg({p}) AS mean_prediction, avg(CAST({p} >= 0.5 AS INTEGER)) AS predicted_positive_rate, {c(1, "true")} AS tp, {c(0, "true")} AS fp, {c(0, "false")} AS tn, {c(1, "false")} AS fn,
  avg(pow({p} - y_true, 2)) AS brier_score, avg(-CASE WHEN y_true = 1 THEN ln({s}) ELSE ln(1 - {s}) END) AS log_loss FROM {source} GROUP BY {by}),
  mu AS (SELECT {by}, y_true, rank() OVER (PARTITION BY {by} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, {p}) - 1) / 2.0::DOUBLE AS r, sum(y_true) OVER (PARTITION BY {by} ORDER BY {p} DESC) / CAST(count(*) OVER (PARTITION BY {by} ORDER BY {p} DESC) AS DOUBLE) AS prec FROM {source}),
  mr AS (SELECT {by}, sum(r) FILTER (y_true = 1) AS rs, count(*) FILTER (y_true = 1) AS np, count(*) FILTER (y_true = 0) AS nn, sum(prec) FILTER (y_true = 1) AS ap FROM mu GROUP BY {by}),
  mm AS (SELECT ma.*, (tp + tn) / CAST(n AS DOUBLE) AS accuracy, (tp / nullif(CAST(tp + fn AS DOUBLE), 0) + tn / nullif(CAST(tn + fp AS DOUBLE), 0)) / 2 AS balanced_accuracy, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS "precision", coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
  coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1, (rs - np * (np + 1) / 2.0::DOUBLE) / nullif(CAST(np AS DOUBLE) * nn, 0) AS roc_auc, CASE WHEN nn > 0 THEN ap / nullif(CAST(np AS DOUBLE), 0) END AS average_precision FROM ma JOIN mr USING ({by}))"""


_M = ["positive_rate", "mean_prediction", "predicted_positive_rate", "brier_score", "log_loss", "accuracy", "balanced_accuracy", '"precision"', "recall", "f1", "roc_auc", "average_precision"]
_ERF_X = "((prediction - 0.5) / sqrt(greatest(prediction * (1 - prediction), 1e-12)) / sqrt(2.0::DOUBLE))"
_T = f"(1 / (1 + {ERF[0]}::DOUBLE * abs({_ERF_X})))"
_POLY = f"(((({ERF[5]}::DOUBLE * {_T} + {ERF[4]}::DOUBLE) * {_T}) + {ERF[3]}::DOUBLE) * {_T} + {ERF[2]}::DOUBLE) * {_T} + {ERF[1]}::DOUBLE"
NCDF = f"(0.5 * (1 + sign({_ERF_X}) * (1 - ({_POLY}) * {_T} * exp(-({_ERF_X}) * ({_ERF_X})))))"
_VOL = PRED + f", av0 AS (SELECT *, close / {o.lag('close')} - 1 AS ret FROM b0), " + o.ewm_stds("av0", "aw", "ret", {"v": (2 / 61, 20, False)}) + ", av AS (SELECT date, instrument, v * sqrt(252.0::DOUBLE) AS annualized_ewma_vol FROM b0 JOIN aw USING (instrument, rn))"


def _alloc(most: float) -> str:
    return (
        _VOL
        + f", a1 AS (SELECT pr.date, pr.instrument, prediction, primary_signal, CASE WHEN prediction <= 0.5 THEN 0.0 ELSE {NCDF} END AS size, annualized_ewma_vol FROM pr LEFT JOIN av USING (date, instrument)), a2 AS (SELECT *, CASE WHEN primary_signal IN (-1, 1) AND annualized_ewma_vol > 0 THEN primary_signal * size * 0.10::DOUBLE / annualized_ewma_vol ELSE 0.0 END AS raw_weight FROM a1), a3 AS (SELECT *, greatest(-0.25::DOUBLE, least(0.25::DOUBLE, raw_weight)) AS capped_weight FROM a2), a4 AS (SELECT *, sum(abs(capped_weight)) OVER (PARTITION BY date) AS g FROM a3), fx AS (SELECT *, capped_weight * CASE WHEN g > {most} THEN {most}::DOUBLE / g ELSE 1.0 END AS weight FROM a4)"
    )


_ALIGN = (
    _alloc(1.0)
    + ", n1 AS (SELECT date, instrument, primary_signal * 0.25::DOUBLE * pow(tanh(3 * (prediction - 0.5)), 2) AS c FROM fx WHERE prediction > 0.3), n2 AS (SELECT *, sum(abs(c)) OVER (PARTITION BY date) AS g FROM n1), nw AS (SELECT date, instrument, c * CASE WHEN g > 1.0 THEN 1.0 / g ELSE 1.0 END AS weight FROM n2)"
    + f", nx AS (SELECT date, instrument, {o.lead('close')} / close - 1 AS next_return FROM bars), al AS (SELECT date, instrument, coalesce(fx.weight, 0) AS fixed_weight, coalesce(nw.weight, 0) AS neural_weight FROM fx FULL OUTER JOIN nw USING (date, instrument)), ag AS (SELECT al.*, next_return, neural_weight - fixed_weight AS weight_diff, sign(fixed_weight) = sign(neural_weight) AS same_sign, fixed_weight * next_return AS fixed_pnl, neural_weight * next_return AS neural_pnl FROM al LEFT JOIN nx USING (date, instrument))"
)


def _strategy(agg: str) -> str:
    long = ", lg AS (SELECT date, 'fixed' AS strategy, fixed_weight AS w, fixed_pnl AS pnl FROM ag UNION ALL SELECT date, 'neural', neural_weight, neural_pnl FROM ag), dd AS (SELECT strategy, date, count(*) AS rows, sum(abs(w)) AS gross, sum(w) AS net, " + agg + "(pnl) AS pnl, count(*) FILTER (w <> 0) AS active, max(abs(w)) AS top FROM lg GROUP BY strategy, date)"
    cols = {"mean_abs_weight": "sum(gross) / sum(rows)", "max_abs_weight": "max(top)", "mean_daily_gross": "avg(gross)", "max_daily_gross": "max(gross)", "mean_daily_net": "avg(net)", "mean_active_count": "avg(active)", "mean_daily_pnl": "avg(pnl)", "annualized_vol": "stddev_samp(pnl) * sqrt(252.0::DOUBLE)", "annualized_sharpe": _sh("pnl", "sqrt(252.0::DOUBLE)"), "cumulative_pnl": "sum(pnl)"}
    return f"WITH RECURSIVE {_ALIGN}{long} SELECT strategy, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(active) AS BIGINT) AS nonzero_weights, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in cols.items()) + " FROM dd GROUP BY strategy"


_NAV = PRED + f", nv AS (SELECT instrument, date, 0.05::DOUBLE * signed_touch_return AS primary_return, CASE WHEN prediction >= 0.5 THEN 0.05::DOUBLE * signed_touch_return ELSE 0.0 END AS meta_return FROM pr), nb AS (SELECT *, exp(sum(ln(1 + primary_return)) OVER ({o.W} ROWS UNBOUNDED PRECEDING)) AS primary_nav, exp(sum(ln(1 + meta_return)) OVER ({o.W} ROWS UNBOUNDED PRECEDING)) AS meta_nav FROM nv), nc AS (SELECT *, primary_nav / max(primary_nav) OVER ({o.W} ROWS UNBOUNDED PRECEDING) - 1 AS primary_drawdown, meta_nav / max(meta_nav) OVER ({o.W} ROWS UNBOUNDED PRECEDING) - 1 AS meta_drawdown FROM nb)"
_r = lambda *cols: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)
_TRADE = PRED + f", tr AS (SELECT instrument, date, CASE WHEN prediction < 0.4 THEN 0 WHEN {_hash(chr(39) + 'd' + chr(39), 'instrument', 'CAST(date AS VARCHAR)')} >= 0.5 THEN 1 ELSE -1 END AS sg, 100 * signed_touch_return / 100 AS rr FROM pr), tq AS (SELECT *, CASE WHEN sg <> 0 THEN rr END AS r FROM tr), tn AS (SELECT *, exp(sum(ln(1 + r)) OVER ({o.W} ROWS UNBOUNDED PRECEDING)) AS nav FROM tq), td AS (SELECT *, CASE WHEN sg <> 0 THEN nav / max(CASE WHEN sg <> 0 THEN nav END) OVER ({o.W} ROWS UNBOUNDED PRECEDING) - 1 END AS dd FROM tn)"

ORACLES = {
    "cpcv_blocks": f"WITH RECURSIVE {EVENTS}{_blocked(8)} SELECT instrument, date, pos, block_id FROM bk",
    "cpcv_splits_a": f"WITH RECURSIVE {SPLIT_A} SELECT instrument, split_id, pos, block_id, role FROM rl",
    "cpcv_splits_b": f"WITH RECURSIVE {SPLIT_B} SELECT instrument, split_id, pos, block_id, role FROM rl",
    "cpcv_splits_c": f"WITH RECURSIVE {SPLIT_C} SELECT instrument, split_id, pos, block_id, role FROM rc",
    "cpcv_train_counts": f"WITH RECURSIVE {SPLIT_A} SELECT instrument, split_id, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM rl GROUP BY ALL",
    "cpcv_paths": f"WITH RECURSIVE {SPLIT_A}, rt AS (SELECT * FROM rl WHERE role = 'test'){_PATHS.format(source='rt')} SELECT * FROM ph",
    "path_sharpe": f"WITH RECURSIVE {_OOF}{_PATHS.format(source='oof')}, pp AS (SELECT oof.*, path_id, CASE WHEN y_proba >= 0.5 THEN signed_touch_return END AS t FROM oof JOIN ph USING (instrument, split_id, block_id)) SELECT instrument, path_id, count(DISTINCT block_id) AS n_blocks, count(*) AS n_rows, count(t) AS trade_count, round({_sh('t')}, 6) + 0.0 AS path_trade_sharpe, round(avg(t), 6) + 0.0 AS mean_trade_return FROM pp GROUP BY instrument, path_id",
    "label_end": f"WITH RECURSIVE {EVENTS} SELECT instrument, date, coalesce(CASE WHEN day(date) > 20 THEN timeout_date END, CASE WHEN day(date) > 10 THEN touch_date END, date + 10) AS t1 FROM evs",
    "clf_metrics": f"WITH RECURSIVE {PRED}, pa AS (SELECT * FROM pr UNION ALL SELECT 'overall', date, primary_signal, y_true, signed_touch_return, prediction FROM pr){_metrics('pa', 'instrument', 'prediction')} SELECT instrument, n, tp, fp, tn, fn, {_r(*_M)} FROM mm",
    "roc_pr_points": f"WITH RECURSIVE {PRED}, sc AS (SELECT instrument, prediction AS threshold, count(*) AS m, CAST(sum(y_true) AS BIGINT) AS pos FROM pr GROUP BY ALL), cu AS (SELECT instrument, threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(m - pos) OVER w AS BIGINT) AS fp, sum(pos) OVER (PARTITION BY instrument) AS ap, sum(m - pos) OVER (PARTITION BY instrument) AS an FROM sc WINDOW w AS (PARTITION BY instrument ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)) SELECT instrument, round(threshold, 6) AS threshold, tp, fp, round(tp / ap::DOUBLE, 6) AS tpr, round(fp / an::DOUBLE, 6) AS fpr, round(tp / (tp + fp)::DOUBLE, 6) AS \"precision\" FROM cu",
    "calibration": f"WITH RECURSIVE {PRED}, qe AS (SELECT instrument, quantile_cont(prediction, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM pr GROUP BY instrument), qb AS (SELECT pr.*, CAST(len(list_filter(e, lambda x: x < prediction)) AS INTEGER) AS bin FROM pr JOIN qe USING (instrument)) SELECT instrument, bin, count(*) AS n, round(avg(prediction), 6) AS mean_predicted, round(avg(y_true), 6) AS fraction_positive FROM qb GROUP BY instrument, bin",
    "ev_threshold": f"WITH RECURSIVE {PRED}, g AS (SELECT instrument, avg(signed_touch_return) FILTER (y_true = 1) AS r_good, avg(signed_touch_return) FILTER (y_true = 0) AS r_bad, count(*) FILTER (y_true = 1) AS n_good, count(*) FILTER (y_true = 0) AS n_bad FROM pr GROUP BY instrument), gg AS (SELECT *, CASE WHEN r_good > r_bad THEN -r_bad / (r_good - r_bad) END AS raw_threshold FROM g) SELECT instrument, n_good, n_bad, {_r('r_good', 'r_bad', 'raw_threshold')}, round(coalesce(greatest(0, least(1, raw_threshold)), 0.5), 6) AS clipped_threshold FROM gg",
    "bootstrap_threshold": f"WITH RECURSIVE {PRED}, bv AS (SELECT instrument, y_true, signed_touch_return AS r, CAST(row_number() OVER (PARTITION BY instrument, y_true ORDER BY date) - 1 AS BIGINT) AS k, count(*) OVER (PARTITION BY instrument, y_true) AS n FROM pr), bj AS (SELECT instrument, y_true, n, k AS j, CAST(s AS BIGINT) AS s FROM bv, range(1, 2001) z(s)), b1 AS (SELECT *, (s * 1000003 + j * 7919 + y_true * 104729 + 11) % 2147483647 AS z FROM bj), b2 AS (SELECT *, (z * z + 12345) % 2147483647 AS z2 FROM b1), b3 AS (SELECT *, (z2 * 48271 + j) % 2147483647 AS z3 FROM b2), b4 AS (SELECT instrument, y_true, s, CAST(((z3 * z3 + s) % 2147483647) * n // 2147483647 AS BIGINT) AS k FROM b3), b5 AS (SELECT b4.instrument, b4.y_true, s, avg(r) AS m FROM b4 JOIN bv USING (instrument, y_true, k) GROUP BY ALL), b6 AS (SELECT instrument, s, max(m) FILTER (y_true = 1) AS g, max(m) FILTER (y_true = 0) AS b FROM b5 GROUP BY ALL), b7 AS (SELECT *, CASE WHEN g > b THEN greatest(0, least(1, -b / (g - b))) END AS t FROM b6) SELECT instrument, count(t) AS samples, round(quantile_cont(t, 0.5), 6) AS median, round(quantile_cont(t, 0.05), 6) AS pct5, round(quantile_cont(t, 0.95), 6) AS pct95 FROM b7 GROUP BY instrument",
    "threshold_sweep": f"WITH RECURSIVE {PRED}, tt AS (SELECT round(0.05::DOUBLE + i * (0.9::DOUBLE / 36), 10) AS threshold FROM range(37) z(i)), f AS (SELECT instrument, threshold, count(*) AS n, count(*) FILTER (prediction >= threshold) AS k, coalesce(2.0::DOUBLE * count(*) FILTER (prediction >= threshold AND y_true = 1) / (count(*) FILTER (prediction >= threshold) + count(*) FILTER (y_true = 1)), 0) AS f1 FROM pr, tt GROUP BY instrument, threshold), h AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY f1 DESC, threshold) AS q FROM f WHERE k > 0 AND k < n) SELECT instrument, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM h WHERE q = 1",
    "nav_drawdown": f"WITH RECURSIVE {_NAV} SELECT instrument, date, {_r('primary_return', 'meta_return', 'primary_nav', 'meta_nav', 'primary_drawdown', 'meta_drawdown')} FROM nc",
    "nav_summary": f"WITH RECURSIVE {_NAV}, ns AS (SELECT instrument, date, 'primary' AS strategy, primary_return AS ret, primary_nav AS nav, primary_drawdown AS dd FROM nc UNION ALL SELECT instrument, date, 'meta', meta_return, meta_nav, meta_drawdown FROM nc) SELECT instrument, strategy, count(*) FILTER (ret <> 0) AS n_trades, round(avg(ret), 6) + 0.0 AS mean_event_return, round(max_by(nav, date) - 1, 6) + 0.0 AS total_profit, round({_sh('ret', 'sqrt(25.2::DOUBLE)')}, 6) + 0.0 AS annualised_sharpe, round(min(dd), 6) + 0.0 AS max_drawdown FROM ns GROUP BY instrument, strategy",
    "return_diagnostics": f"WITH RECURSIVE {PRED} SELECT instrument, count(*) AS n_events, round(avg(CAST(prediction >= 0.5 AS INTEGER)), 6) AS take_rate, round(avg(signed_touch_return), 6) + 0.0 AS mean_primary_return, round(avg(CASE WHEN prediction >= 0.5 THEN signed_touch_return ELSE 0 END), 6) + 0.0 AS mean_meta_return, round(sum(signed_touch_return), 6) + 0.0 AS total_primary_return, round(sum(CASE WHEN prediction >= 0.5 THEN signed_touch_return ELSE 0 END), 6) + 0.0 AS total_meta_return FROM pr GROUP BY instrument",
    "trading_metrics": f"WITH RECURSIVE {_TRADE} SELECT instrument, count(r) AS n_trades, round(avg(r) * 252, 6) + 0.0 AS ann_return, round(stddev_samp(r) * sqrt(252.0::DOUBLE), 6) AS ann_vol, round(avg(r) / stddev_samp(r) * sqrt(252.0::DOUBLE), 6) + 0.0 AS sharpe, round((avg(r) - 0.002) / stddev_samp(r) * sqrt(252.0::DOUBLE), 6) + 0.0 AS sharpe_tc, round(min(dd), 6) + 0.0 AS max_drawdown, round(avg(CASE WHEN r IS NOT NULL THEN CAST(r > 0 AS INTEGER) END), 6) AS hit_rate, round(count(r) / count(*)::DOUBLE, 6) AS turnover FROM td GROUP BY instrument",
    "candidate_summary": f"WITH RECURSIVE {_OOF}{_metrics('oof', 'instrument, split_id', 'y_proba')} SELECT instrument, round(avg(roc_auc), 6) AS mean_auc, round(quantile_cont(roc_auc, 0.5), 6) AS median_auc, round(stddev_samp(roc_auc), 6) AS std_auc, count(roc_auc) AS n_folds FROM mm GROUP BY instrument",
    "oof_average": f"WITH RECURSIVE {_OOF} SELECT instrument, date, min(y_true) AS y_true, round(min(signed_touch_return), 6) + 0.0 AS signed_touch_return, round(avg(y_proba), 6) AS y_proba, count(*) AS n_folds FROM oof GROUP BY instrument, date",
    "ewma_ann_vol": f"WITH RECURSIVE {_VOL} SELECT date, instrument, round(annualized_ewma_vol, 6) AS annualized_ewma_vol FROM av",
    "sizing": f"WITH RECURSIVE {PRED} SELECT instrument, date, CASE WHEN prediction <= 0.5 THEN 0.0 ELSE 1.0 END AS all_or_nothing, round(CASE WHEN prediction <= 0.5 THEN 0.0 ELSE prediction END, 6) AS model_confidence, round(CASE WHEN prediction <= 0.5 THEN 0.0 ELSE {NCDF} END, 6) AS ncdf FROM pr",
    "allocation": f"WITH RECURSIVE {_alloc(1.0)} SELECT date, instrument, primary_signal, {_r('prediction', 'size', 'annualized_ewma_vol', 'raw_weight', 'capped_weight', 'weight')} FROM fx",
    "gross_cap": f"WITH RECURSIVE {_alloc(0.2)} SELECT date, instrument, {_r('capped_weight', 'weight')} FROM fx",
    "weights_compare": f"WITH RECURSIVE {_ALIGN} SELECT date, instrument, same_sign, {_r('fixed_weight', 'neural_weight', 'next_return', 'weight_diff', 'fixed_pnl', 'neural_pnl')} FROM ag",
    "strategy_summary": _strategy("avg"),
    "strategy_summary_portfolio": _strategy("sum"),
    "instrument_summary": f"WITH RECURSIVE {_ALIGN} SELECT instrument, count(*) AS rows, round(avg(abs(fixed_weight)), 6) AS fixed_mean_abs_weight, round(avg(abs(neural_weight)), 6) AS neural_mean_abs_weight, round(avg(weight_diff), 6) + 0.0 AS mean_weight_diff, round(avg(abs(weight_diff)), 6) AS mean_abs_weight_diff, round(avg(CAST(same_sign AS INTEGER)), 6) AS same_sign_rate, round(covar_samp(fixed_weight, neural_weight) / (stddev_samp(fixed_weight) * stddev_samp(neural_weight)), 6) + 0.0 AS weight_correlation FROM ag GROUP BY instrument",
    "daily_panel": f"WITH RECURSIVE {_ALIGN}, dp AS (SELECT date, sum(abs(fixed_weight)) AS fixed_gross, sum(abs(neural_weight)) AS neural_gross, sum(fixed_weight) AS fixed_net, sum(neural_weight) AS neural_net, avg(fixed_pnl) AS fixed_pnl, avg(neural_pnl) AS neural_pnl FROM ag GROUP BY date) SELECT date, {_r('fixed_gross', 'neural_gross', 'fixed_net', 'neural_net', 'fixed_pnl', 'neural_pnl')} FROM dp",
}
