"""Queries of signals and labels, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import signals as sg
from ..sources.bars import signals_from_bars, signals_wide
from . import oracle as o
from .technical import bars_of, rounded

INSTRUMENTS = ["A", "N", "R"]


def signals_of(spark, sf_dir):
    return signals_from_bars(bars_of(spark, sf_dir)).where("primary_signal is not null")


def _signals_long(spark, sf_dir):
    wide = signals_wide(signals_of(spark, sf_dir), INSTRUMENTS)
    return sg.unpivot_signals(wide)


def _behaviour(spark, sf_dir):
    return rounded(sg.signal_behaviour(signals_of(spark, sf_dir)))


def _market(spark, sf_dir):
    return rounded(sg.market_features(bars_of(spark, sf_dir)))


def _spans(spark, sf_dir):
    return sg.spans(signals_of(spark, sf_dir), "primary_signal")


def _switches(spark, sf_dir):
    return sg.switches(signals_of(spark, sf_dir), "primary_signal")


def _active(spark, sf_dir):
    return sg.active_instruments(signals_of(spark, sf_dir))


def _value_counts(spark, sf_dir):
    return sg.value_counts(signals_of(spark, sf_dir), "primary_signal")


def _duplicates(spark, sf_dir):
    return sg.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_linenumber")


def _catalog(spark, sf_dir):
    return sg.mapping_catalog(spark)


def _labels(method):
    def query(spark, sf_dir):
        bars = bars_of(spark, sf_dir)
        out = lb.label_pipeline(bars, signals_from_bars(bars), lb.Config(method, method), "1998-07-01")
        return rounded(out)

    return query


def _sweep(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    return rounded(lb.sweep_summary(lb.label_sweep(bars, signals_from_bars(bars))))


def _highlow(spark, sf_dir):
    return rounded(lb.label_high_low(bars_of(spark, sf_dir)))


def _balance(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    labels = lb.label_sweep(bars, signals_from_bars(bars))
    b = lb.barrier_balance(labels, ["instrument", "config_name"])
    return rounded(lb.best_balanced(b, ["instrument"], "config_name"))


def _forward(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    priced = bars.join(signals_from_bars(bars), ["date", "instrument"])
    side = F.coalesce(F.col("primary_signal"), F.lit(0)).cast("double")
    return rounded(priced.select("date", "instrument", *[lb.forward_signed_return(bars, h, side).alias(f"fwd_{h}d") for h in (5, 10, 20)], F.lead("close", 5).over(lb.by_date()).alias("close_5")))


QUERIES = {
    "signals_long": _signals_long, "signal_behaviour": _behaviour, "market_features": _market, "signal_spans": _spans, "signal_switches": _switches, "active_instruments": _active, "value_counts": _value_counts,
    "duplicate_keys": _duplicates, "mapping_catalog": _catalog, **{f"labels_{m}": _labels(m) for m in ("ewma", "rolling", "parkinson", "garman_klass")}, "label_sweep_summary": _sweep, "labels_highlow": _highlow,
    "barrier_param_balance": _balance, "forward_returns": _forward,
}

_r5 = f"close / nullif({o.lag('close', 5)}, 0) - 1"
_SIG0 = f", s0 AS (SELECT date, instrument, {_r5} AS r5 FROM bars), sall AS (SELECT date, instrument, CASE WHEN r5 > 0.01 THEN 1 WHEN r5 < -0.01 THEN -1 WHEN r5 IS NOT NULL THEN 0 END AS primary_signal FROM s0), sig AS (SELECT * FROM sall WHERE primary_signal IS NOT NULL)"
SIG = o.BARS + _SIG0
RUN_CTE = f", c AS (SELECT *, CASE WHEN row_number() OVER ({o.W}) = 1 THEN 0 WHEN primary_signal = {o.lag('primary_signal')} THEN 0 ELSE 1 END AS chg FROM sig), g AS (SELECT *, sum(chg) OVER ({o.W}) AS run FROM c)"
_RUN = SIG + RUN_CTE


def vols(where: str = "") -> str:
    """bars, signals and ``v``: bars before ``where`` with the four volatilities and the signal."""
    cut = f", b0 AS (SELECT *, row_number() OVER ({o.W}) AS rn, ln(close / {o.lag('close')}) AS lr, pow(ln(high / low), 2) / (4 * ln(2)) AS hl2, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS gk FROM bars {where})"
    ew = ", " + o.ewm_stds("b0", "ew", "lr", {"vol_ewma": (2 / 101, 100, True)})
    root = lambda x: f"CASE WHEN ({o.agg('avg', x, 20)}) >= 0 THEN sqrt({o.agg('avg', x, 20)}) END"
    v = f", v0 AS (SELECT *, {o.agg('stddev_samp', 'lr', 20)} AS vol_rolling, {root('hl2')} AS vol_parkinson, {root('gk')} AS vol_garman_klass FROM b0), v AS (SELECT v0.*, vol_ewma, primary_signal FROM v0 JOIN ew USING (instrument, rn) LEFT JOIN sall s USING (instrument, date))"
    return SIG + cut + ew + v


def events_sql(vol: str, days: str, tp: str, sl: str, source: str = "v", more: str = "") -> str:
    """``ev``: events with barriers, time-out and first touch, by a join of events with the bars ahead."""
    return f""", e1 AS (
  SELECT x.*, {vol} AS vol, close * (1 + primary_signal * {tp} * {vol}) AS tp, close * (1 - primary_signal * {sl} * {vol}) AS sl FROM {source} x
  WHERE primary_signal IN (-1, 1) AND {vol} IS NOT NULL
), e2 AS (
  SELECT e1.*, b.date AS timeout_date, b.close AS timeout_close FROM e1 JOIN b0 b ON b.instrument = e1.instrument AND b.rn = e1.rn + {days}
), th AS (
  SELECT e2.instrument, e2.rn {more}, min(b.rn) AS hit FROM e2 JOIN b0 b ON b.instrument = e2.instrument AND b.rn > e2.rn AND b.rn <= e2.rn + {days}
  WHERE b.close >= greatest(e2.tp, e2.sl) OR b.close <= least(e2.tp, e2.sl) GROUP BY e2.instrument, e2.rn {more}
)"""


TOUCH = """, ev AS (
  SELECT e2.*, coalesce(b.date, timeout_date) AS touch_date, coalesce(b.close, timeout_close) AS touch_price,
         CASE WHEN b.close IS NULL THEN 'timeout' WHEN b.close >= greatest(tp, sl) THEN 'upper' ELSE 'lower' END AS touched_barrier
  FROM e2 LEFT JOIN th USING (instrument, rn{more}) LEFT JOIN b0 b ON b.instrument = e2.instrument AND b.rn = th.hit
), ez AS (
  SELECT *, CASE touched_barrier WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END AS triple_barrier_label, touch_price / close - 1 AS raw_touch_return,
         (touch_price / close - 1) * primary_signal AS signed_touch_return, CAST((touch_price / close - 1) * primary_signal > 0 AS INTEGER) AS metalabel, date_diff('day', date, touch_date) AS holding_period_days FROM ev
)"""


def _label_sql(m: str) -> str:
    cte = vols("WHERE date < DATE '1998-07-01'") + events_sql(f"vol_{m}", "10", "2.0", "2.0") + TOUCH.replace("{more}", "")
    return f"""WITH RECURSIVE {cte} SELECT instrument, instrument AS signal_column, DATE '1998-07-01' AS training_end, date, round(close, 6) AS close, primary_signal, round(vol, 6) AS vol, round(tp, 6) AS tp, round(sl, 6) AS sl,
  timeout_date, round(timeout_close, 6) AS timeout_close, touch_date, round(touch_price, 6) AS touch_price, touched_barrier, triple_barrier_label, metalabel, '{m}' AS volatility_method, 100 AS ewma_span, 20 AS volatility_window,
  10 AS num_days, 2.0::DOUBLE AS take_profit_mult, 2.0::DOUBLE AS stop_loss_mult, CAST(holding_period_days AS INTEGER) AS holding_period_days, round(raw_touch_return, 6) + 0.0 AS raw_touch_return, round(signed_touch_return, 6) + 0.0 AS signed_touch_return FROM ez"""


_GRID = ", ".join(f"('{c.config_name}', '{c.volatility_method}', {c.num_days}, {c.take_profit_mult}::DOUBLE, {c.stop_loss_mult}::DOUBLE)" for c in lb.SWEEP)
SWEEP_CTE = (
    vols()
    + f", cf AS (SELECT * FROM (VALUES {_GRID}) z(config_name, method, days, tpm, slm)), vc AS (SELECT v.*, cf.*, CASE method WHEN 'ewma' THEN vol_ewma WHEN 'rolling' THEN vol_rolling WHEN 'parkinson' THEN vol_parkinson ELSE vol_garman_klass END AS the_vol FROM v, cf)"
    + events_sql("the_vol", "e2.days", "tpm", "slm", "vc", ", config_name").replace("e1.rn + e2.days", "e1.rn + e1.days").replace("e2.rn , config_name", "e2.rn, e2.config_name")
    + TOUCH.replace("{more}", ", config_name")
)
_SUMMARY = """SELECT instrument, config_name, count(*) AS rows, count(*) FILTER (metalabel = 0) AS metalabel_0_count, count(*) FILTER (metalabel = 1) AS metalabel_1_count, round(avg(metalabel), 6) AS metalabel_1_rate,
  count(*) FILTER (triple_barrier_label = -1) AS tb_label_neg1_count, count(*) FILTER (triple_barrier_label = 0) AS tb_label_0_count, count(*) FILTER (triple_barrier_label = 1) AS tb_label_1_count,
  round(avg(holding_period_days), 6) AS avg_holding_period_days FROM ez GROUP BY instrument, config_name"""
_HL = (
    o.BARS
    + f", b0 AS (SELECT *, row_number() OVER ({o.W}) AS rn, close / {o.lag('close')} - 1 AS ret FROM bars), "
    + o.ewm_stds("b0", "ew", "ret", {"vol": (2 / 21, 10, True)})
    + """, h AS (SELECT b0.*, vol, close * (1 + 2.0 * vol) AS upper, close * (1 - 2.0 * vol) AS lower FROM b0 JOIN ew USING (instrument, rn)
), t2 AS (SELECT h.instrument, h.rn, min(b.rn) AS hit FROM h JOIN b0 b ON b.instrument = h.instrument AND b.rn > h.rn AND b.rn <= h.rn + 10 WHERE b.high >= h.upper OR b.low <= h.lower GROUP BY h.instrument, h.rn)"""
)
MARKET_CTE = ", q AS (SELECT *, close / prev - 1 AS ret, CASE WHEN volume > 0 THEN volume END AS vp, CASE WHEN open_interest > 0 THEN open_interest END AS op FROM p)"
MARKET = {
    "volume_log_change": f"ln(vp) - ln({o.lag('vp')})", "open_interest_log_change": f"ln(op) - ln({o.lag('op')})", **{f"{x}_zscore_{n}d": o.zscore(x, n) for x in ("volume", "open_interest") for n in (20, 63)},
    "volume_to_open_interest": o.div("volume", "open_interest"), "range_pct": "(high - low) / close", "body_pct": "(close - open) / open", "upper_wick_pct": "(high - greatest(open, close)) / close",
    "lower_wick_pct": "(least(open, close) - low) / close", "close_position_in_bar": o.div("close - low", "high - low"), "gap_open_pct": "open / prev - 1", "vol_20d_for_interaction": o.agg("stddev_samp", "ret", 20),
}
_fwd = lambda h: f"coalesce(100 * coalesce(primary_signal, 0)::DOUBLE * ({o.lead('close', h)} / close - 1), 0.0)"

ORACLES = {
    "signals_long": f"WITH {SIG}, dd AS (SELECT DISTINCT date FROM sig), ii AS (SELECT unnest(['A', 'N', 'R']) AS instrument) SELECT dd.date, lower(ii.instrument) AS instrument, primary_signal FROM dd CROSS JOIN ii LEFT JOIN sig ON sig.date = dd.date AND sig.instrument = ii.instrument",
    "signal_behaviour": f"WITH {_RUN} SELECT date, instrument, chg AS signal_changed, CAST(row_number() OVER (PARTITION BY instrument, run ORDER BY date) - 1 AS INTEGER) AS days_since_signal_change, round({o.agg('avg', 'primary_signal', 5, 1)}, 6) + 0.0 AS signal_rolling_mean_5d, round({o.agg('avg', 'primary_signal', 20, 1)}, 6) + 0.0 AS signal_rolling_mean_20d, CAST({o.agg('sum', 'abs(primary_signal)', 20, 1)} AS DOUBLE) AS signal_abs_rolling_sum_20d FROM g",
    "market_features": o.select(o.PREPARED + MARKET_CTE, "q", MARKET),
    "signal_spans": f"WITH {_RUN} SELECT instrument, min(primary_signal) AS primary_signal, min(date) AS start_date, max(date) AS end_date, count(*) AS rows FROM g GROUP BY instrument, run",
    "signal_switches": f"WITH {_RUN} SELECT instrument, count(*) AS rows, CAST(sum(chg) AS BIGINT) AS switches FROM g GROUP BY instrument",
    "active_instruments": f"WITH {SIG} SELECT instrument, count(*) AS rows, min(date) AS min_date, max(date) AS max_date, count(*) FILTER (primary_signal <> 0) AS active_signals FROM sig GROUP BY instrument",
    "value_counts": f"WITH {SIG} SELECT primary_signal, count(*) AS n FROM sig GROUP BY primary_signal",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "mapping_catalog": "SELECT s AS source_column, s || '_code' AS encoded_column, v AS category_label, CAST(i AS INTEGER) AS numeric_value, k AS mapping_type FROM (VALUES " + ", ".join(f"('{s}', '{v}', {i}, '{k}')" for s, labels, k in (("hmm_volatility_regime", sg.VOLATILITY_LABELS, "ordered"), ("hmm_return_regime", sg.RETURN_LABELS, "ordered"), ("hmm_market_state", sg.MARKET_LABELS, "nominal")) for i, v in enumerate(labels)) + ") z(s, v, i, k)",
    **{f"labels_{m}": _label_sql(m) for m in ("ewma", "rolling", "parkinson", "garman_klass")},
    "label_sweep_summary": f"WITH RECURSIVE {SWEEP_CTE} {_SUMMARY}",
    "labels_highlow": f"WITH RECURSIVE {_HL} SELECT h.date, h.instrument, round(h.close, 6) AS close, round(vol, 6) AS vol, round(upper, 6) AS upper, round(lower, 6) AS lower, CASE WHEN vol IS NULL OR e.rn IS NULL OR hit IS NULL THEN 0 WHEN b.high >= upper THEN 1 ELSE -1 END AS label, CASE WHEN vol IS NOT NULL AND e.rn IS NOT NULL THEN coalesce(b.date, e.date) END AS t1 FROM h LEFT JOIN t2 USING (instrument, rn) LEFT JOIN b0 b ON b.instrument = h.instrument AND b.rn = hit LEFT JOIN b0 e ON e.instrument = h.instrument AND e.rn = h.rn + 10",
    "barrier_param_balance": f"WITH RECURSIVE {SWEEP_CTE}, bl AS (SELECT instrument, config_name, count(*) AS rows, avg(metalabel) AS p FROM ez GROUP BY ALL), bm AS (SELECT *, 1 - 2 * abs(p - 0.5) AS balance FROM bl), bn AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY balance DESC NULLS LAST, config_name) AS n FROM bm) SELECT instrument, config_name, rows, round(p, 6) AS p, round(balance, 6) AS balance FROM bn WHERE n = 1",
    "forward_returns": f"WITH {SIG} SELECT date, instrument, {', '.join(f'round({_fwd(h)}, 6) + 0.0 AS fwd_{h}d' for h in (5, 10, 20))}, round({o.lead('close', 5)}, 6) AS close_5 FROM bars JOIN sall USING (date, instrument)",
}
