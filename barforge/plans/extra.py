"""Queries beyond the bars: windows over events, the batch form of the stream, small relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import logsumexp, sigmoid
from ..functions.windows import finite
from ..operators import candidates as cd
from ..operators import cpcv, shape
from ..operators import labels as lb
from ..operators import metrics as mt
from ..operators import selection as sl
from ..operators import signals as sg
from ..operators import technical as ta
from ..sources import files
from ..sources.bars import BARS, signals_from_bars
from ..streaming.bars import event_bars
from . import oracle as o
from .candidates import _CPCV, oof_of
from .evaluation import _OV, EVENTS, _blocked, _combos, _metrics, _role, events_of
from .labelling import SIG
from .modelling import _CORR, _PREP, _rounded_features, star_of
from .technical import bars_of, rounded


def _event_bars(spark, sf_dir):
    out = event_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rounded(out.withColumn("start", F.to_date("start")))


def _pivot(spark, sf_dir):
    df = signals_from_bars(bars_of(spark, sf_dir)).where("primary_signal is not null").withColumn("s", F.when(F.col("primary_signal") < 0, "short").when(F.col("primary_signal") > 0, "long").otherwise("flat"))
    return shape.pivot_counts(df, "instrument", "s", ["short", "flat", "long"])


def _mode(spark, sf_dir):
    return shape.mode_by(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_linenumber")


def _even(spark, sf_dir):
    return shape.evenly_spaced(events_of(spark, sf_dir).select("instrument", "date", "metalabel"), 12)


def _grid(spark, sf_dir):
    return shape.grid(spark, horizon=[5, 10, 20], take_profit=[1.0, 1.5, 2.0], stop_loss=[1.0, 1.5, 2.0])


def _clip(spark, sf_dir):
    bars = bars_of(spark, sf_dir).withColumn("r", F.try_divide("close", F.lag("close").over(lb.by_date())) - 1)
    return rounded(shape.clip_to(bars.select("date", "instrument", "r"), bars.where("date < '1996-01-01'"), ["r"]))


def _flags(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    flagged = shape.issue_flags(bars, flat=F.col("high") == F.col("low"), thin=F.col("open_interest") < 2, large=F.col("volume") > 100)
    return flagged.select("date", "instrument", "issues")


def _csv(spark, sf_dir):
    """Bars through a CSV, read back with their schema."""
    at = files.passing_folder(spark)
    bars = bars_of(spark, sf_dir)
    files.write_projected(bars, at, bars.columns, "csv")
    return rounded(files.read_csv(spark, at, BARS))


def _untyped(spark, sf_dir):
    """Bars through a CSV with a text among its numbers, read back as text: dates parsed, numbers tried."""
    at = files.passing_folder(spark)
    bars = bars_of(spark, sf_dir).withColumn("volume", F.when(F.col("volume") > 100, F.lit("n/a")).otherwise(F.col("volume").cast("string")))
    files.write_projected(bars, at, ["date", "instrument", "close", "volume"], "csv")
    back = files.read_csv(spark, files.first_existing(spark, f"{at}/none", at))
    assert files.header(spark, at) == back.columns
    return rounded(sl.numbers(back, "close", "volume"))


def _named(spark, sf_dir):
    """Labels of two configurations as named files, read back with what their names say."""
    at = files.passing_folder(spark)
    bars = bars_of(spark, sf_dir)
    signals = signals_from_bars(bars)
    for c in (lb.SWEEP[1], lb.SWEEP[3]):
        labels = lb.label_pipeline(bars, signals, c, columns=["date", "instrument", "metalabel"])
        labels.write.csv(f"{at}/own_{c.config_name}.csv", header=True)
    found = files.read_named(spark, at, "own", "date date, instrument string, metalabel int", "*.csv/*.csv", up=1)
    return found.groupBy("config", "file_num_days").agg(F.count("*").alias("rows"), F.sum("metalabel").alias("positives"))


def _loaded(spark, sf_dir):
    """Monthly closes, built and written once and loaded after that; written by instrument and read back."""
    at = files.passing_folder(spark)
    month = lambda: bars_of(spark, sf_dir).groupBy("instrument", F.date_format("date", "yyyy-MM").alias("month")).agg(F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
    files.build_or_load(spark, f"{at}/built", month)
    files.write_partitioned(files.build_or_load(spark, f"{at}/built", lambda: 1 / 0), f"{at}/parts", "instrument")
    back = spark.read.parquet(f"{at}/parts")
    return rounded(back.select(F.col("instrument").cast("string").alias("instrument"), "month", "close", "volume"))


def _fanned(spark, sf_dir):
    """Two tables of one frame, and a summary of them as JSON, read again."""
    at = files.passing_folder(spark)
    files.fan_out(bars_of(spark, sf_dir), at, {"prices": ["date", "instrument", "close"], "sizes": ["date", "instrument", "volume"]})
    both = spark.read.parquet(f"{at}/prices").join(spark.read.parquet(f"{at}/sizes"), ["date", "instrument"])
    one = files.summary_json(both.agg(F.count("*").alias("rows"), F.round(F.avg("close"), 6).alias("close"), F.sum("volume").alias("volume"), F.count_distinct("instrument").alias("instruments")))
    back = files.with_json(spark.createDataFrame([(one,)], "summary string"), "summary", "rows long, close double, volume double, instruments long")
    return rounded(back.select("summary.*"))


def _dated(spark, sf_dir):
    """Events with their date as text, a composite key and the settings as JSON."""
    e = events_of(spark, sf_dir).select("instrument", "date", "primary_signal", "metalabel")
    e = files.dated(e.withColumn("month", F.date_format("date", "yyyy-MM")))
    return files.json_rows(e.withColumn("event", files.composite_key("instrument", "date")), "event", "date", "month")


def _scalars(spark, sf_dir):
    """Sigmoid, log-sum-exp, finite values, missing names and coalesced columns of bars."""
    b = bars_of(spark, sf_dir)
    b = b.withColumns({"thin": F.when(F.col("volume") > 30, F.col("close")), "thin_tb": F.col("open"), "gone": F.when(F.col("open_interest") > 1, 1.0)})
    out = files.coalesced(shape.missing_names(b, ["thin", "gone"]))
    ratio = F.col("close").cast("double") / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return rounded(out.select("date", "instrument", "missing", "thin", sigmoid((F.col("close") - 100) / 10).alias("sig"), logsumexp(F.array(*[F.col(c) / 100 for c in ("open", "high", "low", "close")])).alias("lse"), finite(ratio).alias("ratio")))


def _sets(spark, sf_dir):
    """Events on days without a thin bar, and those on days with one, by instrument."""
    e, thin = events_of(spark, sf_dir), bars_of(spark, sf_dir).where("open_interest < 3")
    tag = lambda df, k: df.select("instrument", "date", F.lit(k).alias("kind"))
    both = tag(shape.present(e, thin, "instrument", "date"), "thin").unionByName(tag(shape.absent(e, thin, "instrument", "date"), "wide"))
    return both.groupBy("instrument", "kind").agg(F.count("*").alias("n"), F.min("date").alias("first"))


def _validation(spark, sf_dir):
    m = star_of(spark, sf_dir)
    n = signals_from_bars(bars_of(spark, sf_dir)).where("primary_signal is not null").count()
    return sg.validation_vector(m, ["ret_5d", "vol_20d"], n).drop("columns")


def _catalog(spark, sf_dir):
    """Columns of bars and features by group, each in its first, with the place of each in its group."""
    cat = sg.feature_catalog(spark, {"raw": ("bars", ["open", "high", "low", "close", "volume"]), "technical": ("features", [*ta.FEATURES[:12], "close"]), "engineered": ("signals", ["ret_5d", "range_pct"])})
    return cat.withColumn("first_of_group", F.col("feature_name").isin([r["feature_name"] for r in sg.first_of_key(cat, "feature_group", "feature_name").collect()]))


def _buckets(spark, sf_dir):
    """High correlations between columns of the bars, features and candles, and what they speak of."""
    f = _rounded_features(spark, sf_dir).select("date", "instrument", "ret_5d", "vol_20d", "zscore_20d", "price_vs_sma20")
    b = bars_of(spark, sf_dir).select("date", "instrument", "open", "close", F.round((F.col("high") - F.col("low")) / F.col("close"), 6).alias("range_pct"))
    return rounded(sl.bucketed(sl.pair_correlations(f.join(b, ["date", "instrument"]), BUCKETS), 0.3))


BUCKETS = ["ret_5d", "vol_20d", "zscore_20d", "price_vs_sma20", "open", "close", "range_pct"]
MONTHLY = ["ret_5d", "vol_20d", "zscore_20d", "hl_range"]


def _kendall(spark, sf_dir):
    """Rank correlations of monthly means of features."""
    f = _rounded_features(spark, sf_dir)
    means = f.groupBy("instrument", F.date_format("date", "yyyy-MM").alias("month")).agg(*[F.round(F.avg(c), 4).alias(c) for c in MONTHLY])
    return rounded(sl.pair_correlations(means, MONTHLY, "kendall"))


def _best(spark, sf_dir):
    folds = mt.binary_metrics(oof_of(spark, sf_dir), ["candidate", "instrument", "split_id"], p="y_proba")
    return rounded(cd.best_of(folds, "candidate", "roc_auc"))


def _by_config(spark, sf_dir):
    out = cpcv.splits_by_config(events_of(spark, sf_dir), {"N": (4, 1, 5)})
    return out.select("instrument", "split_id", "pos", "block_id", "role")


QUERIES = {"csv_round_trip": _csv, "csv_untyped": _untyped, "named_files": _named, "built_and_partitioned": _loaded, "fan_out_summary": _fanned, "dated_events": _dated, "scalar_columns": _scalars, "event_sets": _sets, "validation_vector": _validation, "feature_catalog": _catalog, "correlation_buckets": _buckets, "corr_pairs_kendall": _kendall, "best_candidate": _best, "cpcv_splits_by_config": _by_config}
QUERIES |= {"event_bars": _event_bars, "pivot_counts": _pivot, "mode_by": _mode, "evenly_spaced": _even, "config_grid": _grid, "clip_to_train": _clip, "issue_flags": _flags}
_R = SIG + f", rr AS (SELECT date, instrument, close / {o.lag('close')} - 1 AS r FROM bars), qq AS (SELECT quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM rr WHERE date < DATE '1996-01-01')"
ORACLES = {
    "event_bars": "SELECT CAST(ts AS DATE) AS start, event_type, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "pivot_counts": f"WITH {SIG} SELECT instrument, count(*) FILTER (primary_signal < 0) AS short, count(*) FILTER (primary_signal = 0) AS flat, count(*) FILTER (primary_signal > 0) AS long FROM sig GROUP BY instrument",
    "mode_by": "WITH b AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS k FROM b) SELECT l_returnflag, l_linenumber AS mode FROM c WHERE k = 1",
    "evenly_spaced": f"WITH RECURSIVE {EVENTS}, en AS (SELECT *, row_number() OVER ({o.W}) - 1 AS pos, count(*) OVER (PARTITION BY instrument) AS n FROM evs), wt AS (SELECT DISTINCT instrument, CAST(floor(i * (n - 1) / 11.0::DOUBLE) AS BIGINT) AS pos FROM en, range(12) z(i)) SELECT instrument, date, metalabel FROM en JOIN wt USING (instrument, pos)",
    "config_grid": "SELECT CAST(h AS BIGINT) AS horizon, t AS take_profit, s AS stop_loss FROM (SELECT unnest([5, 10, 20]) AS h), (SELECT unnest([1.0::DOUBLE, 1.5, 2.0]) AS t), (SELECT unnest([1.0::DOUBLE, 1.5, 2.0]) AS s)",
    "clip_to_train": f"WITH {_R} SELECT date, instrument, CASE WHEN r IS NOT NULL THEN round(greatest(lo, least(hi, r)), 6) + 0.0 END AS r FROM rr, qq",
    "issue_flags": f"WITH {o.BARS} SELECT date, instrument, concat_ws(';', CASE WHEN high = low THEN 'flat' END, CASE WHEN open_interest < 2 THEN 'thin' END, CASE WHEN volume > 100 THEN 'large' END) AS issues FROM bars",
}
_v2 = lambda *cols: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)
_CATALOG = ([(c, "raw", "bars") for c in ("open", "high", "low", "close", "volume")], [(c, "technical", "features") for c in ta.FEATURES[:12]], [("range_pct", "engineered", "signals")])
_kp = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y, row_number() OVER (ORDER BY instrument, month) AS i FROM mo WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(MONTHLY) for b in MONTHLY[i + 1 :])
_bl = " UNION ALL ".join(f"SELECT date, instrument, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM bf" for c in BUCKETS)


def _family_sql(f: str) -> str:
    raw, made = (", ".join(f"'{c}'" for c in cols) for cols in (sl.RAW_MARKET, sl.ENGINEERED_MARKET))
    return f"CASE WHEN starts_with({f}, 'hmm_') OR contains({f}, '_hmm_') THEN 'hmm' WHEN {f} IN ({raw}) THEN 'raw_market' WHEN regexp_matches({f}, '{'|'.join(sl.TECHNICAL)}') THEN 'technical' WHEN {f} IN ({made}) THEN 'engineered_market' WHEN starts_with({f}, 'signal_') OR starts_with({f}, 'days_since_signal') THEN 'engineered_signal' ELSE 'other' END"


def _config_splits() -> str:
    from .evaluation import _DAYS

    parts = []
    for where, n, k in (("= 'N'", 4, 1), ("<> 'N'", 6, 2)):
        cte = _blocked(n) + _combos(n, k, 0) + _role(f"({_OV}) OR (bk.date > ts.l AND bk.date <= (SELECT emb FROM em WHERE em.instrument = ts.instrument AND em.date = ts.l))")
        parts.append(f"SELECT instrument, split_id, pos, block_id, role FROM (WITH {cte[2:]} SELECT * FROM rl) WHERE instrument {where}")
    return f"WITH RECURSIVE {EVENTS}{_DAYS} " + " UNION ALL ".join(parts)


def _named_sql() -> str:
    from .labelling import SWEEP_CTE

    return f"WITH RECURSIVE {SWEEP_CTE} SELECT config_name AS config, CAST(days AS INTEGER) AS file_num_days, count(*) AS rows, CAST(sum(metalabel) AS BIGINT) AS positives FROM ez WHERE config_name IN ('{lb.SWEEP[1].config_name}', '{lb.SWEEP[3].config_name}') GROUP BY config_name, days"


ORACLES |= {
    "csv_round_trip": f"WITH {o.BARS} SELECT date, instrument, {_v2('open', 'high', 'low', 'close', 'volume', 'open_interest')} FROM bars",
    "csv_untyped": f"WITH {o.BARS} SELECT date, instrument, {_v2('close')}, CASE WHEN volume <= 100 THEN round(volume, 6) END AS volume FROM bars",
    "named_files": _named_sql(),
    "built_and_partitioned": f"WITH {o.BARS} SELECT instrument, strftime(date, '%Y-%m') AS month, round(max_by(close, date), 6) AS close, round(sum(volume), 6) AS volume FROM bars GROUP BY ALL",
    "fan_out_summary": f"WITH {o.BARS} SELECT count(*) AS rows, round(avg(close), 6) AS close, round(sum(volume), 6) AS volume, count(DISTINCT instrument) AS instruments FROM bars",
    "dated_events": f"WITH RECURSIVE {EVENTS} SELECT concat_ws('__', instrument, strftime(date, '%Y-%m-%d')) AS event, strftime(date, '%Y-%m-%d') AS date, strftime(date, '%Y-%m') AS month, concat('{{\"instrument\":\"', instrument, '\",\"primary_signal\":', primary_signal, ',\"metalabel\":', metalabel, '}}') AS settings FROM evs",
    "scalar_columns": f"WITH {o.BARS} SELECT date, instrument, concat_ws(';', CASE WHEN NOT volume > 30 THEN 'thin' END, CASE WHEN NOT open_interest > 1 THEN 'gone' END) AS missing, round(CASE WHEN volume > 30 THEN close ELSE open END, 6) AS thin, round(1 / (1 + exp(-(close - 100) / 10)), 6) AS sig, round(high / 100 + ln(exp((open - high) / 100) + 1 + exp((low - high) / 100) + exp((close - high) / 100)), 6) AS lse, round(close / nullif(high - low, 0), 6) AS ratio FROM bars",
    "event_sets": f"WITH RECURSIVE {EVENTS}, tn AS (SELECT instrument, date FROM bars WHERE open_interest < 3) SELECT instrument, CASE WHEN tn.date IS NULL THEN 'wide' ELSE 'thin' END AS kind, count(*) AS n, min(evs.date) AS first FROM evs LEFT JOIN tn USING (instrument, date) GROUP BY ALL".replace("min(evs.date)", "min(date)").replace("tn.date IS NULL", "hit IS NULL").replace("SELECT instrument, date FROM bars WHERE", "SELECT instrument, date, 1 AS hit FROM bars WHERE"),
    "validation_vector": f"WITH {SIG} SELECT count(*) AS rows, min(date) AS date_min, max(date) AS date_max, count(DISTINCT instrument) AS instrument_count, 1 AS technical_feature_count, 1 AS missing_ta_columns, CAST(0 AS BIGINT) AS duplicate_date_instrument_keys, CAST(0 AS BIGINT) AS infinite_numeric_values, CAST(0 AS BIGINT) AS missing_close_rows, true AS keeps_signal_rows FROM sig",
    "feature_catalog": "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{g}', '{s}')" for part in _CATALOG for f, g, s in part) + ") z(feature_name, feature_group, source)) SELECT *, row_number() OVER (PARTITION BY feature_group ORDER BY feature_name) = 1 AS first_of_group FROM c",
    "correlation_buckets": f"WITH {_PREP}, bf AS (SELECT fe.*, p.open, p.close, round((p.high - p.low) / p.close, 6) AS range_pct FROM fe JOIN p USING (date, instrument)), bl AS ({_bl}), pq AS (SELECT x.feature AS a, y.feature AS b, x.value AS x, y.value AS y FROM bl x JOIN bl y USING (date, instrument) WHERE list_position({BUCKETS!r}, x.feature) < list_position({BUCKETS!r}, y.feature) AND x.value IS NOT NULL AND y.value IS NOT NULL), pc AS (SELECT a, b, count(*) AS n, {_CORR} AS corr FROM pq GROUP BY a, b), pf AS (SELECT *, {_family_sql('a')} AS a_family, {_family_sql('b')} AS b_family FROM pc WHERE abs(corr) >= 0.3) SELECT a, b, n, round(corr, 6) + 0.0 AS corr, a_family, b_family, CASE WHEN 'hmm' IN (a_family, b_family) THEN 'HMM duplicates/redundancies' WHEN a_family = 'technical' AND b_family = 'technical' THEN 'TA window variants' WHEN a_family = 'raw_market' AND b_family = 'raw_market' THEN 'Raw price-level correlations' WHEN 'technical' IN (a_family, b_family) AND 'engineered_market' IN (a_family, b_family) THEN 'Engineered-vs-technical overlaps' ELSE 'Other high-correlation pairs' END AS bucket FROM pf",
    "corr_pairs_kendall": f"WITH {_PREP}, mo AS (SELECT instrument, strftime(date, '%Y-%m') AS month, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in MONTHLY) + f" FROM fe GROUP BY ALL), kp AS ({_kp}), kc AS (SELECT p.a, p.b, sum(sign(p.x - q.x) * sign(p.y - q.y)) AS s, count(*) FILTER (p.x <> q.x) AS nx, count(*) FILTER (p.y <> q.y) AS ny FROM kp p JOIN kp q ON q.a = p.a AND q.b = p.b AND q.i < p.i GROUP BY p.a, p.b), kn AS (SELECT a, b, count(*) AS n FROM kp GROUP BY a, b) SELECT a, b, n, CASE WHEN n >= 20 THEN round(s / nullif(sqrt(nx::DOUBLE * ny), 0), 6) + 0.0 END AS corr FROM kc JOIN kn USING (a, b)",
    "best_candidate": f"WITH RECURSIVE {_CPCV}{_metrics('oo', 'candidate, instrument, split_id', 'y_proba')}, bm AS (SELECT candidate, avg(roc_auc) AS mean FROM mm GROUP BY candidate) SELECT candidate, round(mean, 6) AS mean FROM bm ORDER BY mean DESC, candidate LIMIT 1",
    "cpcv_splits_by_config": _config_splits(),
}
