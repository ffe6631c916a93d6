import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barforge.operators import regimes
from barforge.plans.technical import bars_of
from barforge.sources import files
from barforge.streaming.bars import event_bars, filter_stream


def test_csv_round_trip_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 1.5), (dt.date(2020, 1, 2), "B", None)], "date date, instrument string, v double")
    files.write_projected(df, f"{tmp_path}/t", ["date", "instrument", "v"], "csv")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/t", "date date, instrument string, v double").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert files.read_csv(spark, f"{tmp_path}/t").schema["date"].dataType.typeName() == "date" and files.header(spark, f"{tmp_path}/t") == ["date", "instrument", "v"]
    with pytest.raises(ValueError):
        files.write_projected(df, f"{tmp_path}/u", ["nope"])
    assert files.first_existing(spark, f"{tmp_path}/none", f"{tmp_path}/t") == f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, f"{tmp_path}/none")


def test_named_files_fan_out_and_json(spark, tmp_path):
    for name in ("cl1s_ewma_10d_tp2_sl2.csv", "cl1s_rolling_5d_tp2.csv", "ng1s_ewma_5d_tp2.csv"):
        (tmp_path / name).write_text("date,v\n2020-01-01,1\n")
    got = {(r["config"], r["file_num_days"]) for r in files.read_named(spark, str(tmp_path), "cl1s", "date date, v int").collect()}
    assert got == {("ewma_10d_tp2_sl2", 10), ("rolling_5d_tp2", 5)}
    df = spark.createDataFrame([(1, "x", None, "y")], "a int, b string, c string, c_tb string")
    files.fan_out(df, f"{tmp_path}/out", {"one": ["a"], "two": ["b", "a"]})
    assert spark.read.parquet(f"{tmp_path}/out/two").columns == ["b", "a"]
    assert files.summary_json(df.select("a", F.struct("b").alias("s"))) == '{"a": 1, "s": {"b": "x"}}'
    assert files.coalesced(df).first()["c"] == "y"
    left, right = df.select("a", "b", F.lit(None).cast("string").alias("c")), df.select("a", "b", F.lit("z").alias("c"))
    both = files.joined(left, right, "a")
    assert both.columns == ["a", "b", "c", "b_tb", "c_tb"] and files.coalesced(both).first().asDict() == {"a": 1, "b": "x", "c": "z"}
    calls = []
    for _ in range(2):
        files.build_or_load(spark, f"{tmp_path}/m", lambda: calls.append(1) or df.select("a")).count()
    assert len(calls) == 1
    files.write_partitioned(df.select("a", "b"), f"{tmp_path}/p", "b")
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["a", "b"]
    assert files.with_json(spark.createDataFrame([('{"k": [1]}',), ("bad",)], "j string"), "j", "k array<int>").collect()[0]["j"]["k"] == [1]


def test_event_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = event_bars(stream).writeStream.outputMode("complete").format("memory").queryName("event_bars_test").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("event_bars_test").collect()), key=str) == sorted(map(tuple, event_bars(events).collect()), key=str)


def test_filter_stream_leaves_out_nulls_and_late_rows(spark, tmp_path):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [("A", day(i), 0.01 * ((i * 7) % 5 - 2)) for i in range(20)]
    parts = [[*rows[:8], ("A", day(100), None)], [*rows[8:15], ("A", day(3), 0.5), rows[10]], rows[15:]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "instrument string, date date, ret_1d double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("instrument string, date date, ret_1d double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = filter_stream(stream).writeStream.outputMode("append").format("memory").queryName("late_test").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("late_test").orderBy("date").toPandas()
    want = regimes.filter_fixed(spark.createDataFrame(rows, "instrument string, date date, ret_1d double")).orderBy("date").toPandas()
    assert got["date"].tolist() == want["date"].tolist()
    np.testing.assert_allclose(got["p0"], want["hmm_regime_prob_0"])


def test_command_line(spark, tmp_path):
    from barforge.__main__ import main
    from barforge.operators.technical import FEATURES

    lines = ["date,instrument,open,high,low,close,volume,open_interest"] + [f"2020-{1 + i // 28:02}-{1 + i % 28:02},X,{100 + i},{102 + i},{99 + i},{101 + i % 7 + i},10,5" for i in range(60)]
    (tmp_path / "bars.csv").write_text("\n".join(lines) + "\n")
    assert main([str(tmp_path / "bars.csv"), f"{tmp_path}/out", "--format", "parquet"]) == 0
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 60 and out.columns == ["date", "instrument", *FEATURES]


def test_short_instruments_keep_their_rows(spark):
    obs = spark.createDataFrame([(dt.date(2020, 1, 1 + i), "X", *[0.01 * i] * 6) for i in range(20)], "date date, instrument string, " + ", ".join(f"{c} double" for c in regimes.OBSERVATIONS))
    out = regimes.detect(obs, "2020-01-15").collect()
    assert len(out) == 20 and all(r["hmm_predicted_regime"] is None and r["hmm_regime_prob_0"] is None for r in out)


def test_filter_stream_equals_batch(spark, sf_dir, tmp_path):
    obs = regimes.observations(bars_of(spark, sf_dir).where("instrument = 'A' and date < '1993-06-01'")).na.drop(subset=["ret_1d"]).select("instrument", "date", "ret_1d")
    rows = obs.orderBy("date").collect()
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, obs.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = filter_stream(stream).writeStream.outputMode("append").format("memory").queryName("filter_test").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("filter_test").orderBy("date").toPandas()
    want = regimes.filter_fixed(obs).orderBy("date").toPandas()
    np.testing.assert_allclose(got["p0"], want["hmm_regime_prob_0"])
