"""Combinatorial purged cross-validation: blocks, purging, three embargo rules, stitched paths."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import by_date


def blocks(events: DataFrame, n: int = 8) -> DataFrame:
    """Events with pos (from 0) and block_id, n runs of equal length by date in each instrument, the first ones a row longer."""
    return events.withColumns({"pos": F.row_number().over(by_date()) - 1, "block_id": F.ntile(n).over(by_date()) - 1})


def _tests(blocked: DataFrame, n: int, k: int, first: int) -> DataFrame:
    """instrument, split_id and the test blocks of each split with their first and last dates, ends and positions."""
    spark = blocked.sparkSession
    combos = spark.createDataFrame([(first + i, list(c)) for i, c in enumerate(combinations(range(n), k))], "split_id int, ids array<int>")
    stats = blocked.groupBy("instrument", "block_id").agg(F.min("date").alias("start"), F.max("date").alias("last"), F.max("timeout_date").alias("end"), F.max("pos").alias("last_pos"), F.max("emb").alias("emb"))
    pairs = F.broadcast(combos.select("split_id", F.explode("ids").alias("block_id")))  # C(n, k) * k rows
    both = stats.join(pairs, "block_id")
    return both.groupBy("instrument", "split_id").agg(F.collect_list(F.struct("block_id", "start", "last", "end", "last_pos", "emb")).alias("tests"))


def _split(blocked: DataFrame, tests: DataFrame, drop) -> DataFrame:
    """Every event in every split as test or train; events that ``drop`` names, from the test blocks, are in neither."""
    both = blocked.join(tests, "instrument")
    test = F.exists("tests", lambda t: t["block_id"] == F.col("block_id"))
    out = both.withColumn("role", F.when(test, "test").when(~F.exists("tests", drop), "train"))
    return out.where("role is not null").select("instrument", "split_id", "pos", "block_id", "date", "role")


def _overlaps(t):
    return (F.col("date") <= t["end"]) & (F.col("timeout_date") >= t["start"])


def splits_by_rows(events: DataFrame, n: int = 8, k: int = 2, embargo: int = 10) -> DataFrame:
    """Variant A: training rows may not overlap a test block's span of labels, nor be among ``embargo`` rows after it.

    One row for each instrument, split (from 1), event and role: an equi-join with the C(n, k) splits of the instrument.
    """
    b = blocks(events, n).withColumn("emb", F.lit(None).cast("date"))
    return _split(b, _tests(b, n, k, 1), lambda t: _overlaps(t) | ((F.col("pos") > t["last_pos"]) & (F.col("pos") <= t["last_pos"] + embargo)))


def splits_by_dates(events: DataFrame, n: int = 6, k: int = 2, embargo: int = 5) -> DataFrame:
    """Variant B: as variant A, but the embargo is that many different dates after a test block's last one; splits from 0."""
    b = blocks(events, n)
    day = F.dense_rank().over(by_date())
    dates = b.select("instrument", "date", day.alias("day")).distinct()
    last = F.max("day").over(Window.partitionBy("instrument"))
    after = dates.withColumn("to", F.least(F.col("day") + embargo, last))
    ends = after.alias("a").join(dates.alias("b"), (F.col("a.instrument") == F.col("b.instrument")) & (F.col("a.to") == F.col("b.day"))).select("a.instrument", "a.date", F.col("b.date").alias("emb"))
    b = b.join(ends, ["instrument", "date"])
    return _split(b, _tests(b, n, k, 0), lambda t: _overlaps(t) | ((F.col("date") > t["last"]) & (F.col("date") <= t["emb"])))


def splits_by_config(events: DataFrame, configs: dict[str, tuple[int, int, int]], default: tuple[int, int, int] = (6, 2, 5)) -> DataFrame:
    """Variant B with each instrument's own number of blocks, of test blocks and of embargo dates; others have the default."""
    groups: dict[tuple[int, int, int], list[str]] = {}
    for instrument, c in configs.items():
        groups.setdefault(c, []).append(instrument)
    parts = [(c, events.where(F.col("instrument").isin(names))) for c, names in groups.items()]
    parts.append((default, events.where(~F.col("instrument").isin(list(configs)))))
    out = None
    for (n, k, embargo), rows in parts:
        split = splits_by_dates(rows, n, k, embargo)
        out = split if out is None else out.unionByName(split)
    return out


def splits_before(events: DataFrame, n: int = 4, k: int = 2, embargo_share: float = 0.01) -> DataFrame:
    """Variant C: training rows end before the first test date; the embargo is a share of all calendar days after each block.

    Splits that have no training row are left out; the others keep their numbers, from 0.
    """
    b = blocks(events, n).withColumn("emb", F.lit(None).cast("date"))
    w = Window.partitionBy("instrument")
    days = F.greatest(F.lit(1), F.ceil(embargo_share * F.greatest(F.lit(1), F.date_diff(F.max("date").over(w), F.min("date").over(w)))))
    b = b.withColumn("_days", days.cast("int"))
    tests = _tests(b, n, k, 0)
    first = F.array_min(F.transform("tests", lambda t: t["start"]))
    tests = tests.withColumn("_first", first)
    both = b.join(tests, "instrument")
    test = F.exists("tests", lambda t: t["block_id"] == F.col("block_id"))
    out_ = (F.col("timeout_date") >= F.col("_first")) | F.exists("tests", lambda t: (F.col("date") > t["last"]) & (F.col("date") <= F.date_add(t["last"], F.col("_days"))))
    out = both.withColumn("role", F.when(test, "test").when(~out_, "train")).where("role is not null")
    trained = F.count_if(F.col("role") == "train").over(Window.partitionBy("instrument", "split_id"))
    return out.withColumn("_n", trained).where("_n > 0").select("instrument", "split_id", "pos", "block_id", "date", "role")


def label_end(days: int = 10):
    """When a label ends: its time-out, else its touch, else ``days`` calendar days on."""
    return F.coalesce("timeout_date", "touch_date", F.date_add("date", days))


def split_counts(splits: DataFrame) -> DataFrame:
    return splits.groupBy("instrument", "split_id").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))


def path_ids(pairs: DataFrame) -> DataFrame:
    """instrument, split_id, block_id, path_id: a block's n-th time as a test block belongs to path n (from 0)."""
    seen = pairs.select("instrument", "split_id", "block_id").distinct()
    return seen.withColumn("path_id", F.row_number().over(Window.partitionBy("instrument", "block_id").orderBy("split_id")) - 1)


def stitch(oof: DataFrame) -> DataFrame:
    """Out-of-fold rows with their path."""
    return oof.join(path_ids(oof), ["instrument", "split_id", "block_id"])


def validate_paths(paths: DataFrame, n: int, k: int) -> DataFrame:
    """``paths`` itself; raises unless every block is in C(n - 1, k - 1) paths."""
    if paths.groupBy("instrument", "block_id").count().where(F.col("count") != comb(n - 1, k - 1)).limit(1).count():
        raise ValueError("a block is tested another number of times than its splits say")
    return paths


def sharpe(x, scale: float = 1.0):
    """Mean over deviation, null for fewer than two values or none of deviation."""
    return F.when((F.count(x) >= 2) & (F.stddev_samp(x) > 0), F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * scale)


def path_sharpes(stitched: DataFrame) -> DataFrame:
    """Blocks, rows, trades and the Sharpe ratio of the trades taken, for each path."""
    taken = F.when(F.col("y_pred") == 1, F.col("signed_touch_return"))
    return stitched.groupBy("instrument", "path_id").agg(F.count_distinct("block_id").alias("n_blocks"), F.count("*").alias("n_rows"), F.count_if(F.col("y_pred") == 1).alias("trade_count"), sharpe(taken).alias("path_trade_sharpe"), F.avg(taken).alias("mean_trade_return"))
