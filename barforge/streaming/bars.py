"""Streams: daily totals of events within a watermark, and a regime filter that carries its state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.regimes import FIXED, STATES, _emissions, _forward


def event_bars(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """First, highest, lowest and last value, and count and sum, of each type of event in each window.

    The same plan serves a table and a stream; on a stream windows close ``late`` after they end.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    v = F.struct("ts", "event_id", "value")
    agg = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.min(v).alias("a"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(v).alias("z"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", F.col("a.value").alias("open"), "high", "low", F.col("z.value").alias("close"), "n", "total")


def filter_stream(returns: DataFrame) -> DataFrame:
    """instrument, date and the state's probabilities, as the batch filter gives them, for a stream of (instrument, date, ret_1d).

    Null returns are left out, as in the batch. Within a batch rows are put in order of date; a row that comes in a later batch than one of
    its date or later can't be filtered in its place any more and is left out, so the state is never moved twice or backwards.
    """
    means, var = np.array(FIXED["mean"])[:, None], np.array(FIXED["sd"])[:, None] ** 2
    trans = np.full((STATES, STATES), FIXED["move"]) + (FIXED["stay"] - FIXED["move"]) * np.eye(STATES)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prior, last = (np.array(state.get[0]), state.get[1]) if state.exists else (np.full(STATES, 1 / STATES), "")
        rows = pd.concat(list(batches)).dropna(subset=["ret_1d"]).sort_values("date").drop_duplicates("date")
        rows = rows[rows["date"].astype(str) > last]
        if not len(rows):
            return
        probs, _ = _forward(_emissions(rows[["ret_1d"]].to_numpy(float), means, var), prior, trans)
        state.update(([float(x) for x in probs[-1] @ trans], str(rows["date"].iloc[-1])))
        out = rows[["instrument", "date"]].copy()
        for k in range(STATES):
            out[f"p{k}"] = probs[:, k]
        yield out

    schema = "instrument string, date date, " + ", ".join(f"p{k} double" for k in range(STATES))
    return returns.where("ret_1d is not null").groupBy("instrument").applyInPandasWithState(step, schema, "prior array<double>, last string", "append", GroupStateTimeout.NoTimeout)
