"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph of ``edges`` (two long columns).

    Returns ``node``, ``component`` (the smallest node reachable) for every node that some edge joins to
    another. Null ends and loops are left out; repeated edges count once; no edges give no rows.

    Every step is a min-aggregate with a map-side combine and an equi-join that adaptive execution can split
    where a node is hot, so no task gathers a component. The number of rounds grows with the logarithm
    of the longest path. Each round goes to the shared scratch folder and the one before is deleted.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = edges.where(f"{a} <> {b}").select(u.alias("u"), v.alias("v")).distinct()
    now, mark = _kept(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, new = _kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        forget(now)
        now, same = after, new == mark
        mark = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _kept(df: DataFrame) -> tuple[DataFrame, tuple]:
    out = materialize(df, "edges")
    row = out.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_000_007))).first()
    return out, (row[0], row[1])
