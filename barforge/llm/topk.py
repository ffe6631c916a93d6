"""Exact top-k search by inner product with a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .vectors import celled, dealt, each, finite, keyed, matrix

#: Distinct vectors in a shard, and distinct queries in a block.
SHARD, BLOCK = 16384, 4096
#: Bytes of vectors that a shard has at most, whatever its rows.
SHARD_BYTES = 32 << 20
#: Shards while there are few vectors, of at least so many each.
LEAST_SHARDS, LEAST_ROWS = 12, 256
#: Lists a score is made of: each holds the partial scores over a slice of the components.
LISTS = 4
#: Queries whose partial scores with a whole shard are held at once.
ROWS = 64
#: Below every score.
NONE = np.iinfo(np.int64).min // 8


#: A list's partial score must stay below this, so that sums of lists and their multiples fit in 64 bits.
MOST_PARTIAL = 1 << 58


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, held as doubles. By doubles while these are exact, below 2 ** 53, else by integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < MOST_PARTIAL:
        return a.astype(np.int64) @ b.astype(np.int64).T
    if not np.isfinite(most) and not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise OverflowError("a scaled component is beyond the range of doubles")
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    out = whole(a) @ whole(b).T
    if out.size and max(abs(out.max()), abs(out.min())) >= MOST_PARTIAL:
        raise OverflowError("a score is too large for 64 bits")
    return out.astype(np.int64)


def partial_scores(queries: np.ndarray, items: np.ndarray, lists: int = LISTS) -> np.ndarray:
    """lists x queries x items: the score that each slice of the components adds."""
    cuts = np.linspace(0, queries.shape[1], lists + 1).astype(int)
    return np.stack([_exact(queries[:, a:b], items[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def safe_bounds(parts: np.ndarray, k: int, out: np.ndarray | None = None) -> np.ndarray:
    """Phase 1 at one shard: queries x (up to k) scores that as many items reach; NONE where there are fewer.

    Each list names its k best items, and the scores of the named items are what their lists add up to.
    Items marked in ``out`` (queries x items) don't count.
    """
    m, q, n = parts.shape
    k = min(k, n)
    open_ = parts if out is None else np.where(out, NONE, parts)
    named = np.argpartition(open_, n - k, axis=2)[:, :, n - k :]
    named = np.sort(named.transpose(1, 0, 2).reshape(q, m * k), axis=1)
    score = sum(np.take_along_axis(p, named, 1) for p in parts)
    score[:, 1:][named[:, 1:] == named[:, :-1]] = NONE  # named by several lists
    if out is not None:
        score[np.take_along_axis(out, named, 1)] = NONE
    return -np.sort(-score, axis=1)[:, :k]


def sufficient(parts: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
    """Phase 2 at one shard: queries x items that some list holds at or above its uniform share of the cutoff.

    Measured from its lowest entry, each list's threshold is an equal part of what the cutoff leaves above all lowest entries.
    An item below the threshold in all lists has a score below the cutoff, so it can't be among the k best.
    """
    m = len(parts)
    low = parts.min(2)
    need = cutoff[None, :] - low.sum(0)[None, :]
    # parts - low >= need / m in whole numbers; no cutoff: all
    return (m * (parts - low[:, :, None]) >= need[:, :, None]).any(0)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest scores, or all if there are fewer.

    Components x become floor(scale * x); a score is the inner product, in whole numbers. ``is_query`` picks the queries
    by vec_id; candidates are all rows of other ids, and ties go to the smaller vec_id. Rows whose id or vector is
    null, or whose vector holds null or non-finite components, take no part. Vectors of other lengths compare as if they
    ended in zeros. Rows are rows: a candidate that comes twice is in the result twice. Rows of one query id are one query: each
    of them scores with each candidate row, and the best of all these scores are its result. A score whose lists don't fit
    (MOST_PARTIAL) raises OverflowError. An empty table gives no rows; other columns aren't read.

    Equal vectors are one class with its k + 1 smallest ids, however many there are (kept by a map-side limit); no
    other member can be in a result. Classes are dealt to shards and queries to blocks of bounded size, each pair
    of them a cell. Phase 1: in a cell, lists over slices of the components name their best items; a query's k + 1 best scores of
    these in each shard go on, and the last of its k + 1 best overall is its cutoff. Phase 2 sends the cutoff to
    the cells and takes what any list holds at its share of it. Phase 3 sums the lists of these entries alone, and only a query's
    best k + 1 of a shard leave the cell. An id of several vectors has a query for each, which leaves out the classes of that id alone.
    """
    spark = vectors.sparkSession
    raw = keyed(vectors, vec_id, embedding)
    ship = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    whole = raw.where(finite(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("v", F.col("v").cast(ship))
    rows = materialize(whole.groupBy("k1", "k2", "vec_id").agg(F.first("v").alias("v"), F.count("*").alias("n")), "vectors")
    # Classes: at most k + 1 ids each, cut before the shuffle.
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    member = F.struct("vec_id", F.least("n", F.lit(k)).alias("n"))
    classes = materialize(few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(member)).alias("ids"), F.first("v").alias("v")), "classes")
    asked = rows.where(is_query)
    several = asked.groupBy("vec_id").agg((F.count("*") > 1).alias("several"))
    own = F.when(F.col("several"), F.col("vec_id"))
    asked = materialize(asked.join(several, "vec_id").withColumn("own", own).withColumn("q", F.concat_ws(":", "k1", "k2", "own")), "asked")
    queries = materialize(asked.groupBy("q").agg(F.first("own").alias("own"), F.first("v").alias("v")), "queries")
    n, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    nq = queries.count()
    if not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, dims)
    shards = max(-(-n // min(SHARD, max(256, SHARD_BYTES // (8 * dims)))), min(LEAST_SHARDS, max(1, n // LEAST_ROWS)))
    blocks = -(-nq // min(BLOCK, max(256, SHARD_BYTES // (8 * dims))))
    items = celled(classes.select(dealt("k1", shards).alias("s"), each(blocks).alias("b"), F.transform("ids", lambda x: x["vec_id"]).alias("ids"), F.transform("ids", lambda x: x["n"]).alias("times"), "v"), shards, blocks)
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("b")
    some = k + 1

    def cells(table: pa.Table, queries_: pa.Table):
        scaled = lambda t: np.floor(scale * matrix(t["v"], dims).astype(np.float64))
        x, q = scaled(table), scaled(queries_)
        sole = np.diff(table["ids"].combine_chunks().offsets.to_numpy()) == 1
        first = np.array([m[0] for m in table["ids"].to_pylist()])
        has_own = queries_["own"].is_valid().to_numpy()
        mine = queries_["own"].fill_null(0).to_numpy()
        for i in range(0, len(q), ROWS):
            at = slice(i, i + ROWS)
            out = (first[None, :] == mine[at, None]) & sole & has_own[at, None] if has_own[at].any() else None
            yield at, partial_scores(q[at], x), out, first

    def phase1(table: pa.Table, queries_: pa.Table) -> pa.Table:
        q, sure = [], [np.zeros(0, np.int64)]
        if table.num_rows and queries_.num_rows:
            names = queries_["q"].to_pylist()
            for at, parts, out, _ in cells(table, queries_):
                bounds = safe_bounds(parts, some, out)
                q += [x for x in names[at] for _ in range(bounds.shape[1])]
                sure.append(bounds.ravel())
        found = pa.table({"q": pa.array(q, pa.string()), "sure": np.concatenate(sure)})
        return found.filter(pa.array(found["sure"].to_numpy() > NONE))

    spread = celled(queries.select(each(shards).alias("s"), block, "q", "own", "v"), shards, blocks)
    sure = items.groupBy("cell").cogroup(spread.groupBy("cell")).applyInArrow(phase1, "q string, sure long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sure")))
    cutoff = sure.withColumn("place", place).where(F.col("place") <= some).groupBy("q").agg(F.when(F.count("*") == some, F.min("sure")).alias("cutoff"))
    cut = materialize(queries.join(cutoff, "q", "left"), "cutoffs")  # few candidates: no cutoff

    def phases23(table: pa.Table, queries_: pa.Table) -> pa.Table:
        out = {"q": [], "ids": [], "times": [], "score": []}
        if table.num_rows and queries_.num_rows:
            cutoffs = np.where(queries_["cutoff"].is_valid().to_numpy(), queries_["cutoff"].fill_null(0).to_numpy(), NONE)
            names, members, times = queries_["q"].to_pylist(), table["ids"].to_pylist(), table["times"].to_pylist()
            for at, parts, gone, first in cells(table, queries_):
                enough = sufficient(parts, cutoffs[at])
                if gone is not None:
                    enough &= ~gone
                j, c = np.nonzero(enough)
                total = parts[:, j, c].sum(0)
                good = total >= cutoffs[at][j]
                j, c, total = j[good], c[good], total[good]
                order = np.lexsort((first[c], -total, j))
                j, c, total = j[order], c[order], total[order]
                nth = np.arange(len(j)) - np.searchsorted(j, j)
                for j_, c_, score in zip(j[nth < some].tolist(), c[nth < some].tolist(), total[nth < some].tolist(), strict=True):
                    out["q"].append(names[at][j_])
                    out["ids"].append(members[c_])
                    out["times"].append(times[c_])
                    out["score"].append(score)
        longs = pa.list_(pa.int64())
        return pa.table({"q": pa.array(out["q"], pa.string()), "ids": pa.array(out["ids"], longs), "times": pa.array(out["times"], longs), "score": pa.array(out["score"], pa.int64())})

    spread = celled(cut.select(each(shards).alias("s"), block, "q", "own", "v", "cutoff"), shards, blocks)
    resolved = items.groupBy("cell").cogroup(spread.groupBy("cell")).applyInArrow(phases23, "q string, ids array<long>, times array<long>, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))
    best = resolved.withColumn("place", place).where(F.col("place") <= some)
    # A class's best serve all queries that have its vector; a repeated row of either side gives repeated entries.
    to_q = asked.select("q", F.col("vec_id").alias("query_id"), F.least("n", F.lit(k)).alias("asks"))
    found = to_q.join(best.select("q", F.arrays_zip("ids", "times").alias("ids"), "score"), "q").select("query_id", "asks", F.explode("ids").alias("m"), "score")
    found = found.select("query_id", F.col("m.ids").alias("vec_id"), "score", F.least(F.col("asks") * F.col("m.times"), F.lit(k)).cast("int").alias("times")).where("vec_id <> query_id")
    found = found.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, i.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda j: q.c[j] * i.c[j])) AS BIGINT) AS score
  FROM v q JOIN v i ON q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
