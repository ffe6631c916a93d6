"""Sharding by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

#: Largest shard, in UTF-8 bytes of text.
LIMIT_BYTES = 1 << 20
#: Bits of one hash word; there are two.
WORD_BITS = 60
#: Levels that a pass looks at beyond those that buckets of even size would need.
MORE = 2
#: Cells, of 16 bytes each, that are broadcast at most; more of them are joined.
BROADCAST_CELLS = 100_000


def _word(text: Column) -> Column:
    """The first 60 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: int) -> list[Column]:
    """p and q: the first ``bits`` of the words h1 and h2."""
    p = F.shiftright("h1", WORD_BITS - min(bits, WORD_BITS))
    q = F.shiftright("h2", 2 * WORD_BITS - bits) if bits > WORD_BITS else F.lit(0).cast("long")
    return [p.alias("p"), q.alias("q")]


def _above(bits: int) -> list[Column]:
    """p and q of the bucket of ``depth`` bits that a cell of ``bits`` bits is in."""
    cut = f"if(depth < {WORD_BITS}, shiftright(p, {min(bits, WORD_BITS)} - depth), p)" if bits > WORD_BITS else f"shiftright(p, {bits} - depth)"
    low = f"if(depth <= {WORD_BITS}, 0L, shiftright(q, {bits} - depth))" if bits > WORD_BITS else "0L"
    return [F.expr(cut).alias("dp"), F.expr(low).alias("dq")]


def _name() -> Column:
    """A bucket's prefix as a text of ``depth`` bits."""
    bits = lambda c, n: F.expr(f"lpad(conv(cast({c} as string), 10, 2), {n}, '0')")
    return F.when(F.col("depth") <= WORD_BITS, bits("dp", "depth")).otherwise(F.concat(bits("dp", str(WORD_BITS)), bits("dq", f"depth - {WORD_BITS}")))


def assign(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth, shard (the bucket's hash prefix as ``depth`` bits), shard_bytes, shard_docs, oversize.

    Every document hashes to 60 bits of md5(doc_id). The directory starts with one bucket; a bucket above
    ``limit_bytes`` splits on the next bit, others stay, until each fits. A bucket of one document that's larger
    than the limit stops there with ``oversize`` true: nothing can split it. Rows that share a doc_id can't be told
    apart by their first 60 bits; a bucket of such rows splits on 60 more bits of a hash of the row's position.
    A null id hashes as an empty id, a null text has 0 bytes, an empty table gives no rows; other columns aren't read.

    A pass sums bytes once by cell, the longest prefix it looks at (a few bits more than buckets of even size need), with a map-side
    combine; shorter prefixes are summed from the cells, and the directory gives each cell its first level that
    fits. Rows meet the directory once, by cell. Cells that hold too much even so, by a repeated id or by chance, are no key of
    that join: their rows are set apart first, by a broadcast of these cells while they are few, and are all that the next pass reads.
    """
    id_text = F.coalesce(col(docs, doc_id).cast("string"), F.lit(""))
    # The position has part of its bits from the partition: deterministic for the same files and splits.
    keys = docs.select(
        col(docs, doc_id).alias("doc_id"), F.coalesce(F.octet_length(col(docs, text)), F.lit(0)).cast("long").alias("n_bytes"),
        _word(id_text).alias("h1"), _word(F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string"))).alias("h2"),
    )
    rest = materialize(keys, "keys")
    placed, base, most = None, 0, rest.agg(F.sum("n_bytes")).first()[0] or 0
    while True:
        need = max(1, ceil(log2(max(2, most / max(1, limit_bytes))))) + MORE
        top = min(base + need, WORD_BITS if base < WORD_BITS else 2 * WORD_BITS)
        at_cell = rest.select("doc_id", "n_bytes", "h1", "h2", *_prefix(top))
        cells = at_cell.groupBy("p", "q").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), (F.min("h1") == F.max("h1")).alias("same"))
        cells = materialize(cells, "cells")
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1)
        # Level `base` was too large in the pass before; the first pass also tries the whole.
        levels = F.explode(F.sequence(F.lit(base + 1 if base else 0), F.lit(top))).alias("depth")
        sums = cells.select("p", "q", "b", "n", levels).select("depth", *_above(top), "b", "n").groupBy("depth", "dp", "dq")
        sums = materialize(sums.agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")).where(fits), "buckets")
        some = [r[0] for r in sums.select("depth").distinct().collect()]  # at most a pass's levels
        spread = cells.select("p", "q", F.explode(F.lit(some).cast("array<int>")).alias("depth")).select("p", "q", "depth", *_above(top))
        first = F.min(F.struct("depth", "dp", "dq", "shard_bytes", "shard_docs")).alias("at")
        directory = spread.join(sums.hint("merge"), ["depth", "dp", "dq"]).groupBy("p", "q").agg(first).select("p", "q", "at.*")
        directory = materialize(directory, "directory")
        left = materialize(cells.join(directory.hint("merge"), ["p", "q"], "left_anti"), "left")
        n_left, most, same = left.agg(F.count("*"), F.max("b"), F.every("same")).first()
        done = at_cell
        if n_left:
            apart = F.broadcast(left.select("p", "q")) if n_left <= BROADCAST_CELLS else left.select("p", "q").hint("merge")
            done = at_cell.join(apart, ["p", "q"], "left_anti")
            rest = materialize(at_cell.join(apart, ["p", "q"], "left_semi").select("doc_id", "n_bytes", "h1", "h2"), "rest")
        done = done.join(directory.hint("merge"), ["p", "q"]).select("doc_id", "n_bytes", "depth", "dp", "dq", "shard_bytes", "shard_docs")
        placed = done if placed is None else placed.unionByName(done)
        if not n_left:
            break
        if top == 2 * WORD_BITS:
            # All 120 bits agree: nothing splits these.
            ends = left.select(F.col("p").alias("dp"), F.col("q").alias("dq"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"))
            last = rest.select("doc_id", "n_bytes", F.lit(top).alias("depth"), F.col("h1").alias("dp"), F.col("h2").alias("dq"))
            placed = placed.unionByName(last.join(ends, ["dp", "dq"]).select(placed.columns))
            break
        base = WORD_BITS if same and top < WORD_BITS else top  # cells of one id each: no level up to there splits them
    return placed.select("doc_id", "n_bytes", "depth", _name().alias("shard"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit_bytes).alias("oversize"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Ids are taken to be unique here: only the first 60 bits are followed, 30 levels of them.
ORACLE_SQL = """
WITH k AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         lpad(bin(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT)), 60, '0') AS bits
  FROM documents
), p AS (
  SELECT k.*, CAST(l.depth AS INTEGER) AS depth, substr(k.bits, 1, CAST(l.depth AS INTEGER)) AS shard FROM k, (SELECT unnest(range(0, 31)) AS depth) l
), b AS (
  SELECT depth, shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY depth, shard
), f AS (
  SELECT p.*, b.shard_bytes, b.shard_docs, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS nth
  FROM p JOIN b USING (depth, shard) WHERE b.shard_bytes <= 1048576 OR b.shard_docs = 1
)
SELECT doc_id, n_bytes, depth, shard, shard_bytes, shard_docs, shard_bytes > 1048576 AS oversize FROM f WHERE nth = 1
"""
