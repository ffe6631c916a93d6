"""What the vector operators share: valid rows, classes of equal vectors, blocks and matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

#: Cells whose keys are chosen so that each has a partition of its own; more of them even out by number.
CELLS = 4096
#: Partitions that cells are dealt to at most.
MOST_PARTS = 65536


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False))


def keyed(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (components as doubles) and two hashes that stand for v: 128 bits, so that equal ones mean equal vectors."""
    v = col(df, embedding).cast("array<double>")
    df = df.select(col(df, vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return df.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(7), "v"))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of an array column as a matrix; shorter rows end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(lists.offsets.to_numpy())
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), flat.dtype)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def dealt(key: str, parts: int) -> Column:
    """A part from 0 to parts - 1 by a hash of the key."""
    return F.pmod(F.xxhash64(F.lit("deal"), key), F.lit(parts)).cast("int")


def each(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def spark_hash(x: np.ndarray) -> np.ndarray:
    """The hash by which Spark deals a column of ints (Murmur3, 32 bits, seed 42)."""
    rotl = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    with np.errstate(over="ignore"):
        k = rotl(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = (rotl(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def cell_keys(n: int) -> list[int]:
    """n ints that Spark deals to n partitions, one each."""
    found = np.full(n, -1, np.int64)
    at = 0
    while (found < 0).any():
        x = np.arange(at, at + 16 * n + 64)
        part = spark_hash(x) % n
        new, first = np.unique(part, return_index=True)
        free = found[new] < 0
        found[new[free]] = x[first[free]]
        at += len(x)
    return found.tolist()


def celled(df: DataFrame, shards: int, blocks: int) -> DataFrame:
    """``df`` with ``cell``, a key for each pair of its columns s and b, dealt to partitions so that few cells never meet in one task.

    Adaptive execution doesn't merge these partitions: a cell is heavy by its work, not its bytes.
    """
    n = shards * blocks
    number = F.col("s").cast("long") * blocks + F.col("b")
    if n > CELLS:
        return df.withColumn("cell", number).repartition(min(n, MOST_PARTS), "cell")
    keys = df.sparkSession.createDataFrame([(i // blocks, i % blocks, k) for i, k in enumerate(cell_keys(n))], "s int, b int, cell int")
    return df.join(F.broadcast(keys), ["s", "b"]).repartition(n, "cell")
