"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, crc_mod, materialize, text_chunks

#: Buckets of the hashed n-grams, as a power of two.
BITS = 18
#: Labelled documents to train on at most, the first in the order of a hash of the id, and different n-grams that all of them hold
#: together: the documented bounds of the sample.
TRAIN_ROWS, TRAIN_GRAMS = 12_000, 16_000_000
#: Passes over the sample, and the parameters of the updates.
PASSES, ALPHA, BETA, L1, L2 = 3, 0.15, 1.0, 0.02, 0.02
#: Distinct words whose hashes a worker remembers; beyond that it starts afresh.
MEMO = 400_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_EDGE = np.uint64(0x51ED270B27D4EB2F)
_TWICE = np.uint64(0x2545F4914F6CDD1D)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_memo: dict[str, int] = {}


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the word uni- and bigrams of all texts in a row, the number of each text's, and its scale.

    Words are runs of letters and digits or runs of other signs. The edges of a text are words too, and a word
    said twice is one bigram whatever the word. A text's n-grams have value 1 / sqrt(number of its n-grams) each.
    """
    memo = _memo
    if len(memo) > MEMO:
        memo.clear()
    flat: list[int] = []
    size = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh3_64_intdigest
    for i, t in enumerate(texts):
        words = _TOKEN.findall(t)
        size[i] = len(words) + 2
        for w in set(words).difference(memo):
            memo[w] = digest(w)
        flat.append(int(_EDGE))
        flat += map(memo.__getitem__, words)
        flat.append(int(_EDGE))
    h = np.array(flat, np.uint64)
    pair = (h[:-1] * _MUL) ^ (h[1:] * _TWICE)
    pair = np.where(h[:-1] == h[1:], _TWICE, pair)
    ends = np.cumsum(size)
    # In order: every word, each with the pair that it begins; a text's last edge begins none of it.
    both = np.empty(2 * len(h), np.uint64)
    both[0::2] = h
    both[1::2] = np.append(pair, np.uint64(0))
    keep = np.ones(2 * len(h), bool)
    keep[2 * ends - 1] = False
    both = both[keep]
    both = (both ^ (both >> np.uint64(32))) * _MUL >> np.uint64(64 - bits)
    n = 2 * size - 1
    return both.astype(np.int64), n, 1.0 / np.sqrt(n)


class Ftrl:
    """Logistic regression by FTRL-proximal updates, each coordinate with its own rate."""

    def __init__(self, bits: int = BITS) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS, rows: int = TRAIN_ROWS, grams: int = TRAIN_GRAMS,
) -> np.ndarray:
    """Weights, the bias last, from at most ``rows`` labelled documents: the first in the order of a hash of the id.

    Rows of ``labels`` without an id, or with a label other than 0 or 1, don't count; repeated labels of an id count
    once and the larger wins. Of documents that share an id one text counts, the one of the smallest hash; a null text counts as empty.
    The sample ends before the document that takes it past ``grams`` different n-grams, the first always counts. With no labelled rows all
    weights are 0. Only ids are joined to choose the sample, whose ids and labels alone are broadcast; executors hash its texts to
    buckets, and one task makes the updates, which follow each other by nature, over this bounded sample. Two numbers a bucket reach the driver.
    """
    good = labels.where(col(labels, label).isin(0, 1) & col(labels, doc_id).isNotNull())
    if usable is not None:
        good = good.where(usable)
    good = good.groupBy(col(good, doc_id).alias("doc_id")).agg(F.max(col(good, label)).alias("y"))
    there = docs.select(col(docs, doc_id).alias("doc_id")).distinct()
    known = good.join(there, "doc_id", "left_semi").withColumn("draw", F.xxhash64("doc_id", F.lit("quality")))
    chosen = materialize(known.orderBy("draw", "doc_id").limit(rows), "chosen")
    slim = docs.select(col(docs, doc_id).alias("doc_id"), F.coalesce(col(docs, text), F.lit("")).alias("text"))
    sample = slim.join(F.broadcast(chosen), "doc_id").groupBy("draw", "doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    sample = sample.select("draw", F.col("y").cast("int").alias("y"), F.col("t.text").alias("text"))

    def run(batches):
        for part, texts in text_chunks(batches, limit=1 << 20):
            at, n, scale = features(texts, bits)
            ends = np.cumsum(n)
            size, idx, val = [], [], []
            for a, b, s in zip(ends - n, ends, scale, strict=True):
                k, c = np.unique(at[a:b], return_counts=True)
                size.append(len(k))
                idx.append(np.append(k, 1 << bits).astype(np.int32).tobytes())
                val.append(np.append(c * s, 1.0).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["draw", "y", "size", "idx", "val"])

    hashed = materialize(sample.mapInArrow(run, "draw long, y int, size long, idx binary, val binary"), "hashed")

    def fit(batches):
        known, total = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                total += r["size"]
                if known and total > grams:
                    break
                known.append((np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32).astype(float), r["y"]))
        yield pa.RecordBatch.from_arrays([pa.array([learn(known, bits).tobytes()], pa.binary())], ["weights"])

    # Equal draws are told apart by what they hold: reruns see one order.
    ordered = hashed.repartition(1).sortWithinPartitions("draw", "idx", "y")
    found = ordered.mapInArrow(fit, "weights binary").first()
    return np.frombuffer(found["weights"], float) if found else np.zeros((1 << bits) + 1)


def learn(known: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS) -> np.ndarray:
    """Weights after PASSES over documents in their order: buckets, values and label of each."""
    model = Ftrl(bits)
    for _ in range(PASSES):
        for at, x, y in known:
            model.update(at, x, y)
    return model.weights()


def score_texts(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """Sparse dot products of all texts with the weights, as probabilities."""
    bits = int(len(weights) - 1).bit_length() - 1
    at, n, scale = features(texts, bits)
    sums = np.add.reduceat(weights[at], np.cumsum(n) - n)
    return 1.0 / (1.0 + np.exp(-np.clip(sums * scale + weights[-1], -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, from 0 to 1, of every whole text, one row for each row of ``docs``.

    Null and empty texts score as texts of two edges and no word. Document ids may be null or repeat; an empty table gives
    no rows; other columns aren't read.
    """
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS + 1 numbers

    def run(batches):
        for part, texts in text_chunks(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(shared.value, texts))], ["doc_id", "score"])

    return slim.mapInArrow(run, T.StructType([T.StructField("doc_id", slim.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights = train(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    held = (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    return score(docs, weights).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
