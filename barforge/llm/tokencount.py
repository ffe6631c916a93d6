"""Token counts by rank-synchronous merging over ragged numpy arrays."""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_memo, col, text_chunks

#: Distinct pre-tokens whose counts a worker remembers; beyond that it starts afresh.
MEMO = 400_000
#: Bytes of pre-tokens that merge at once.
BLOCK = 1 << 20
#: Tokens beyond which a document is over the limit.
OVER = 512
#: The pattern that byte-level pre-tokenizers split by.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1) << 40


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


class MergeTable:
    """The merges of a byte-level tokenizer file: sorted pair keys, with the rank and the new symbol of each."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, new = (np.array([vocab[x] for x in xs], np.int64) for xs in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], order.astype(np.int64), new[order]
        self.byte = np.array([vocab[c] for c in byte_chars()], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._start()

    def _start(self) -> None:
        self.split = regex.compile(SPLIT).findall
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo: dict[str, int] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "apart", "memo")}

    def __setstate__(self, state) -> None:
        self.__dict__ |= state
        self._start()

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings stand in it; those end a pre-token."""
        if self.apart is None or not any(s in text for s in self.special):
            return self.split(text), 0
        parts = self.apart.split(text)
        return list(chain.from_iterable(map(self.split, parts))), len(parts) - 1

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) of each pair, and the place of its merge."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE), at

    def surviving(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols of each byte string survive when, again and again, every string merges its pair of the lowest rank.

        All strings merge in step. In one step a string merges every place of that pair, from the left where places
        overlap; merges made later have higher ranks than the symbols they use, so this equals one merge at a time.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = size.copy()
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), size)
        while len(sym) > 1:
            rank, at = self.lookup(sym[:-1], sym[1:])
            rank[seq[:-1] != seq[1:]] = _NONE
            # Strings without a pair to merge are done.
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            low = np.minimum.reduceat(np.append(rank, _NONE), starts)
            live = np.repeat(low < _NONE, np.diff(np.append(starts, len(seq))))
            if not live.any():
                break
            lowest = np.repeat(low, np.diff(np.append(starts, len(seq))))[:-1]
            hit = (rank == lowest) & (rank < _NONE)
            # Runs of overlapping places (one symbol again and again): every second one merges.
            if (hit[1:] & hit[:-1]).any():
                i = np.arange(len(hit))
                last = np.maximum.accumulate(np.where(hit, -1, i))
                hit &= (i - last) % 2 == 1
            where = np.flatnonzero(hit)
            sym[where] = self.new[at[where]]
            np.subtract.at(counts, seq[where], 1)
            keep = live
            keep[where + 1] = False
            sym, seq = sym[keep], seq[keep]
        return counts

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(pieces)
        block: list[str] = []
        raw: list[bytes] = []
        size = 0
        for p in new:
            block.append(p)
            raw.append(p.encode("utf-8"))
            size += len(raw[-1])
            if size >= BLOCK:
                self.memo.update(zip(block, self.surviving(raw).tolist(), strict=True))
                block, raw, size = [], [], 0
        if block:
            self.memo.update(zip(block, self.surviving(raw).tolist(), strict=True))


def token_counts(docs: DataFrame, spec: dict, over: int = OVER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, one row for each row of ``docs``.

    Null and empty texts have 0 bytes and tokens. Strings of added tokens count as one token each wherever they stand.
    Document ids may be null or repeat. An empty table gives no rows; other columns aren't read.
    """
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(MergeTable(spec))  # the vocabulary: its size is fixed

    def run(batches):
        merges = table.value
        claim_memo(merges)
        for part, texts in text_chunks(batches):
            split = [merges.pieces(t) for t in texts]
            merges.learn(set(chain.from_iterable(p for p, _ in split)))
            get = merges.memo.__getitem__
            tokens = [sum(map(get, p)) + n for p, n in split]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kinds = T.StructType([T.StructField("doc_id", slim.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return slim.mapInArrow(run, kinds).withColumn("over_limit", F.col("n_tokens") > over)


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_spec(public_tokenizers.path("byte_bpe_50k.json")))
