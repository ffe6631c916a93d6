"""Byte-level BPE encoding and decoding: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import claim_memo, col, text_chunks

#: Distinct pre-tokens outside the vocabulary whose ids a worker remembers; beyond that it starts afresh.
MEMO = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings: each of n keys has its own of n slots; other strings fall on some slot.

    Keys go to buckets by one half of their hash; the largest buckets look first for a displacement that sends all
    their keys to free slots, and buckets of one key are given a free slot directly. Placing is checked on lookup: the slot's
    key must equal the string.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.shift = np.zeros(max(1, n // 3), np.int64)
        h = self._hash(keys)
        bucket = h % np.uint64(len(self.shift))
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if n else []
        self.slot = np.full(n, -1, np.int64)  # slot: index of its key
        free = np.ones(n, bool)
        single = []
        for g in sorted(groups, key=len, reverse=True):
            b = int(bucket[g[0]])
            if len(g) == 1:
                single.append((b, g[0]))
                continue
            d = 0
            while True:
                # Many displacements at once; a row holds the slots of all keys of the bucket.
                tries = np.arange(d, d + 64)
                rows = np.sort(self._displaced(h[g][None, :], tries[:, None]), axis=1)
                good = free[rows].all(1) & (rows[:, 1:] != rows[:, :-1]).all(1)
                if good.any():
                    break
                d += 64
            d = int(tries[good.argmax()])
            at = self._displaced(h[g], d)
            self.shift[b], self.slot[at] = d, g
            free[at] = False
        for (b, key), at in zip(single, np.flatnonzero(free), strict=True):
            self.shift[b], self.slot[at] = -1 - at, key

    @staticmethod
    def _hash(keys) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, keys), np.uint64, len(keys))

    def _displaced(self, h: np.ndarray, d) -> np.ndarray:
        x = (h >> np.uint64(17)) ^ (np.asarray(d, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The index of the only key that each string can be."""
        h = self._hash(strings)
        d = self.shift[h % np.uint64(len(self.shift))]
        return self.slot[np.where(d < 0, -1 - d, self._displaced(h, np.maximum(d, 0)))]


class ByteBPE:
    """Encodes and decodes by a table of ranks, each match of a pattern separately, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.tokens = list(ranks)
        self.ids = [ranks[t] for t in self.tokens]
        self.bytes = {i: t for t, i in ranks.items()}
        self.hash = PerfectHash(self.tokens)
        self.names = [str(i) for i in self.ids]
        self.name_of = {i: str(i) for i in self.ids}
        self._start()

    def _start(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.memo: dict[str, str] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo")}

    def __setstate__(self, state) -> None:
        self.__dict__ |= state
        self._start()

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token by its bytes: the adjacent pair of the lowest rank, leftmost first, merges until none has one."""
        n, ranks = len(piece), self.ranks
        get = ranks.get
        if n < 2:
            return [ranks[piece]]
        # An entry is one integer: rank, then place, then the bytes that its two parts have together.
        w = n.bit_length()
        low, by_rank = (1 << w) - 1, 2 * w
        size = [1] * n  # of the part that begins here; 0: none does
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                heap.append(r << by_rank | i << w | 2)
        heapify(heap)
        while heap:
            entry = heappop(heap)
            both, i = entry & low, entry >> w & low
            left = size[i]
            # It holds only while both its parts are as they were.
            if not left or (j := i + left) >= n or left + size[j] != both:
                continue
            size[i], size[j] = both, 0
            k = i + both
            if k < n:
                before[k] = i
                if (r := get(piece[i : k + size[k]])) is not None:
                    heappush(heap, r << by_rank | i << w | both + size[k])
            k = before[i]
            if k >= 0 and (r := get(piece[k : i + both])) is not None:
                heappush(heap, r << by_rank | k << w | size[k] + both)
        out, i = [], 0
        while i < n:
            j = i + size[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode_pieces(self, pieces: list[str]) -> Iterator[list[int]]:
        """The ids of each pre-token: whole ones of the vocabulary by the perfect hash, others by merging."""
        raw = [p.encode("utf-8") for p in pieces]
        tokens, ids, merge = self.tokens, self.ids, self.merge
        for b, at in zip(raw, self.hash.find(raw).tolist(), strict=True):
            yield [ids[at]] if tokens[at] == b else merge(b)

    def resolve(self, pieces: set[str]) -> dict[str, str]:
        """The ids of each pre-token, joined by spaces: the perfect hash has those of the vocabulary, a memo those merged before.

        Whatever ids merging gives must decode to the pre-token; it is checked as they are learned.
        """
        out, memo = {}, self.memo
        if len(memo) > MEMO:
            memo.clear()
        known = list(pieces)
        raw = [p.encode("utf-8") for p in known]
        tokens, names, name_of, merge, decode = self.tokens, self.names, self.name_of, self.merge, self.decode
        for p, b, at in zip(known, raw, self.hash.find(raw).tolist(), strict=True):
            if tokens[at] == b:
                out[p] = names[at]
            elif (text := memo.get(p)) is not None:
                out[p] = text
            else:
                ids = merge(b)
                if decode(ids) != b:
                    raise ValueError(f"the ids of {p!r} decode to something else")
                out[p] = memo[p] = " ".join([name_of[i] for i in ids])
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_pieces(self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _schema(doc_id: T.StructField, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("doc_id", doc_id.dataType), *more])


def _run_over(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str, text: str, names: dict, row):
    """mapInArrow over doc_id and text; ``row`` makes a tuple of the further columns from the pre-tokens, what ``resolve`` says of them and the codec."""
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    codec = docs.sparkSession.sparkContext.broadcast(ByteBPE(ranks, pattern))  # the vocabulary: its size is fixed
    arrow = [pa.field(n, t) for n, (t, _) in names.items()]

    def run(batches):
        bpe = codec.value
        claim_memo(bpe)
        for part, texts in text_chunks(batches, limit=2 << 20):
            pieces = [bpe.split(t) for t in texts]
            known = bpe.resolve(set(chain.from_iterable(pieces)))
            columns = zip(*[row(p, known, bpe) for p in pieces], strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", *names])

    return slim.mapInArrow(run, _schema(slim.schema["doc_id"], *[T.StructField(n, t) for n, (_, t) in names.items()]))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every whole text, one row for each row of ``docs``; if ``decoded``, decoded_sha256 too.

    That is of the bytes that these very ids decode to.

    Null and empty texts have no ids. Ids of documents may be null or repeat. An empty table gives no rows; other
    columns aren't read. Strings of special tokens are ordinary text.
    """

    def row(pieces, known, bpe):
        ids = [int(i) for i in " ".join([known[p] for p in pieces]).split()]
        return (len(ids), ids, hashlib.sha256(bpe.decode(ids)).hexdigest()) if decoded else (len(ids), ids)

    names = {"n_tokens": (pa.int64(), T.LongType()), "ids": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))}
    return _run_over(docs, ranks, pattern, doc_id, text, names | ({"decoded_sha256": (pa.string(), T.StringType())} if decoded else {}), row)


def decode(encoded: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of rows of ids; null ids give a null text. Bytes that aren't UTF-8 become U+FFFD."""
    slim = encoded.select(col(encoded, doc_id).alias("doc_id"), col(encoded, ids).alias("ids"))
    table = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    def run(batches):
        get = table.value.__getitem__
        for batch in batches:
            texts = [None if x is None else b"".join(map(get, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return slim.mapInArrow(run, _schema(slim.schema["doc_id"], T.StructField("text", T.StringType())))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by one space), decoded_sha256 (of the bytes the ids decode to).

    Rows as in ``encode``, whose ids these are; the ids themselves don't leave the workers.
    """

    def row(pieces, known, _):
        ids = " ".join([known[p] for p in pieces])
        n = ids.count(" ") + 1 if ids else 0
        # The bytes of each pre-token are what its ids decode to, as ``resolve`` has checked.
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256("".join(pieces).encode("utf-8")).hexdigest()

    text_type = (pa.string(), T.StringType())
    return _run_over(docs, ranks, pattern, doc_id, text, {"n_tokens": (pa.int64(), T.LongType()), "ids_sha256": text_type, "decoded_sha256": text_type}, row)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)
