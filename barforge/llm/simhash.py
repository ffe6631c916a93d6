"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, materialize, text_chunks
from .components import connected_components
from .unionfind import Forest

#: Words in a shingle, bits in which linked fingerprints may differ, seed of the hash.
SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints in a tile at most, and tiles at least while the table is small.
TILE, LEAST_TILES = 16384, 24
#: Rows of a tile that are compared with the whole other tile at once.
ROWS = 64

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint of a whole text: a bit is 1 if it's set in over half the shingles' hashes; 0 without words."""
    words = _WORDS.findall((text or "").encode("utf-8").lower())  # bytes.lower() maps A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
    set_ = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        set_ += np.unpackbits(hashes[i : i + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every whole text, and ``more`` columns; null and empty texts have 0."""
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"), *more)
    schema = T.StructType([slim.schema["doc_id"], T.StructField("fp", T.LongType()), *slim.schema[2:]])

    def run(batches):
        for part, texts in text_chunks(batches):
            fps = np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), *part.columns[2:]], schema.names)

    return slim.mapInArrow(run, schema)


def tile_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of ``a`` and ``b`` within ``radius`` bits to the same groups: a spanning forest, not all pairs."""
    same = a is b
    nodes = np.concatenate([a, b]) if not same else a
    offset = 0 if same else len(a)
    forest = Forest(len(nodes))
    for i in range(0, len(a), ROWS):
        near = np.bitwise_count(a[i : i + ROWS, None] ^ b[None, :]) <= radius
        forest.join_matrix(near, i, offset)
    left, right = forest.links()
    return nodes[left], nodes[right]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b (fingerprints as longs): links between distinct fingerprints that connect all within ``radius`` bits.

    ``fps`` has one row for each distinct ``fp``. Fingerprints are put in cells by the bit counts of their two
    halves, at most 33 x 33 of them; cells are cut by hash, or packed, into tiles of bounded size. Two tiles are compared if
    some of their cells may hold fingerprints within the radius: the two differences of bit counts may not add up
    to more. A tile pair is one small row of two arrays, and each comparison gives a spanning forest of its
    links, no more rows than the two tiles have.
    """
    spark = fps.sparkSession
    cell = [F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)).alias("p"), F.bit_count(F.shiftrightunsigned("fp", 32)).alias("q")]
    cells = sorted(fps.groupBy(*cell).count().collect())  # 1,089 rows at most
    total = sum(c["count"] for c in cells)
    size = max(256, min(tile, -(-total // LEAST_TILES)))
    table, at, full = [], 0, 0
    for p, q, n in cells:
        if n > size or full + n > size:
            at, full = at + bool(full), 0
        cuts = -(-n // size)
        table.append((p, q, at, cuts))
        at, full = (at + cuts, 0) if cuts > 1 else (at, full + n)
    if not table:
        return spark.createDataFrame([], "a long, b long")
    dealt = spark.createDataFrame(table, "p int, q int, tile long, cuts int")
    keyed = fps.select("fp", *cell).join(F.broadcast(dealt), ["p", "q"])
    placed = keyed.select("fp", (F.col("tile") + F.pmod(F.xxhash64("fp"), F.col("cuts"))).alias("tile"))
    blobs = materialize(placed.groupBy("tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    # Tiles by cell, and each cell's neighbours within the radius: an equi-join on cells.
    tiles = dealt.select("p", "q", F.explode(F.expr("sequence(tile, tile + cuts - 1)")).alias("tile"))
    steps = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius]
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])).alias("s")
    around = tiles.select("p", "q", F.col("tile").alias("ta"), step).select((F.col("p") + F.col("s.x")).alias("p"), (F.col("q") + F.col("s.y")).alias("q"), "ta")
    pairs = around.join(tiles.withColumnRenamed("tile", "tb"), ["p", "q"]).where("ta <= tb").select("ta", "tb").distinct()
    both = pairs.join(blobs.select(F.col("tile").alias("ta"), F.col("fps").alias("fa")), "ta")
    both = both.join(blobs.select(F.col("tile").alias("tb"), F.col("fps").alias("fb")), "tb").select("ta", "tb", "fa", "fb")

    def compare(group: pa.Table) -> pa.Table:
        out = [np.zeros((2, 0), np.int64)]
        for i in range(group.num_rows):
            ta, tb = group["ta"][i].as_py(), group["tb"][i].as_py()
            a = group["fa"][i].values.to_numpy().view(np.uint64)
            b = a if ta == tb else group["fb"][i].values.to_numpy().view(np.uint64)
            out.append(np.stack(tile_links(a, b, radius)).view(np.int64))
        found = np.concatenate(out, axis=1)
        return pa.table({"a": found[0], "b": found[1]})

    return both.groupBy("tb", "ta").applyInArrow(compare, "a long, b long")


def _groups(fps: DataFrame, first: Column, radius: int = RADIUS) -> DataFrame:
    """fp, first (an aggregate of its rows) and c (a fingerprint that names its group) of every distinct fingerprint."""
    classes = materialize(fps.groupBy("fp").agg(first.alias("first")), "classes")
    found = connected_components(links(classes.select("fp"), radius))
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    return materialize(named, "named")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable, itself included): one row for each row of ``docs``.

    Texts that are null, empty or blank all have fingerprint 0 and link with each other and with any
    fingerprint near it. Rows that share a doc_id are joined through it only if their fingerprints are. Null ids
    take part in the links of their texts but are never the smallest. An empty table gives no rows; other columns aren't read.

    Equal fingerprints are one class from the start, so copies cost one row each and no pairs.
    """
    fps = materialize(fingerprints(docs, doc_id, text, k), "fps")
    named = _groups(fps, F.min("doc_id"), radius)
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    by_fp = materialize(named.join(least, "c").select("fp", "component_id"), "by_fp")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest by id (null last), then fingerprint and hashes of the row.

    Null and repeated ids are as any others: rows of one id in several groups may all stay, and a group of null ids keeps one.
    A row is found again by two hashes of its id, text and other columns, 128 bits; rows that agree in them are one. Whole rows are shuffled once,
    by these hashes, which finds the kept rows and drops equal ones.
    """
    names = fresh(docs, "row_1", "row_2")
    whole = [col(docs, c) for c in docs.columns if not re.search("map<|variant", docs.schema[c].dataType.simpleString())]  # these have no hash
    # The places of nulls are hashed too: a null and the value after it don't change places unseen.
    nulls = F.concat(*[F.when(c.isNull(), "n").otherwise("s") for c in whole])
    marked = docs.withColumns({names[0]: F.xxhash64(nulls, *whole), names[1]: F.xxhash64(F.lit("row"), *reversed(whole), nulls)})
    fps = materialize(fingerprints(marked, doc_id, text, more=(marked[names[0]].alias("r1"), marked[names[1]].alias("r2"))), "fps")
    named = _groups(fps, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "r1", "r2")))
    least = materialize(named.groupBy("c").agg(F.min("first").alias("first")).select(F.col("first.r1").alias(names[0]), F.col("first.r2").alias(names[1])), "least")
    return marked.join(least, names, "left_semi").dropDuplicates(names).drop(*names)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
