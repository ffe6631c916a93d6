"""Near-duplicate embeddings: small-world graphs per shard, every shard queried, cosines verified, components united."""

from __future__ import annotations

import io
import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .hnsw import Hnsw
from .unionfind import Forest
from .vectors import celled, dealt, each, finite, keyed, matrix

_log = logging.getLogger(__name__)

#: Cosine from which vectors link.
COSINE = 0.9
#: Distinct vectors in a shard's graph, and distinct queries in a block.
SHARD, BLOCK = 65536, 131072
#: Bytes of vectors that a shard has at most, whatever its rows, counting 8 a component; and a block.
SHARD_BYTES, BLOCK_BYTES = 64 << 20, 64 << 20
#: Shards and blocks while there are few vectors, of at least so many each.
LEAST_SHARDS, LEAST_BLOCKS, LEAST_ROWS = 2, 8, 512
#: Beam of the first search; each next one is twice as wide. Beyond the widest one an exact pass over the shard decides.
BEAM, WIDEST = 16, 256
#: Planted probes of a shard, audited queries of each kind of a cell, and the recall that beams must reach in both.
PROBES, AUDIT, RECALL = 512, 64, 0.99
#: Queries that search at once, and that are audited together at most.
ROWS, TOGETHER = 128, 16384


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _scan(q: np.ndarray, x: np.ndarray, least: float) -> list[np.ndarray]:
    near = q @ x.T >= least
    return [np.flatnonzero(r) for r in near]


def probes(x: np.ndarray, least: float, n: int = PROBES, seed: int = 3) -> np.ndarray:
    """Unit vectors that each have a link by construction: a row of ``x`` turned away until its cosine is just above ``least``.

    Every other one is turned towards another row, the rest in a random direction. In one dimension, or for a single row, rows themselves.
    """
    rng = np.random.default_rng(seed)
    at, to = rng.integers(0, len(x), (2, n))
    turn = rng.normal(size=(n, x.shape[1]))
    turn[::2] = x[to][::2]
    turn -= (turn * x[at]).sum(1, keepdims=True) * x[at]
    size = np.sqrt((turn * turn).sum(1, keepdims=True))
    turn = np.where(size > 1e-6, turn / np.maximum(size, 1e-6), 0.0)
    near = min(1.0, least + 1e-6)
    return _unit(near * x[at] + (1.0 - near * near) ** 0.5 * turn)


class Shard:
    """A graph with its rows in double precision, and how near a query must come to a node to link with one of its members."""

    def __init__(self, graph: Hnsw, x: np.ndarray, least: float) -> None:
        self.graph, self.x, self.least = graph, x, least
        angle = np.arccos(np.clip(least, -1, 1)) + np.arccos(np.clip(graph.least - 1e-6, -1, 1))
        self.enough = np.where(graph.least == 1.0, least, np.cos(np.minimum(angle, np.pi))) - 1e-4
        self.lowest = self.enough.min(initial=least)
        self.order = np.argsort(graph.lead, kind="stable")
        self.ends = np.searchsorted(graph.lead[self.order], np.arange(len(x) + 1))
        self.nodes = int((graph.lead == np.arange(len(x))).sum())

    def members(self, nodes: np.ndarray) -> np.ndarray:
        if len(nodes) == 1:
            return self.order[self.ends[nodes[0]] : self.ends[nodes[0] + 1]]
        return np.concatenate([self.order[self.ends[i] : self.ends[i + 1]] for i in nodes.tolist()])

    def search(self, q: np.ndarray, beam: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Links of each query among all rows by one beam, verified in double precision; and its two best similarities to nodes.

        A query whose beam ends where a node's members may still link may have more of them: its links come from an exact pass over the
        shard, however many they are.
        """
        found: list[np.ndarray] = []
        top = np.full((len(q), 2), -2.0)
        none = np.zeros(0, np.int64)
        for i in range(0, len(q), ROWS):
            part = q[i : i + ROWS]
            ids, sims = self.graph.search(part.astype(np.float32), beam)
            top[i : i + ROWS, : sims.shape[1]] = sims[:, :2]
            near = (sims >= self.enough[np.maximum(ids, 0)]) & (ids >= 0)
            rows = [none] * len(part)
            full = (sims[:, -1] >= self.lowest) & (ids.shape[1] < self.nodes)
            for k in np.flatnonzero(near.any(1) & ~full).tolist():
                r = self.members(ids[k, near[k]])
                rows[k] = r[self.x[r] @ part[k] >= self.least]
            if full.any():
                for k, r in zip(np.flatnonzero(full).tolist(), _scan(part[full], self.x, self.least), strict=True):
                    rows[k] = r
            found += rows
        return found, top


def _recall(found: list[np.ndarray], truth: list[np.ndarray], own: np.ndarray) -> float:
    """The mean over queries that have links, their own rows aside, of the share found; 1 without such queries."""
    shares = [np.isin(t, f).mean() for t, f in ((t[t != o], f) for t, f, o in zip(truth, found, own, strict=True)) if len(t)]
    return float(np.mean(shares)) if shares else 1.0


def audited_beam(shard: Shard, beam: int = BEAM) -> tuple[int, float]:
    """The narrowest beam by which planted probes find RECALL of their links, and that recall; WIDEST * 2 if none does."""
    p = probes(shard.x, shard.least)
    truth, own = _scan(p, shard.x, shard.least), np.full(len(p), -1)
    while beam <= WIDEST:
        got = _recall(shard.search(p, beam)[0], truth, own)
        if got >= RECALL or beam >= shard.nodes:
            return beam, got
        beam *= 2
    return beam, 1.0


def shard_links(shard: Shard, q: np.ndarray, own: np.ndarray, beam: int = BEAM) -> tuple[list[np.ndarray], float, int]:
    """The shard's rows that link with each row of ``q`` (unit, double), the audit's recall and its number of queries.

    ``own`` is the row that is the query itself, or -1. The audit scans the shard for the queries whose best other entry is nearest to
    the cosine of a link, where links are the easiest to miss, and for as many spread over the block. While too few of these links are found, all queries search again
    by a beam twice as wide; past the widest an exact pass over the shard decides.
    """
    x, least = shard.x, shard.least
    while True:
        if beam > WIDEST:
            found = [r for i in range(0, len(q), ROWS) for r in _scan(q[i : i + ROWS], x, least)]
            return found, 1.0, len(q)
        found, top = shard.search(q, beam)
        other = np.where(own >= 0, top[:, 1], top[:, 0])  # a query in the shard is its own best
        sample = np.union1d(np.argsort(np.abs(other - least), kind="stable")[:AUDIT], np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
        truth = _scan(q[sample], x, least)
        recall = _recall([found[k] for k in sample], truth, own[sample])
        if recall >= RECALL or beam >= shard.nodes:
            return found, recall, len(sample)
        beam *= 2


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def near_duplicates(vectors: DataFrame, least: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, with_recall: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``; with ``with_recall`` also recall, the least that an audit measured.

    ``n_links`` counts the other rows whose cosine with this one is ``least`` or more; ``component_id`` is the smallest vec_id
    that links reach, itself included; ``kept`` is whether it's the row's own. Vectors that are null, empty or zero, or hold null
    or non-finite components, link with nothing. Vectors of other lengths compare as if they ended in zeros. Repeated rows
    are rows, and link with each other. A null id takes part in links but is never the smallest. An empty table gives no rows; other
    columns, labels among them, aren't read.

    Equal vectors are one class from the start. Classes are dealt by a hash to shards of bounded size, and one task
    builds each shard's graph, in which near copies are members of one node, and widens its beam until planted probes, a little above ``least`` from a row, find that row. Every
    class then searches every shard, in blocks of bounded size, and each of these cells is audited on its own links: it returns each query's
    count of linked rows and a spanning forest of its links, so that no cell returns more rows than its block and
    shard have, however many pairs link. Components unite the forests. Links are symmetric but each side searches for itself: a
    link that only one side finds joins the components and counts for that side.
    """
    spark = vectors.sparkSession
    rows = keyed(vectors, vec_id, embedding)
    good = finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    slim = materialize(rows.select("vec_id", "k1", "k2", "good"), "rows")
    members = rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"))
    # A class is named by its key's hash: its ids may all be null. Floats travel as floats.
    kind = vectors.schema[embedding].dataType.simpleString()
    ship = "array<float>" if kind in ("array<float>", "array<tinyint>", "array<smallint>") else "array<double>"
    classes = materialize(members.withColumn("c", F.xxhash64("k1", "k2")).withColumn("v", F.col("v").cast(ship)), "classes")
    count, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        none = slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
        return none.withColumn("recall", F.lit(1.0)) if with_recall else none
    shard, block = min(shard, max(256, SHARD_BYTES // (8 * dims))), min(BLOCK, max(256, BLOCK_BYTES // (8 * dims)))
    shards = max(-(-count // shard), min(LEAST_SHARDS, max(1, count // LEAST_ROWS)))
    blocks = max(-(-count // block), min(LEAST_BLOCKS, max(1, count // (4 * LEAST_ROWS))))

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table["c"].to_numpy(), kind="stable")  # the order of rows in a shuffle isn't fixed
        v, c, n = matrix(table["v"], dims)[order], table["c"].to_numpy()[order], table["n"].to_numpy()[order]
        x = _unit(v)
        graph = Hnsw(x)
        beam, recall = audited_beam(Shard(graph, x, least))
        packed = _pack(c=c, n=n, v=v, beam=np.array(beam), **graph.links())
        return pa.table({"s": pa.array([table["s"][0].as_py()], pa.int32()), "recall": [recall], "graph": pa.array([packed], pa.binary())})

    dealt_out = celled(classes.select(dealt("c", shards).alias("s"), F.lit(0).alias("b"), "c", "n", "v"), shards, 1)
    graphs = materialize(dealt_out.groupBy("cell").applyInArrow(build, "s int, recall double, graph binary"), "graphs")

    def compare(graph: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"a": [np.zeros(0, np.int64)], "b": [np.zeros(0, np.int64)], "links": [np.zeros(0, bool)], "recall": [np.zeros(0)]}
        if graph.num_rows and queries.num_rows:
            order = np.argsort(queries["c"].to_numpy(), kind="stable")
            ids, q = queries["c"].to_numpy()[order], matrix(queries["v"], dims)[order]
            a = dict(np.load(io.BytesIO(graph["graph"][0].as_buffer())))
            x, c, n = _unit(a["v"]), a["c"], a["n"]
            graph_of = Shard(Hnsw.from_links(x, a), x, least)
            forest = Forest(len(q) + len(c))
            total = np.zeros(len(q), np.int64)
            at = np.minimum(np.searchsorted(c, ids), len(c) - 1)
            own = np.where(c[at] == ids, at, -1)
            recall = 1.0
            for i in range(0, len(q), TOGETHER):
                part = slice(i, i + TOGETHER)
                found, got, _ = shard_links(graph_of, _unit(q[part]), own[part], int(a["beam"]))
                recall = min(recall, got)
                for k, r in enumerate(found, i):
                    r = r[r != own[k]]
                    if len(r):
                        total[k] = n[r].sum()
                        forest.join_all(k, r + len(q))
            name = np.concatenate([ids, c])
            left, right = forest.links()
            some = np.flatnonzero(total)
            for k, v in (("a", [ids[some], name[left], [0]]), ("b", [total[some], name[right], [0]]), ("links", [np.zeros(len(some), bool), np.ones(len(left), bool), [False]])):
                out[k] += [np.asarray(y, out[k][0].dtype) for y in v]
            out["recall"] += [np.full(len(some) + len(left), np.nan), np.array([recall])]
        table = pa.table({k: np.concatenate(v) for k, v in out.items()})
        return table.set_column(3, "recall", pa.compute.if_else(pa.compute.is_nan(table["recall"]), None, table["recall"]))

    left = celled(graphs.select("s", each(blocks).alias("b"), "graph"), shards, blocks)
    right = celled(classes.select(each(shards).alias("s"), dealt("k1", blocks).alias("b"), "c", "v"), shards, blocks)
    cells = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(compare, "a long, b long, links boolean, recall double")
    cells = materialize(cells, "cells")
    lowest = min(x for x in (cells.agg(F.min("recall")).first()[0], graphs.agg(F.min("recall")).first()[0], 1.0) if x is not None)
    _log.info("audits of %d shards and %d blocks: recall at least %.4f", shards, blocks, lowest)
    cells = cells.where("recall is null")
    united = connected_components(cells.where("links").select("a", "b"))
    linked = cells.where("not links").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("others"))
    named = classes.select("k1", "k2", "c", "n", "first").join(linked, "c", "left").join(united.withColumnRenamed("node", "c"), "c", "left")
    named = materialize(named.select("k1", "k2", F.coalesce("component", "c").alias("component"), "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "named")
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_key = materialize(named.join(least_id, "component").select("k1", "k2", "n_links", "component_id"), "by_key")
    out = slim.join(by_key.withColumn("good", F.lit(True)), ["k1", "k2", "good"], "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    return out.withColumn("recall", F.lit(lowest)) if with_recall else out


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q
  ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.c, q.c) >= 0.9
), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT m.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.a = m.vec_id LEFT JOIN n ON n.a = m.vec_id
"""
