"""Vector operators, components and the pipeline against brute force and on edge cases."""

import math

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from barforge.llm import embedding_neardup, hnsw, topk, vectors
from barforge.llm.components import connected_components
from barforge.llm.queries import ORACLES, QUERIES


def plain_links(rows, least=0.9):
    """n_links and component of each row by all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = max((len(rows[i][1]) for i in ok), default=1)
    x = np.array([[*rows[i][1], *[0.0] * (dims - len(rows[i][1]))] for i in ok]).reshape(len(ok), dims)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(ok) else x
    near = x @ x.T >= least
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    links = [0] * len(rows)
    for a, b in zip(*np.nonzero(near), strict=True):
        if a != b:
            links[ok[a]] += 1
            p, q = root(ok[a]), root(ok[b])
            up[p] = q
    least_id = {}
    for i, (k, _) in enumerate(rows):
        least_id[root(i)] = min(least_id.get(root(i), k), k)
    return sorted((k, links[i], least_id[root(i)]) for i, (k, _) in enumerate(rows))


def rows_of(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("K1", F.lit("x"))


@pytest.fixture(scope="module")
def clustered():
    """Groups of near copies, of 1 to 300 members, and exact copies."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    v = [c + 0.05 * rng.normal(size=24) for c, n in zip(centres, [300, 60, 20, *[1] * 37], strict=True) for _ in range(n)]
    v += [v[0]] * 50 + [3 * v[400]] * 2
    v += list(rng.normal(size=(200, 24)))
    order = rng.permutation(len(v))
    return [(int(k), [float(x) for x in v[i]]) for k, i in enumerate(order)]


def test_keys_deal_each_cell_to_its_own_partition(spark):
    for n in (1, 7, 24, 211):
        keys = spark.createDataFrame([(k,) for k in vectors.cell_keys(n)], "cell int").repartition(n, "cell")
        assert [len(p) for p in keys.rdd.glom().collect()] == [1] * n


def test_the_audit_sees_missing_links():
    """Rare pairs beside a dense group: a graph whose links are cut fails the audit, and what it misses is found all the same."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centre = rng.normal(size=(1, 32))
    rare = rng.normal(size=(150, 32))
    x = unit(np.concatenate([centre + 0.05 * rng.normal(size=(1500, 32)), rng.normal(size=(1500, 32)), rare, rare + 0.25 * rng.normal(size=rare.shape)]))
    probe = embedding_neardup.probes(x, 0.9)
    assert (np.max(probe @ x.T, axis=1) >= 0.9).all()
    shard = embedding_neardup.Shard(hnsw.Hnsw(x), x, 0.9)
    truth = embedding_neardup._scan(x, x, 0.9)
    pairs = lambda found: sum(len(f) for f in found[3000:])
    beam, recall = embedding_neardup.audited_beam(shard)
    assert recall >= embedding_neardup.RECALL and beam <= embedding_neardup.WIDEST
    found, recall, n = embedding_neardup.shard_links(shard, x, np.arange(len(x)), beam)
    assert n and recall >= embedding_neardup.RECALL and pairs(found) >= 0.99 * pairs(truth) > 3 * 150
    assert sum(map(len, found[:1500])) >= 0.999 * sum(map(len, truth[:1500]))
    broken = hnsw.Hnsw(x, merge=2.0)
    broken.near = [np.where(rng.random(a.shape) < 0.97, -1, a).astype(np.int32) for a in broken.near]
    shard = embedding_neardup.Shard(broken, x, 0.9)
    beam = embedding_neardup.audited_beam(shard)[0]
    assert beam > embedding_neardup.BEAM
    found, recall, n = embedding_neardup.shard_links(shard, x, np.arange(len(x)), beam)
    assert recall == 1.0 and n == len(x) and pairs(found) == pairs(truth)


def test_links_equal_brute_force(spark, clustered):
    got = embedding_neardup.near_duplicates(rows_of(spark, clustered)).collect()
    want = plain_links(clustered)
    found, all_ = sum(r["n_links"] for r in got), sum(n for _, n, _ in want)
    assert found >= 0.98 * all_ and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert sorted((r["vec_id"], r["component_id"]) for r in got) == [(k, c) for k, _, c in want]
    assert embedding_neardup.near_duplicates(rows_of(spark, clustered), with_recall=True).first()["recall"] >= embedding_neardup.RECALL
    by_id = {r["vec_id"]: r["n_links"] for r in got}
    assert all(by_id[k] <= n for k, n, _ in want)


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Hnsw(x)
    ids, _ = g.search(x[:200], 128)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) > 0.85
    again = hnsw.Hnsw.from_links(x, hnsw.Hnsw(x).links())
    assert (again.near[0] == g.near[0]).all()


ODD = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]), (10, [0.0, -1.0]), (50, [1e200, 1e190])]


def test_links_on_odd_rows(spark):
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_neardup.near_duplicates(rows_of(spark, ODD)).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 4, 7), (7, 4, 7), (8, 4, 7), (9, 4, 7), (10, 0, 10), (50, 4, 7)]
    assert embedding_neardup.near_duplicates(rows_of(spark, [])).count() == 0


def plain_topk(vectors, k=5):
    """Rows are rows; those of one query id ask together and are no candidates of it."""
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), i) for j, u in rows if j == q for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def ask(df):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())


def test_topk_equals_brute_force(spark, clustered):
    assert ask(rows_of(spark, clustered)) == plain_topk(clustered)


def test_topk_on_odd_rows(spark):
    odd = [*[(i, v) for i, v in ODD if i != 50], (50, [1.0, 1.0]), (100, [0.5, -3.0]), (100, [0.5, -3.0])]
    assert ask(rows_of(spark, odd)) == plain_topk(odd)
    assert ask(rows_of(spark, [])) == [] == ask(rows_of(spark, [(1, [1.0])])) == ask(rows_of(spark, [(50, [1.0])]))


def test_topk_on_repeated_rows_and_ids(spark, duck):
    two = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (8, [2.0, 0.0]), (9, [-1.0, 0.0])]
    many = [(100, [float(i), 1.0]) for i in range(40)] + [(i, [0.5 * i, 0.0]) for i in range(1, 4)] + [(150, [3.0, 1.0])] * 3
    rng = np.random.default_rng(9)
    mixed = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 300, 900), rng.integers(-2, 3, (900, 3)), strict=True)]
    for rows in (two, many, two + many, mixed):
        got = ask(rows_of(spark, rows))
        assert got == plain_topk(rows)
        duck.sql("CREATE OR REPLACE TEMP TABLE own(vec_id BIGINT, embedding DOUBLE[])")
        duck.executemany("INSERT INTO own VALUES (?, ?)", rows)
        assert got == sorted(duck.sql(ORACLES["op10_topk"].replace("FROM embeddings", "FROM own")).fetchall())


def test_topk_scores_beyond_doubles_are_exact_or_raise(spark):
    big = [(50, [2.0**20, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 5.0]), (3, [0.0, 1.0])]
    assert ask(rows_of(spark, big)) == plain_topk(big)
    for x in (2.0**30, 1e200, 1e308):
        with pytest.raises(Exception, match="OverflowError"):
            ask(rows_of(spark, [(50, [x, 1.0]), (1, [x, 1.0])]))


def test_uniform_threshold_is_safe():
    rng = np.random.default_rng(5)
    for _ in range(30):
        q, x = rng.integers(-9, 9, (3, 12)), rng.integers(-9, 9, (50, 12))
        parts = topk.partial_scores(q, x)
        total = parts.sum(0)
        assert (total == q @ x.T).all()
        bounds = topk.safe_bounds(parts, 4)
        best = -np.sort(-total, axis=1)[:, :4]
        assert (bounds <= best).all()
        enough = topk.sufficient(parts, bounds[:, 3])
        assert (enough | (total < bounds[:, 3:4])).all()
        out = rng.random((3, 50)) < 0.5
        best = -np.sort(-np.where(out, topk.NONE, total), axis=1)[:, :4]
        assert (topk.safe_bounds(parts, 4, out) <= best).all()


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(500)] + [(1000 + i, 1000) for i in range(1, 200)] + [(5, 5), (None, 3), (7, None), (2, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(501)}, **{1000 + i: 1000 for i in range(200)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["op1_embedding_neardup", "op10_topk"])
def test_equals_sql(name, spark, sf_dir, duck):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    import public_tokenizers

    from barforge.llm import bpe, pii

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == docs.columns, name
        if name == "near_duplicates":
            assert 0.5 * docs.count() < after.count() < docs.count()
        elif name == "personal_data":
            assert not any(pii.find(r["text"]) for r in after.collect())
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    back = sorted((r["doc_id"], r["text"]) for r in bpe.decode(last, ranks).collect())
    assert back == sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()


def test_pipeline_equals_a_plain_one(spark, sf_dir):
    """Each stage once more, document by document."""
    import hashlib
    import re
    from collections import Counter

    import corpus_pipeline
    import public_tokenizers
    import tiktoken
    from test_texts import plain_components, plain_fingerprint, plain_targets

    from barforge.llm import bpe, langid, pii

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [r.asDict() for r in table.collect()]
    model = langid.train(table)
    docs = [d for d in docs if not langid.judge(model, [d["text"] or ""])[3][0]]
    group = plain_components({d["doc_id"]: plain_fingerprint(d["text"]) for d in docs})
    docs = [d for d in docs if group[d["doc_id"]] == d["doc_id"]]
    for d in docs:
        out, at = "", 0
        for s in sorted(pii.find(d["text"]), key=lambda s: (s.start, pii.KINDS.index(s.kind))):
            if s.start >= at:
                out += d["text"][at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.end)
        d["text"] = out + d["text"][at:]
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs}
    sources = sorted({d["source"] for d in docs})
    of_source = [sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in sources]
    target = dict(zip(sources, plain_targets(of_source, [(3, 1, 2)[i % 3] for i in range(len(sources))]), strict=True))
    rate = {s: target[s] / n if n else 0.0 for s, n in zip(sources, of_source, strict=True)}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for d in docs:
        whole, part = divmod(rate[d["source"]], 1)
        draw = int(hashlib.md5(f"mix-1:{d['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        want[d["doc_id"], tuple(ref.encode_ordinary(d["text"]))] += int(whole) + (draw < part)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == +want


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (3, "plain words in a row", "en", "a", 20), (3, "plain words in a row", "en", "a", 20), (None, "plain words again here", "en", "b", 22)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs.count()
