"""Steps whose results or costs must hold beyond small tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sagewell.operators import knn, lexical, lifecycle, simjoin
from sagewell.plans import experiments

SCHEMA = "vec_id bigint, embedding array<double>"


def table(spark, m, first=0):
    return spark.createDataFrame([(first + i, x) for i, x in enumerate(m.tolist())], SCHEMA)


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_cells_are_fitted_on_all_rows(spark):
    m = np.random.default_rng(3).standard_normal((100_200, 2)) + [0.5, 0]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, x) for i, x in enumerate(m.tolist())], 4), SCHEMA)
    assert np.allclose(knn.kmeans_cells(df, 5, 3), knn.lloyd(m, m[:5], 3), atol=1e-12, rtol=0)


def test_links_of_a_graph_follow_from_all_earlier_nodes(spark):
    m = np.random.default_rng(4).standard_normal((400, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    whole, parts = knn.GraphShard(m=4), knn.GraphShard(m=4)
    whole.extend(m)
    for at in range(0, 400, 130):
        parts.extend(m[at : at + 130])
    assert whole.links == parts.links and whole.entry == parts.entry
    assert max(len(x[0]) for x in whole.links) == 8


def test_large_shards_become_more(spark, monkeypatch):
    m = np.random.default_rng(5).standard_normal((600, 8))
    df = table(spark, m)
    monkeypatch.setattr(knn, "SHARD_ROWS", 25)
    assert len(hits(knn.graph_topk(df, df.limit(1), 30, shards=2))) == 30
    seen = knn.graph_topk(df, df.limit(1), 600, shards=2).count()
    assert seen == 600  # all of 24 shards, each of which one beam covers


def test_all_pairs_by_slices_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = np.concatenate([rng.standard_normal((3000, 16)), np.tile(rng.standard_normal((1, 16)), (20, 1))])
    df = table(spark, m)
    monkeypatch.setattr(simjoin, "EXACT_ROWS", 700)
    want = {(r["query_id"], r["id"]) for r in knn.exact_topk(df, df, 5, exclude_self=True).where("score >= 0.25").collect()}
    got = {(r["a"], r["b"]): r["score"] for r in lifecycle.associate_all(df, 0.25, 5, exact=True).collect()}
    assert set(got) == {(min(p), max(p)) for p in want}


def test_blocks_of_queries_broadcast_counts_and_no_matrix(spark, monkeypatch):
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} w{i % 5}") for i in range(300)], "doc_id bigint, text string")
    got = lexical.bm25_topk(docs, docs.select(F.col("doc_id").alias("query_id"), "text"), 3, queries_per_block=150)
    assert {r["query_id"] for r in got.where("id = query_id").collect()} == set(range(300))
    blocks = [v for v in sent if isinstance(v, tuple)]
    assert len(blocks) == 2 and all(np.ndim(x) <= 1 for v in blocks for x in v[1:])


def test_graph_finds_copies_with_their_vector(spark, tmp_path):
    rng = np.random.default_rng(21)
    base = rng.standard_normal((40, 8))
    rows = [(i, base[i % 40].tolist()) for i in range(2400)]  # sixty copies of each: more than a node has links
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id < 40")
    key = lambda d: sorted((r["query_id"], r["rank"], r["id"]) for r in d.collect())
    truth = key(knn.exact_topk(df, asked, 70))
    index = knn.GraphIndex.build(df.where("vec_id % 3 > 0"), str(tmp_path / "graph"))
    index.insert(df.where("vec_id % 3 < 2"))
    assert key(index.search(asked, 70)) == truth
    assert key(knn.graph_topk(df, asked, 70)) == truth
    index.remove(df.where("vec_id < 400").select("vec_id"))
    assert key(index.search(asked, 10)) == key(knn.exact_topk(df.where("vec_id >= 400"), asked, 10))


def test_versions_of_topics_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(experiments, "TOPIC_ROWS", 10)
    seen, search = [], knn.exact_topk
    monkeypatch.setattr(experiments.knn, "exact_topk", lambda vectors, *a: seen.append(vectors.rdd.glom().map(len).collect()) or search(vectors, *a))
    topics = spark.createDataFrame([(i, f"alpha beta w{i} gamma delta w{i + 1}", f"w{i} beta") for i in range(100)], "topic int, text string, question string").coalesce(1)
    assert experiments.freshness_experiment(topics).count() == 1
    assert len(seen[0]) == 30 and sum(seen[0]) == 300 and max(seen[0]) <= 40


def test_rows_found_do_not_grow_with_blocks_times_partitions(spark, monkeypatch):
    found, ranked = [], knn.ranked
    monkeypatch.setattr(knn, "ranked", lambda rows, k: found.append(rows.count()) or ranked(rows, k))
    df = table(spark, np.random.default_rng(31).standard_normal((400, 8)))
    whole = hits(knn.exact_topk(df.coalesce(1), df, 3))
    assert hits(knn.exact_topk(df.repartition(40), df, 3, "vec_id", "embedding", False, 10)) == whole
    # forty blocks of ten queries: one task each, and not forty
    assert found[1] == 400 * 3


def test_runs_of_like_rows_meet_queries_by_their_largest_components(spark, monkeypatch):
    rng = np.random.default_rng(32)
    base = rng.random((900, 24)) ** 6
    rows = np.repeat(base, 3, axis=0) * (1 - 0.3 * (rng.random((2700, 24)) < 0.1))
    rows[30:90] = rows[30]  # a run of equal rows, of which the smallest ids stay
    asked = base[:60] * (rng.random((60, 24)) < 0.7)
    asked[0] = 0
    products, near = [], knn.Best._near_runs
    monkeypatch.setattr(knn.Best, "_near_runs", lambda self, part, m32, begins, *a: products.append((len(begins), len(m32))) or near(self, part, m32, begins, *a))

    def best(q):
        b = knn.Best(knn._unit(q), 7, pa.int64())
        for at in range(0, 2700, 300):
            b.add(pa.array(np.arange(at, at + 300)), knn._unit(rows[at : at + 300]))
        return [tuple(x) for x in zip(*(np.asarray(c).tolist() for c in b.merge()), strict=True)]

    def plain(q):
        s = np.round(knn._unit(q) @ knn._unit(rows).T, 12)
        return [(i, s[i, j], int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(2700), -s[i]))[:7]]

    key = lambda out: [(i, round(float(s), 9), j) for i, s, j in out]
    assert key(best(asked)) == key(plain(asked))
    assert len(products) == 8 and all(runs <= 0.6 * n for runs, n in products)
    signed = asked - 0.05  # components below zero: row by row
    assert key(best(signed)) == key(plain(signed)) and len(products) == 8
