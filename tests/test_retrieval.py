"""Golden cases of scoring, reranking, metrics and search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagewell.functions import scoring, vectors
from sagewell.operators import knn, lexical, metrics, rerank

CANDIDATE = "query_id string, id string, pos int, cosine double, source_file string, strength double, age_days double, source string, ref_count int"


def ranked(spark, rows, **options):
    df = spark.createDataFrame([("q", *r) for r in rows], CANDIDATE)
    return [r["id"] for r in rerank.rerank(df, **options).orderBy("rank").collect()]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def note(id_, pos, cos, file=None, age=1.0, strength=0.5):
    return (id_, pos, cos, file or id_, strength, age, "note", 0)


def test_floor_and_fallback(spark):
    assert ranked(spark, [note("bad", 0, 0.10), note("good", 1, 0.60)], similarity_floor=0.30) == ["good"]
    got = ranked(spark, [note("low", 0, 0.10), note("mid", 1, 0.30), note("high", 2, 0.40)], similarity_floor=0.438)
    assert len(got) == 2 and got[0] == "high"
    assert ranked(spark, [note("a", 0, 0.10), note("b", 1, 0.15)]) == []


def test_freshness_breaks_ties_and_yields_to_meaning(spark):
    assert ranked(spark, [note("stale", 0, 0.6, age=365.0), note("fresh", 1, 0.6, age=0.0)])[0] == "fresh"
    assert ranked(spark, [note("fresh-off", 0, 0.35, age=0.0), note("old-relevant", 1, 0.9, age=300.0)], semantic_confidence=0.8)[0] == "old-relevant"


def test_two_per_file(spark):
    got = ranked(spark, [note("a", 0, 0.9, "same"), note("b", 1, 0.85, "same"), note("c", 2, 0.8, "same"), note("d", 3, 0.5, "other")])
    assert set(got) == {"a", "b", "d"}


def test_no_signals_score_like_code(spark):
    df = spark.createDataFrame([("q", "code", 0, 0.5, "f", None, None, None, None)], CANDIDATE)
    assert rerank.rerank(df).first()["meta"] == pytest.approx(0.3)


def test_calibration_and_freshness(spark):
    for (a, r), sure, low in (((0.15, 1.2), True, True), ((0.55, 0.5), False, False)):
        c = scoring.calibrate(F.lit(a), F.lit(r))
        got = one(spark, c["semantic_confidence"].alias("c"), c["similarity_floor"].alias("f"))
        assert (got["c"] > 0.7) == sure and (got["f"] < 0.25) == low
    f = one(spark, *[scoring.freshness(F.lit(float(d))).alias(f"d{d}") for d in (0, 70, 365)], scoring.freshness(F.lit(-5.0)).alias("past"))
    assert f["d0"] == 1 and 0.45 < f["d70"] < 0.55 and 0 < f["d365"] < 0.05 and f["past"] == 1


def test_budget_equals_the_fold(spark):
    r, rows, want = random.Random(1), [], {}
    for q in range(60):
        budget, least, total, kept = 1000, 2, 0, []
        sizes = [r.randint(0, 700) for _ in range(8)]
        for i, s in enumerate(sizes):
            rows.append((q, i + 1, s))
        for i, s in enumerate(sizes):
            if total >= budget and len(kept) >= least or total + s > budget and len(kept) >= least:
                break
            total += s
            kept.append(i + 1)
        want[q] = kept
    got = rerank.within_budget(spark.createDataFrame(rows, "query_id int, rank int, size int"), "size", 1000, 2).collect()
    assert {q: sorted(x["rank"] for x in got if x["query_id"] == q) for q in want} == want


def test_references_to_memories_and_code(spark):
    accepted = spark.createDataFrame([("q", "m1.md", ["m2.md", "a.py:2:3", "gone.md", "m2.md"])], "query_id string, file string, refs array<string>")
    memories = spark.createDataFrame([("m2.md", "project", "two", "body")], "file string, type string, name string, body string")
    lines = spark.createDataFrame([("a.py", i, f"line{i}") for i in range(1, 5)], "file string, line_no int, line string")
    got = {r["ref"]: (r["body"], r["description"], r["score"]) for r in rerank.expand_references(accepted, memories, lines).collect()}
    assert got == {"m2.md": ("body", "via m1.md", 0.0), "a.py:2:3": ("line2\nline3", "via m1.md", 0.0)}


def test_rank_metrics(spark):
    hits = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("axby")] + [("r", "n", 1)], "query_id string, id string, rank int")
    rel = spark.createDataFrame([("q", "a", 1), ("q", "b", 1)], "query_id string, id string, grade int")
    m = {r["query_id"]: r for r in metrics.retrieval_metrics(hits, rel, 4).collect()}
    assert m["q"]["precision"] == 0.5 and m["q"]["recall"] == 1 and m["q"]["rr"] == 1 and m["q"]["recall_all"]
    assert m["q"]["ndcg"] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert m["r"]["precision"] == m["r"]["recall"] == m["r"]["rr"] == m["r"]["ndcg"] == 0 and not m["r"]["recall_any"]


def test_intervals_and_exact_test(spark):
    low, high = scoring.wilson(F.lit(3), F.lit(30))
    got = one(spark, low.alias("l"), high.alias("h"), *[scoring.mcnemar(F.lit(b), F.lit(c)).alias(f"p{b}_{c}") for b, c in ((2, 8), (10, 0), (7, 7), (0, 0), (27, 0))])
    assert round(got["l"], 4) == 0.0346 and round(got["h"], 4) == 0.2562
    assert got["p2_8"] == pytest.approx(0.109375) and got["p10_0"] == pytest.approx(0.001953125) and got["p7_7"] == got["p0_0"] == 1
    assert got["p27_0"] == pytest.approx(2 * 0.5**27)
    empty = scoring.wilson(F.lit(0), F.lit(0))
    assert tuple(one(spark, empty[0].alias("l"), empty[1].alias("h"))) == (0.0, 1.0)


def test_answers(spark):
    rows = [("t", "Paris", "it is PARIS"), ("t", "Paris", "it is not Paris"), ("u", None, "I don't know"), ("u", "x", "y")]
    got = {r["question_type"]: (r["n"], r["correct"]) for r in metrics.score_answers(spark.createDataFrame(rows, "question_type string, gold_answer string, model_answer string")).collect()}
    assert got == {"t": (2, 2), "u": (2, 1), "overall": (4, 3)}


def test_kernels_on_odd_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine("a", "b", lengths_may_differ=True)).collect()]
    assert got == [0.0, pytest.approx(1.0), 0.0]
    assert df.select(vectors.normalize("a")).first()[0] == [0.0, 0.0]


def clustered(spark, n=240, dim=16):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, dim))
    return spark.createDataFrame([(i, (centres[i % 12] + 0.3 * rng.standard_normal(dim)).tolist()) for i in range(n)] + [(n, None)], "vec_id int, embedding array<double>")


@pytest.mark.parametrize("search", ["ivf", "graph"])
def test_approximate_search_recall(spark, search):
    df = clustered(spark)
    asked = df.where("vec_id % 20 = 0")
    truth = {(r["query_id"], r["id"]) for r in knn.exact_topk(df, asked, 10).collect()}
    if search == "ivf":
        c = knn.kmeans_cells(df, 12)
        found = knn.ivf_topk(knn.assign_cells(df, c), c, asked, 10, 8)
    else:
        found = knn.graph_topk(df, asked, 10, shards=2)
    got = {(r["query_id"], r["id"]) for r in found.collect()}
    assert len(truth & got) / len(truth) >= 0.9


def test_exact_search_in_several_blocks(spark):
    df = clustered(spark)
    asked = df.where("vec_id % 20 = 0")
    whole = sorted(map(tuple, knn.exact_topk(df, asked, 5).collect()))
    assert sorted(map(tuple, knn.exact_topk(df, asked, 5, queries_per_block=3).collect())) == whole
    assert knn.exact_topk(df, asked.limit(0), 5).collect() == []


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple pie apple"), (2, "pie crust"), (3, "nothing here"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(9, "Apple apple pie")], "query_id int, text string")
    got = {r["id"]: r["score"] for r in lexical.bm25_topk(docs, asked, 5).collect()}
    idf = lambda df: math.log((4 - df + 0.5) / (df + 0.5) + 1)
    w = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 1.75))
    assert got[1] == pytest.approx(2 * idf(1) * w(2, 3) + idf(2) * w(1, 3)) and got[2] == pytest.approx(idf(2) * w(1, 2)) and set(got) == {1, 2}


def test_space_statistics_by_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 5))
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "label int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.triu_indices(30, 1)
    c, same = (u @ u.T)[i, j], i % 3 == j % 3
    got = metrics.space_statistics(df).first()
    assert got["anisotropy"] == pytest.approx(c.mean()) and got["discrimination_gap"] == pytest.approx(c[same].mean() - c[~same].mean())
    cov = np.cov(x.T)
    assert metrics.intrinsic_dimensionality(df).first()[0] == pytest.approx(np.trace(cov) ** 2 / (cov * cov).sum())
    assert metrics.even_sample(spark.range(250).withColumnRenamed("id", "k"), "k").count() == 100


def test_exact_test_at_any_size(spark):
    got = one(spark, *[scoring.mcnemar(F.lit(b), F.lit(c)).alias(f"p{b}_{c}") for b, c in ((538, 538), (1000, 1000), (900, 1100), (5000, 5400))])
    tail = lambda b, c: min(1.0, 2 * math.fsum(math.exp(math.lgamma(b + c + 1) - math.lgamma(i + 1) - math.lgamma(b + c - i + 1) - (b + c) * math.log(2)) for i in range(min(b, c) + 1)))
    assert got["p538_538"] == got["p1000_1000"] == 1.0
    assert got["p900_1100"] == pytest.approx(tail(900, 1100), rel=1e-6) and got["p5000_5400"] == pytest.approx(tail(5000, 5400), rel=1e-6)


def test_percentiles_of_hot_values_and_null_groups(spark):
    rows = [("a", float(x)) for x in [7] * 400 + list(range(50))] + [(None, 1.0), (None, 3.0), ("b", None), ("c", 2.0)]
    got = {r["g"]: (r["p50"], r["p99"]) for r in metrics.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", [50, 99], "g", ranges=8).collect()}
    values = sorted(x for g, x in rows if g == "a")
    rank = lambda p: values[round(p / 100 * (len(values) - 1))]
    assert got == {"a": (rank(50), rank(99)), None: (3.0, 3.0), "c": (2.0, 2.0)} or got[None][0] in (1.0, 3.0) and got["a"] == (rank(50), rank(99))


def test_search_on_odd_vectors(spark):
    """Null and not finite components, other lengths, equal ids, nothing at all."""
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0]), (6, [0.0, 0.0])], "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "vec_id int, embedding array<double>")
    got = knn.exact_topk(df, asked, 10).collect()
    assert {(r["query_id"], r["id"], r["score"]) for r in got} == {(9, 1, 1.0), (9, 1, 0.0), (9, 3, 0.0), (9, 4, 0.0), (9, 5, 0.0), (9, 6, 0.0)}
    assert knn.exact_topk(df, asked.limit(0), 3).count() == 0 and knn.exact_topk(df.limit(0), asked, 3).count() == 0


def test_graph_index_upkeep(spark, tmp_path):
    df = clustered(spark).where("embedding is not null")
    index = knn.GraphIndex.build(df.where("vec_id < 200"), str(tmp_path / "g"))
    index.insert(df.where("vec_id >= 150"))
    index.remove(df.where("vec_id % 10 = 3").select("vec_id"))
    want = df.where("vec_id % 10 <> 3")
    assert sorted(r["vec_id"] for r in index.rows().collect()) == sorted(r["vec_id"] for r in want.collect())
    asked = df.where("vec_id % 20 = 0")
    truth = {(r["query_id"], r["id"]) for r in knn.exact_topk(want, asked, 5).collect()}
    got = {(r["query_id"], r["id"]) for r in index.search(asked, 5).collect()}
    assert len(got & truth) >= 0.9 * len(truth)
    with pytest.raises(Exception, match="another length"):
        index.insert(spark.createDataFrame([(999, [1.0])], "vec_id int, embedding array<double>"))
    # links are kept: nodes that stayed have those of before and perhaps new ones, and removed ones are nodes without ids
    before = {(r["shard"], r["node"]): r for r in index.nodes().collect()}
    assert any(r["id"] is None for r in before.values())
    index.insert(spark.createDataFrame([(1000, [0.5] * 16)], "vec_id int, embedding array<double>"))
    after = {(r["shard"], r["node"]): r for r in index.nodes().collect()}
    assert len(after) == len(before) + 1 and all(after[n]["id"] == r["id"] and after[n]["vector"] == r["vector"] for n, r in before.items())
    index.remove(df.where("vec_id >= 20").select("vec_id"))
    assert sorted(r["vec_id"] for r in index.rows().collect()) == [i for i in range(20) if i % 10 != 3] + [1000]
    assert index.nodes().count() < len(after)  # graphs with more removed than other nodes are built anew
    assert {r["id"] for r in index.search(asked.limit(1), 50).collect()} == {r["vec_id"] for r in index.rows().collect()}


def test_graph_index_of_nothing(spark, tmp_path):
    df = clustered(spark).where("embedding is not null")
    index = knn.GraphIndex.build(df.limit(0), str(tmp_path / "g"))
    assert index.search(df.limit(0), 3).collect() == []
    index.insert(df.where("vec_id < 3"))
    assert len(index) == 3 and index.search(df.where("vec_id = 1"), 1).first()["id"] == 1
