"""The kept inverted index against a scan of all documents, through insertions, replacements and removals."""

import random

import pytest
from pyspark.sql import functions as F

from sagewell.operators import lexical, postings
from sagewell.operators.postings import PostingsIndex

DOCS = "doc_id bigint, text string, term string, id string"


def some_docs(seed, ids, words=60, longest=30):
    rnd = random.Random(seed)
    return [(i, " ".join(f"w{min(rnd.randrange(words), rnd.randrange(words))}" for _ in range(rnd.randint(0, longest))), "x", "x") for i in ids]


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


QUERIES = ["w0 w1", "w40 w50 w55", "W3 w3 w7 nothing", "", "unknown", "w59", "w0 w1 w2 w3 w4 w5 w6"]


def same(spark, index, rows, k=5):
    queries = asked(spark, QUERIES)
    key = lambda r: (r["query_id"], r["rank"], r["id"], round(r["score"], 7))
    got = sorted(map(key, index.search(queries, k).collect()))
    assert got == sorted(map(key, lexical.bm25_topk(table(spark, rows), queries, k).collect()))
    return got


def test_equals_a_scan_of_all_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_DOCS", 20)
    rows = [*some_docs(1, range(500)), (700, None, "x", "x"), (701, "", "x", "x"), (702, "w0 " * 2000, "x", "x")]
    index = PostingsIndex.build(table(spark, rows), str(tmp_path / "index"))
    assert len(same(spark, index, rows)) > 20
    same(spark, index, rows, k=60)


def test_reads_fewer_postings_than_there_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_DOCS", 10)
    rows = some_docs(2, range(1200), words=400)
    index = PostingsIndex.build(table(spark, rows), str(tmp_path / "index"))
    queries = asked(spark, ["w1 w300", "w2 w250", "w3 w350"])
    needed, could, _ = index.plan(queries, 5)
    size = lambda df: df.agg(F.sum("size")).first()[0]
    assert size(needed) < 0.5 * size(could)
    same(spark, index, rows)


def test_insert_replace_remove_and_compact(spark, tmp_path):
    rows = {r[0]: r for r in some_docs(3, range(200))}
    index = PostingsIndex.build(table(spark, list(rows.values())), str(tmp_path / "index"))
    new = some_docs(4, range(150, 260))
    index.insert(table(spark, new))
    rows |= {r[0]: r for r in new}
    same(spark, index, list(rows.values()))
    index.remove(spark.createDataFrame([(i,) for i in [*range(0, 200, 3), 9999]], "doc_id bigint"))
    rows = {i: r for i, r in rows.items() if not (i < 200 and i % 3 == 0)}
    same(spark, index, list(rows.values()))
    again = some_docs(5, [0, 3, 151])
    index.insert(table(spark, again))
    rows |= {r[0]: r for r in again}
    before = same(spark, index, list(rows.values()))
    assert len(index.generations()) == 4
    assert same(spark, index.compact(), list(rows.values())) == before
    assert len(index.generations()) == 1 and index.dead() is None
    index.remove(spark.createDataFrame([(0,)], "doc_id bigint"))
    del rows[0]
    same(spark, PostingsIndex(spark, str(tmp_path / "index")), list(rows.values()))


def test_an_insertion_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    rows = some_docs(6, range(80))
    index = PostingsIndex.build(table(spark, rows), str(tmp_path / "index"))
    with monkeypatch.context() as m:
        m.setattr(PostingsIndex, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.insert(table(spark, some_docs(7, range(50))))
    same(spark, index, rows)
    index.insert(table(spark, some_docs(8, [500])))
    same(spark, index, rows + some_docs(8, [500]))


def test_odd_rows_and_nothing_at_all(spark, tmp_path):
    rows = [(1, "b b a", "x", "x"), (1, "a", "x", "x"), (None, "a", "x", "x"), (2, None, "x", "x")]
    index = PostingsIndex.build(table(spark, rows), str(tmp_path / "index"))
    got = index.search(asked(spark, ["a b", None]), 3).collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(0, 1)]
    assert index.search(asked(spark, []), 3).collect() == []
    empty = PostingsIndex.build(table(spark, []), str(tmp_path / "empty"))
    assert empty.search(asked(spark, ["a"]), 3).collect() == []
    empty.insert(table(spark, [(5, "a", "x", "x")]))
    assert [r["id"] for r in empty.search(asked(spark, ["a"]), 3).collect()] == [5]


def test_a_block_is_shuffled_once_whatever_number_of_queries_want_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_DOCS", 50)
    monkeypatch.setattr(postings, "QUERIES_AT_ONCE", 3)
    rows = some_docs(9, range(300), words=20)
    index = PostingsIndex.build(table(spark, rows), str(tmp_path / "index"))
    index.insert(table(spark, some_docs(10, range(0, 300, 4), words=20)))
    queries = asked(spark, ["w0 w1 w2 w3 w3"] * 8)
    needed, _, mean = index.plan(queries, 4)
    best = index._best(needed, mean, 4)
    counts = best.groupBy("query_id").count().collect()
    assert len(counts) == 8 and max(r["count"] for r in counts) <= 4 * needed.select("generation", "range").distinct().count()
    hits = index.search(queries, 4).collect()
    assert len({tuple((r["rank"], r["id"], r["score"]) for r in hits if r["query_id"] == q) for q in range(8)}) == 1 and len(hits) == 32


def test_a_range_in_two_pieces(spark, tmp_path):
    rows = some_docs(11, range(90), words=15)
    index = PostingsIndex.build(table(spark, rows), str(tmp_path / "index"))
    forward = spark.read.parquet(f"{index.folder}/docs/0").repartition(5)
    index._write_blocks(forward, 0, 1)
    assert forward.select("range").distinct().count() == 1 and index._read("blocks").groupBy("term").count().agg(F.max("count")).first()[0] > 1
    same(spark, index, rows)
