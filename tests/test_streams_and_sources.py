"""Keyed inbox state, ignore rules, chunking plug-ins, pooled embedders and answers of mixed kinds."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagewell.operators import chunking, embed, lifecycle
from sagewell.operators.rerank import cut_bytes
from sagewell.plans import experiments, recall
from sagewell.plans.config import Config
from sagewell.sources import files, ignore
from sagewell.streaming import inbox as stream


@pytest.mark.parametrize("parts", [1, 4])
def test_keyed_inbox_equals_batch(spark, tmp_path, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["a", "b", "c"]), f"i{i}", rnd.choice([0.1, 0.5, 0.9, 1.0]), i) for i in range(60)]
    src = tmp_path / "in"
    for p in range(parts):
        spark.createDataFrame(rows[p::parts], stream.STATE).coalesce(1).write.mode("append").parquet(str(src))
    items = spark.readStream.schema(stream.STATE).option("maxFilesPerTrigger", 1).parquet(str(src))
    stream.start_keyed_inbox(items, str(tmp_path / "out"), str(tmp_path / "ck"), 5).awaitTermination(120)
    changes = spark.read.schema(stream.CHANGES).parquet(str(tmp_path / "out"))
    key = lambda r: (r["key"], r["place"], r["id"], r["attention_score"])
    batch = lifecycle.inbox(spark.createDataFrame(rows, stream.STATE), 5, by=["key"])
    assert sorted(map(key, stream.current_inbox(changes).collect())) == sorted(map(key, batch.collect()))
    assert {r["event"] for r in changes.collect()} <= {"items", "full"}


def test_a_key_without_new_items_goes_stale(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "x", 0.5, 1)], stream.STATE).coalesce(1).write.parquet(str(src))
    items = spark.readStream.schema(stream.STATE).parquet(str(src))
    query = stream.start_keyed_inbox(items, str(tmp_path / "out"), str(tmp_path / "ck"), 5, stale_days=0.1 / 86_400, processingTime="1 second")
    try:
        for _ in range(40):
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists() and {r["event"] for r in spark.read.schema(stream.CHANGES).parquet(str(tmp_path / "out")).collect()} == {"items", "stale"}:
                break
        else:
            raise AssertionError("no timer rang")
    finally:
        query.stop()


PATHS = ["a.log", "src/a.log", "src/keep.log", "build/x.py", "src/build/y.py", "src/build.py", "docs/a/b/c.md", "docs/c.md", "lib/z1.txt", "lib/z12.txt", "lib/zz.txt", "deep/er/note.tmp", "deep/er/most.tmp", "w ei[1]rd.txt", "a/b", "x+y.txt"]


@pytest.mark.parametrize(
    ("lines", "gone"),
    [
        ([("", "*.log")], ["a.log", "src/a.log", "src/keep.log"]),
        ([("", "*.log"), ("", "!keep.log")], ["a.log", "src/a.log"]),
        ([("", "*.log"), ("src", "!*.log")], ["a.log"]),
        ([("", "build/")], ["build/x.py", "src/build/y.py"]),
        ([("", "/build")], ["build/x.py"]),
        ([("", "build/"), ("", "!y.py"), ("src/build", "!y.py")], ["build/x.py", "src/build/y.py"]),
        ([("", "docs/**/c.md")], ["docs/a/b/c.md", "docs/c.md"]),
        ([("", "docs/**")], ["docs/a/b/c.md", "docs/c.md"]),
        ([("", "docs/*.md")], ["docs/c.md"]),
        ([("", "**/er/*.tmp"), ("deep/er", "!n*")], ["deep/er/most.tmp"]),
        ([("lib", "z?.txt"), ("", "# no rule"), ("", "   ")], ["lib/z1.txt", "lib/zz.txt"]),
        ([("", "z[0-9].txt")], ["lib/z1.txt"]),
        ([("", "z[!0-9].txt")], ["lib/zz.txt"]),
        ([("", r"w ei\[1\]rd.txt"), ("", "x+y.txt  ")], ["w ei[1]rd.txt", "x+y.txt"]),
        ([("a", "b")], ["a/b"]),
        ([("deep", "er/")], ["deep/er/note.tmp", "deep/er/most.tmp"]),
        ([], []),
    ],
)
def test_ignore_rules(spark, lines, gone):
    rules = ignore.parse_rules(spark.createDataFrame([(f, i, x) for i, (f, x) in enumerate(lines)], "folder string, place int, line string"))
    paths = spark.createDataFrame([(p,) for p in [*PATHS, None]], "file string")
    assert sorted(r["file"] for r in ignore.ignored(paths, rules).collect()) == sorted(gone)


def test_code_trees_with_ignore_files(spark, tmp_path):
    for name, text in {".gitignore": "*.tmp\n/skip/\n", "src/.gitignore": "!kept.tmp\n", "a.py": "x", "b.tmp": "x", "skip/c.py": "x", "src/kept.tmp": "x", "src/other.tmp": "x", "src/d.md": "x", ".hidden/e.py": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    read = lambda **how: sorted(r["file"] for r in files.read_code(spark, str(tmp_path), **how).collect())
    assert read() == ["a.py", "src/d.md", "src/kept.tmp"]
    assert read(ignore_files=False) == ["a.py", "b.tmp", "skip/c.py", "src/d.md", "src/kept.tmp", "src/other.tmp"]
    assert read(include=["*.py", "src/*.md"], ignore_rules=["d.*"]) == ["a.py"]


def test_plugin_chunks_keep_columns_and_order_of_files(spark):
    df = spark.createDataFrame([("a", "one\ntwo", 1), ("b", None, 2), (None, "three", 3), ("a", "four", 4)], "file string, content string, extra int")
    rule = lambda t, f: [(i + 1, i + 1, f + line) for i, line in enumerate(t.split("\n")) if line]
    want = [("a", 1, "aone"), ("a", 1, "atwo"), ("None", 3, "three"), ("a", 4, "afour")]
    for by_file in (False, True):
        got = chunking.custom_chunks(df, "file", "content", rule, by_file).collect()
        assert sorted((str(r["file"]), r["extra"], r["content"]) for r in got) == sorted(want)
    assert chunking.custom_chunks(df.limit(0), "file", "content", rule).collect() == []


def test_pooled_embedder_by_hand():
    model = lambda ids, mask: np.stack([ids, ids**2, np.ones_like(ids)], axis=-1) + 100 * ~mask[:, :, None]
    f = embed.pooled_embedder(lambda t: [len(w) for w in t.split()], model, max_tokens=3, micro_batch=2)()
    got = f(["a bb ccc dddd", "", "a", "bb bb bb", "ccc"])
    means = [[2, 14 / 3, 1], [0, 0, 0], [1, 1, 1], [2, 4, 1], [3, 9, 1]]
    for g, m in zip(got, means, strict=True):
        assert np.allclose(g, np.array(m) / (np.linalg.norm(m) or 1))
    assert f([]).size == 0


def test_answers_of_mixed_kinds(spark):
    raw = {'["a", 7, "b"]': "a, b", "[1, 2]": None, "[]": None, '"x"': "x", "7": "7", "7.5": "7.5", "null": None, "true": "true", '[null, "n", ["deep"], {"k": "v"}]': "n", '{"k": 1}': '{"k":1}', '["1", "2"]': "1, 2"}
    df = spark.createDataFrame([(k,) for k in raw], "raw string")
    got = {r["raw"]: r["a"] for r in df.select("raw", files.answer_text(F.col("raw")).alias("a")).collect()}
    assert {k: (v or "").replace(" ", "") for k, v in got.items()} == {k: (v or "").replace(" ", "") for k, v in raw.items()}


def test_consolidation_embeds_only_what_is_new(spark):
    schema = "file string, name string, type string, description string, body string, strength double, created_at string, last_accessed string, access_count int, source string, refs array<string>"
    old = spark.createDataFrame([(f"user_{x}.md", x, "user", "", f"body {x}", 2.0, "2024-01-01", None, 9, "note", []) for x in "ab"], schema)
    vec = spark.createDataFrame([("user_a.md", [1.0, 0.0]), ("gone.md", [0.0, 1.0])], "id string, embedding array<float>")
    items = spark.createDataFrame([("n-1", "new item", "note", 0.9, "2024-01-01", None, 1)], "id string, content string, source string, attention_score double, created_at string, file_source struct<file:string,start_line:int,end_line:int,kind:string>, arrival bigint")
    done = recall.consolidate(old, vec, items, "2024-01-02T00:00:00")
    assert sorted(map(tuple, done["rebuilt"].collect())) == [("embed", 2), ("index", 3)]
    vectors = {r["id"]: r["embedding"] for r in done["vectors"].collect()}
    assert len(vectors) == 3 and vectors["user_a.md"] == [1.0, 0.0] and len(vectors["user_b.md"]) == 256


def test_bytes_are_cut_between_letters(spark):
    texts = ["short", "x" * 20, "ééééééé", "漢字漢字漢字", "🙂🙂🙂🙂", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (5, 8, 11):
        for r in df.select("t", cut_bytes(F.col("t"), most).alias("c")).collect():
            raw = (r["t"] or "").encode()
            want = r["t"] if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "..."
            assert r["c"] == want


def test_context_rows(spark):
    turns = [("user", "hello"), ("assistant", "hi")]
    sessions = spark.createDataFrame([("s1", turns, "2024-01-01"), ("s2", turns[:1], None)], "session_id string, turns array<struct<role:string,content:string>>, date string")
    queries = spark.createDataFrame([("q1", "kind", "what", None, "ans", ["s1"]), ("q2", None, "who", "d", None, None)], "query_id string, question_type string, question string, question_date string, answer string, gold_ids array<string>")
    hits = spark.createDataFrame([("q1", "s2", 1), ("q1", "s1", 2), ("q1", "lost", 3)], "query_id string, id string, rank int")
    got = {r["question_id"]: r for r in experiments.context_rows(queries, hits, sessions).collect()}
    assert got["q1"]["retrieved_context"] == ["user: hello", "[Date: 2024-01-01]\nuser: hello\nassistant: hi"]
    assert got["q1"]["retrieved_session_ids"] == ["s2", "s1", "lost"] and got["q1"]["retrieval_hit"]
    assert got["q2"]["retrieved_context"] == [] and not got["q2"]["retrieval_hit"] and got["q2"]["gold_session_ids"] == []


def test_recall_without_an_embedder_is_by_text(spark):
    asked = spark.createDataFrame([("q", "apple")], "id string, text string")
    index = spark.createDataFrame([("Apple pie", "a.md", "x"), ("pear", "b.md", "y")], "title string, file string, summary string")
    for how in ({"offline": True}, {"config": Config({"embedding": {"provider": "none"}})}, {"config": Config({"embedding": {"provider": "all-MiniLM-L6-v2"}})}, {}):
        rows, mode = recall.recall_asked(asked, index, None, None, "2024-01-01", **how)
        assert mode == "text" and [r["file"] for r in rows.collect()] == ["a.md"]
    assert embed.embedder_name("all-MiniLM-L6-v2") == "sentence-transformers/all-MiniLM-L6-v2" and embed.known_embedder("hash")
