"""Chunking, upkeep, quantisation, files and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagewell.functions import scoring
from sagewell.operators import chunking, embed, lifecycle, quantize, store
from sagewell.plans import recall
from sagewell.plans.config import Config
from sagewell.sources import binary, files
from sagewell.streaming import inbox as stream


def paragraphs_by_fold(text, most, least, overlap):
    lines = text.split("\n")[: -1 if text.endswith("\n") else None] if text else []
    if len(lines) < least:
        return []
    runs, out, run = [], [], None
    for i, x in enumerate(lines):
        if x.strip():
            runs[-1:] = [(runs[-1][0], i)] if runs and runs[-1][1] == i - 1 else [*runs[-1:], (i, i)]
    for s, e in runs:
        if e - s + 1 > most:
            out += [run] if run else []
            run = None
            while True:
                last = min(s + most - 1, e)
                out.append((s, last))
                if last == e:
                    break
                s = last + 1 - overlap
        elif run and e - run[0] + 1 <= most:
            run = (run[0], e)
        else:
            out += [run] if run else []
            run = (s, e)
    return out + ([run] if run and run[1] - run[0] + 1 >= least else [])


def test_paragraphs_equal_the_fold(spark):
    r = random.Random(6)
    texts = [(i, "\n".join(r.choice(["x", "y", "", " "]) if r.random() < 0.7 else "z" for _ in range(r.randint(0, 40))) + r.choice(["", "\n"])) for i in range(80)] + [(99, ""), (98, None)]
    df = spark.createDataFrame(texts, "file int, content string")
    got = chunking.paragraph_chunks(df, "file", "content", 5, 3, 2).collect()
    for i, t in texts:
        assert sorted((x["start_line"] - 1, x["end_line"] - 1) for x in got if x["file"] == i) == sorted(paragraphs_by_fold(t or "", 5, 3, 2)), (i, t)
    with pytest.raises(ValueError):
        chunking.paragraph_chunks(df, "file", "content", 5, 3, 5)


def test_fixed_windows_and_custom_ones(spark):
    df = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(20)) + "\n"), ("g", "a\nb")], "file string, content string")
    got = sorted((r["chunk_id"], r["content"].split("\n")[0]) for r in chunking.fixed_chunks(df, "file", "content", 10, 2, 3).collect())
    assert got == [("f:17:20", "l16"), ("f:1:10", "l0"), ("f:9:18", "l8")]
    own = chunking.custom_chunks(df, "file", "content", lambda t, f: [(1, 1, t[:2])]).collect()
    assert {r["chunk_id"] for r in own} == {"f:1:1", "g:1:1"}


def test_inbox_cases(spark):
    df = lambda scores: spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(scores)], "id string, attention_score double, arrival int")
    ids = lambda d: [r["id"] for r in d.orderBy(F.desc("attention_score"), "arrival").collect()]
    assert ids(lifecycle.inbox(df([("a", 0.5), ("b", 0.9), ("c", 0.3), ("d", 0.7)]), 3)) == ["b", "d", "a"]
    assert ids(lifecycle.inbox(df([("a", 0.3), ("b", 0.9), ("c", 0.6)]), 2)) == ["b", "c"]
    assert ids(lifecycle.inbox(df([("a", 0.5), ("b", 0.5), ("c", 0.5)]), 2)) == ["a", "b"]
    assert lifecycle.needs_consolidation(6, 7, None, 7) and not lifecycle.needs_consolidation(5, 7, None, 7) and lifecycle.needs_consolidation(0, 7, 24 * 8, 7)


def test_code_cue(spark):
    code = "import x\npub fn one() {\n  body\n}\nstruct Two;\n# note\ndef three(): pass"
    cue = lambda n: spark.createDataFrame([(code,)], "t string").select(lifecycle.code_cue(F.col("t"), n)).first()[0]
    assert cue(1000) == "pub fn one() {\nstruct Two;\ndef three(): pass..."
    assert cue(20) == "pub fn one() {..."
    assert spark.createDataFrame([("plain text here",)], "t string").select(lifecycle.code_cue(F.col("t"), 5)).first()[0] == "plain..."


def test_decay_reads_odd_dates_as_old(spark):
    rows = [("a", None, None, 0, 0.0, "user"), ("b", "garbage", "2024-01-31", 0, 0.0, "user"), ("c", "2024-01-31T00:00:00", None, 0, 0.0, "user"), ("d", None, "2023-09-01", 9, 0.0, "user"), ("e", None, "2023-10-01", 0, 0.0, "feedback"), ("f", None, "2023-10-01", 0, 1.0, "user")]
    df = spark.createDataFrame(rows, "file string, last_accessed string, created_at string, access_count int, strength double, type string")
    assert {r["file"] for r in lifecycle.decay_candidates(df, "2024-02-01", 90).collect()} == {"a", "b"}


def test_links_touches_and_upserts(spark):
    m = spark.createDataFrame([("a.md", ["b.md"], 0, None), ("b.md", [], 1, None)], "file string, refs array<string>, access_count int, last_accessed string")
    pairs = spark.createDataFrame([("a.md", "b.md")], "a string, b string")
    assert {r["file"]: r["refs"] for r in lifecycle.link(m, pairs).collect()} == {"a.md": ["b.md"], "b.md": ["a.md"]}
    t = {r["file"]: (r["access_count"], r["last_accessed"]) for r in lifecycle.touch(m, m.where("file = 'a.md'"), "now").collect()}
    assert t == {"a.md": (1, "now"), "b.md": (1, None)}
    new = spark.createDataFrame([("b.md", ["x"], 0, None), ("c.md", [], 0, None)], m.schema)
    assert {r["file"]: r["status"] for r in lifecycle.upsert_memories(m, new).collect()} == {"a.md": "kept", "b.md": "updated", "c.md": "created"}


def test_index_additions(spark):
    index = spark.createDataFrame([("a.md", "a")], "file string, title string")
    new = spark.createDataFrame([("b.md", "b")], index.schema)
    assert lifecycle.add_entries(index, new).count() == 2
    for rows, most, fault in ((index, 9, "already"), (new, 1, "full")):
        with pytest.raises(Exception, match=fault):
            lifecycle.add_entries(index, rows, most).collect()


def test_sync_embeds_only_what_changed(spark):
    v1 = spark.createDataFrame([("a", "one"), ("b", "two")], "file string, content string")
    store = embed.sync(spark.createDataFrame([], "file string, hash bigint, embedding array<float>"), v1)
    v2 = spark.createDataFrame([("a", "one"), ("b", "changed"), ("c", "new")], "file string, content string")
    assert {r["file"]: r["action"] for r in embed.sync_plan(store, v2.where("file <> 'a'")).collect()} == {"a": "drop", "b": "embed", "c": "embed"}
    assert {r["file"] for r in embed.sync(store, v2).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        embed.embed_texts(v1, "content", "none")


def test_hash_embedder_equals_long_fnv():
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h % 256

    for w in ("a", "hello", "naïve", "x" * 99):
        assert embed.fnv_bucket(w.encode()) == fnv(w.encode())


def test_packing_and_quantisers(spark):
    r = np.random.default_rng(1)
    for bits, n, size in ((2, 384, 96), (3, 5, 2), (1, 9, 2), (4, 7, 4)):
        codes = r.integers(0, 2**bits, n)
        assert len(quantize.pack(codes, bits)) == size and (quantize.unpack(quantize.pack(codes, bits), bits, n) == codes).all()
    x = r.standard_normal((200, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, [0.0] * 64), (201, None)], "vec_id int, embedding array<double>")
    errors = []
    for bits in (1, 2, 3, 4):
        stored = quantize.mse_quantize(df, bits, decoded=True)
        rows = {q["vec_id"]: q for q in stored.collect()}
        assert len(rows) == 201 and rows[200]["norm"] == 0 and not any(rows[200]["decoded"])
        errors.append(np.mean([np.sum((np.array(rows[i]["decoded"]) - x[i]) ** 2) / np.sum(x[i] ** 2) for i in range(200)]))
        if bits == 2:
            back = {q["vec_id"]: q["embedding"] for q in quantize.mse_dequantize(stored, 2).collect()}
            assert back[3] == pytest.approx(rows[3]["decoded"])
    assert errors == sorted(errors, reverse=True) and errors[0] < 0.45 and errors[3] < 0.02
    q = r.standard_normal(64)
    est = np.mean([[np.dot(quantize.residual_estimate(*quantize.residual_signs(x[:5], s), s), q)] for s in range(300)], axis=0)[0]
    assert np.abs(est - x[:5] @ q).max() < 3
    with pytest.raises(ValueError):
        quantize.prod_quantize(df, 1)
    code = spark.range(1).select(scoring.quantize_scalar(F.lit(0.0), 1).alias("c")).first()["c"]
    assert code == 0


def test_memory_files_round_trip(spark, tmp_path):
    text = "---\nname: a-b\ndescription: d\ntype: project\nstrength: 0.5\nrefs: [x.md]\n---\n\nBody\n"
    m = files.parse_memory(text)
    assert m["name"] == "a-b" and m["body"] == "Body" and m["refs"] == ["x.md"]
    with pytest.raises(ValueError):
        files.parse_memory(text.replace("project", "other"))
    (tmp_path / "project_a-b.md").write_text(text)
    (tmp_path / "MEMORY.md").write_text("- [a b](project_a-b.md) — d\nbroken\n- [c](c.md) - e\n")
    df = files.read_memories(spark, str(tmp_path))
    assert df.first()["file"] == "project_a-b.md"
    out = tmp_path / "out"
    out.mkdir()
    files.write_memories(df, str(out))
    assert files.parse_memory((out / "project_a-b.md").read_text()) == m
    with pytest.raises(Exception, match="path escape"):
        files.write_memories(df.withColumn("file", F.lit("../x.md")), str(out))
    assert sorted(r["file"] for r in files.read_index(spark, str(tmp_path / "MEMORY.md")).collect()) == ["c.md", "project_a-b.md"]


def test_code_tree(spark, tmp_path):
    for p, t in {"a.py": b"x", "src/app.min.js": b"y", "src/.hidden/z.py": b"h", "Target/b.py": b"b", "bin.dat": b"\xff\xfe", "log/x.log": b"l"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(t)
    got = {r["file"] for r in files.read_code(spark, str(tmp_path), ignore_rules=["*.log"]).collect()}
    assert got == {"a.py", "src/app.min.js"}
    assert {r["file"] for r in files.read_code(spark, str(tmp_path), include=["*.py"]).collect()} == {"a.py"}


def test_conversation_benchmark(spark, tmp_path):
    turn = '[{"role":"user","content":"I ate"},{"role":"assistant","content":"noted"},{"role":"user","content":"pasta"}]'
    (tmp_path / "b.json").write_text(f'[{{"question_id":"q0","question":"what","answer":["a","b"],"answer_session_ids":["s0"],"haystack_session_ids":["s0","s1"],"haystack_sessions":[{turn},{turn}]}},{{"question":"n","answer":7,"evidence_session_ids":["s1"],"haystack_session_ids":["s0"],"haystack_sessions":[[]]}}]')
    sessions, queries = files.read_conversation_benchmark(spark, str(tmp_path / "b.json"))
    docs = {r["session_id"]: r["t"] for r in sessions.select("session_id", files.user_text().alias("t")).collect()}
    assert docs == {"s0": "I ate pasta", "s1": "I ate pasta"}
    got = {r["question"]: (r["gold_ids"], r["a"]) for r in queries.select("question", "gold_ids", files.answer_text(F.col("answer")).alias("a")).collect()}
    assert got["what"] == (["s0"], "a, b") and got["n"] == (["s1"], "7")


def test_store_files(spark, tmp_path):
    (tmp_path / "e.bin").write_bytes(binary.store_bytes([("a.md", -5, [1.0, 2.0]), ("é", 7, [0.5, 0.25])], 2))
    assert {r["file"]: (r["hash"], r["embedding"]) for r in binary.read_store(spark, str(tmp_path)).collect()} == {"a.md": (-5, [1.0, 2.0]), "é": (7, [0.5, 0.25])}
    with pytest.raises(ValueError):
        binary.parse_store(b"nope")


def test_streamed_inbox_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", f"i{i}", float(i * 37 % 100), i) for i in range(90)]
    src, out = tmp_path / "src", tmp_path / "out"
    for part in range(3):
        spark.createDataFrame(rows[part::3], stream.STATE).coalesce(1).write.mode("append").parquet(str(src))
    items = spark.readStream.schema(stream.STATE).option("maxFilesPerTrigger", 1).parquet(str(src))
    stream.start_inbox(items, str(out), str(tmp_path / "ck"), 4).awaitTermination(120)
    last = max(int(p.name) for p in out.iterdir())
    got = {(r["key"], r["id"]) for r in spark.read.parquet(f"{out}/{last}").collect()}
    batch = lifecycle.inbox(spark.createDataFrame(rows, stream.STATE), 4, by=["key"])
    assert got == {(r["key"], r["id"]) for r in batch.collect()}


def test_config():
    c = Config({"recall": {"budget": 10}, "code": {"overlap": 2}})
    assert c.get("recall.budget") == 10 and c.get("recall.min_results") == 2
    c.set("recall.expand_refs", "false")
    assert c.get("recall.expand_refs") is False
    with pytest.raises(KeyError):
        c.get("no.such")


def test_learn_and_consolidate(spark):
    code = "\n".join(f"def f{i}(): return {i}" for i in range(12))
    got = recall.learn(spark.createDataFrame([("a.py", code), ("b.py", code + "\nclass X: pass")], "file string, content string"), "2024-01-01T00:00:00", Config({"inbox": {"capacity": 1}}))
    assert got["chunks"].count() == 2 and got["inbox"].count() == 1 and got["profile"].first()["sample_size"] == 2
    assert not math.isnan(got["profile"].first()["similarity_floor"])
    schema = "file string, name string, type string, description string, body string, strength double, created_at string, last_accessed string, access_count int, source string, refs array<string>"
    old = spark.createDataFrame([("user_x.md", "x", "user", "", "", 0.0, "2020-01-01", None, 0, "note", []), ("user_y.md", "y", "user", "", "", 2.0, "2020-01-01", None, 0, "note", [])], schema)
    vec = spark.createDataFrame([("user_x.md", [1.0, 0.0]), ("user_y.md", [1.0, 0.1])], "id string, embedding array<double>")
    done = recall.consolidate(old, vec, got["inbox"], "2024-01-01T00:00:00")
    assert {r["action"] for r in done["log"].collect()} == {"promote", "associate", "decay"}
    assert "user_x.md" not in {r["file"] for r in done["memories"].collect()} and done["memories"].count() == 2


def test_index_files_round_trip():
    c, rows = np.eye(2, 3, dtype=np.float32), [("a", 0, np.ones(3, np.float32)), ("é", 1, np.zeros(3, np.float32))]
    p, centroids, got = binary.parse_cells(binary.cells_bytes(c, rows))
    assert p["n_lists"] == 2 and (centroids == c).all() and [(x, y) for x, y, _ in got] == [("a", 0), ("é", 1)]
    params = {"dim": 3, "m": 16, "m0": 32, "ef_construction": 200, "ef_search": 50, "max_level": 1, "entry": 0, "state": 42}
    nodes = [("a", 1, np.ones(3, np.float32), [[1], []]), ("b", 0, np.zeros(3, np.float32), [[0]])]
    back, got = binary.parse_graph(binary.graph_bytes(params, nodes))
    assert back == params and [n[3] for n in got] == [[[1], []], [[0]]]
    for prod in (False, True):
        params = {"dim": 10, "bits": 3, "prod": prod, "rotation_seed": 1, "sketch_seed": 2 if prod else None}
        entry = {"file": "f", "hash": -9, "norm": 0.5, "packed": b"x" * (3 if prod else 4)} | ({"residual_norm": 0.25, "signs": b"yz"} if prod else {})
        assert binary.parse_compressed(binary.compressed_bytes(params, [entry])) == (params, [entry])
    with pytest.raises(ValueError):
        binary.parse_graph(b"IVFF")


def test_training_examples(spark):
    from sagewell.operators import training

    reply = "text\n```json\n{\"a\":1}\nnot json\n[2]\n```\n{\"b\":2}\n  {broken\n"
    assert spark.createDataFrame([(reply,)], "t string").select(training.objects_in_response(F.col("t"))).first()[0] == ['{"a":1}', "[2]", '{"b":2}']
    rows = spark.createDataFrame([(1, None, None), (2, "q", [(0.5,), (1.5,), (None,)])], "line int, query string, candidates array<struct<temporal_relevance:double>>")
    assert sorted((r["line"], r["fault"]) for r in training.check_temporal(rows).collect()) == [(1, "fewer than two candidates"), (1, "no query"), (2, "candidate without relevance"), (2, "relevance outside 0 to 1")]
    pairs = spark.createDataFrame([(1, "rust", "x", "short"), (2, "go", "y" * 20, "long enough"), (3, None, "y", "d")], "line int, language string, code string, description string")
    assert sorted((r["line"], r["fault"]) for r in training.check_code_pairs(pairs).collect()) == [(1, "code under 20 letters"), (1, "description under 10 letters"), (3, "absent: language")]
    batch = spark.createDataFrame([(0, i, v, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0]])], "batch int, pos int, anchor array<double>, positive array<double>")
    assert training.contrastive_loss(batch).first()[0] == pytest.approx(math.log1p(math.exp(-20)), abs=1e-9)
    got = pairs.select(training.code_input(F.col("code"), F.col("language")).alias("c")).first()["c"]
    assert got == "[RUST] x"


def test_other_conversation_layouts(spark, tmp_path):
    turns = '[{"role":"user","content":"hi"},{"role":"assistant","content":"yes"}]'
    (tmp_path / "map.json").write_text(f'[{{"question":"a","answer":"x","evidence_session_ids":["s1"],"sessions":{{"s1":{turns},"s2":[]}}}},{{"question":"b","gold_session_ids":[],"sessions":{{"s1":[]}}}}]')
    sessions, queries = files.read_conversation_benchmark(spark, str(tmp_path / "map.json"))
    assert {r["session_id"]: len(r["turns"]) for r in sessions.collect()} == {"s1": 2, "s2": 0}
    assert {r["question"]: (r["answer"], r["gold_ids"], r["haystack_ids"]) for r in queries.collect()} == {"a": ("x", ["s1"], []), "b": (None, [], [])}
    (tmp_path / "split.json").write_text(f'{{"sessions":{{"s1":{turns}}},"queries":[{{"question":"a","gold_session_ids":["s1"]}},{{"question":"b","answer":"y","gold_session_ids":[]}}]}}')
    sessions, queries = files.read_conversation_benchmark(spark, str(tmp_path / "split.json"))
    assert [r["session_id"] for r in sessions.collect()] == ["s1"]
    assert {r["question"]: (r["answer"], r["gold_ids"]) for r in queries.collect()} == {"a": (None, ["s1"]), "b": ("y", [])}
    assert len({r["query_id"] for r in queries.collect()}) == 2


def test_inbox_file(spark, tmp_path):
    box = store.InboxFile(spark, str(tmp_path / "inbox.json"), 7)
    assert box.load()[0] == 7 and box.load()[1].count() == 0
    items = spark.createDataFrame([(f"i{k}", "c", "note", k % 3 / 2, "now", k) for k in range(6)], store.InboxFile.ITEM)
    box.save(items, 4)
    capacity, held = store.InboxFile(spark, str(tmp_path / "inbox.json"), 99).load()
    assert capacity == 4 and [r["id"] for r in held.collect()] == ["i2", "i5", "i1", "i4"]
    assert sorted(r["id"] for r in box.drain().collect()) == ["i1", "i2", "i4", "i5"]
    assert box.load()[0] == 4 and box.load()[1].count() == 0


def test_memory_store(spark, tmp_path):
    schema = "file string, name string, description string, body string"
    mine = store.MemoryStore(spark, str(tmp_path / "store"))
    mine.create(spark.createDataFrame([("user_a.md", "a", "first", "red apple"), ("user_b.md", "b", "second", "blue sky"), ("note_ab.md", "ab", None, None)], schema))
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert {(r["name"], r["file"]) for r in store.first_containing(mine.memories(), names("ab", "user", "zzz", None), place="file").collect()} == {("ab", "note_ab.md"), ("user", "user_a.md")}
    told = mine.store(spark.createDataFrame([("user_b.md", "b", "other", "green sea"), ("user_c.md", "c", "third", "c")], schema))
    assert {(r["file"], r["status"]) for r in told.collect()} == {("user_b.md", "updated"), ("user_c.md", "created")}
    assert mine.sync() == {"total": 4, "synced": 2} and mine.sync() == {"total": 4, "synced": 0}
    asked = embed.embed_texts(spark.createDataFrame([("q", "green sea")], "file string, t string"), "t")
    assert mine.search(asked, 1).first()["id"] == "user_b.md"
    assert [r["file"] for r in mine.search_text("THIRD").collect()] == ["user_c.md"]
    mine.remove(names("user_b"))
    assert mine.memories().count() == mine.vectors().count() == 3


def test_dry_run_changes_nothing(spark):
    schema = "file string, name string, type string, description string, body string, strength double, created_at string, last_accessed string, access_count int, source string, refs array<string>"
    old = spark.createDataFrame([("user_x.md", "x", "user", "", "", 0.0, "2020-01-01", None, 0, "note", [])], schema)
    vec = spark.createDataFrame([("user_x.md", [1.0, 0.0])], "id string, embedding array<double>")
    items = recall.learn(spark.createDataFrame([("a.py", "\n".join(f"def f{i}(): pass" for i in range(9)))], "file string, content string"), "2024-01-01T00:00:00")["inbox"]
    done = recall.consolidate(old, vec, items, "2024-01-01T00:00:00", dry_run=True)
    assert {r["action"] for r in done["log"].collect()} == {"promote", "decay"} and done["memories"].count() == 1
    done = recall.consolidate(old, vec, items, "2024-01-01T00:00:00")
    assert sorted(map(tuple, done["rebuilt"].collect())) == [("embed", 1), ("index", 1)] and done["vectors"].count() == 1


def test_index_file_is_saved_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}.md", f"n-{i}", f"line {i}\nmore") for i in (3, 1, 2)], "file string, name string, description string")
    files.write_index(rows, str(tmp_path / "index"))
    got = files.read_index(spark, str(tmp_path / "index")).collect()
    assert [(r["file"], r["summary"]) for r in got] == [(f"f{i}.md", f"line {i} more") for i in (1, 2, 3)]


def test_stored_products(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(40)], "vec_id int, embedding array<double>")
    held = quantize.prod_quantize(v, 3)
    want = {r["vec_id"]: r["decoded"] for r in held.collect()}
    got = {r["vec_id"]: r["embedding"] for r in quantize.prod_dequantize(held.drop("decoded"), 3).collect()}
    q = rng.standard_normal(16)
    fast = {r["vec_id"]: r["inner_product"] for r in quantize.inner_products(held.drop("decoded"), q.tolist(), 3).collect()}
    assert all(np.allclose(got[i], want[i]) and math.isclose(fast[i], float(np.dot(want[i], q)), abs_tol=1e-9) for i in want)
    e = quantize.inner_product_error(v, v.limit(5), 3).first()
    assert e["n"] == 200 and abs(e["bias"]) <= e["mean_error"] <= e["max_error"]
