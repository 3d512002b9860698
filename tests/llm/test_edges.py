"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from sagewell.llm import bpe, caps, decontam, katz, licenses, registry, secrets, sharding, simhash, toxicity, webtext

EXTRA = "doc_id bigint, text string, source string, shard string, kind string, part string, fp string, row string, score string, w string, chunk string, items string, held string"
NOISE = ("s", "x", "x", "x", "x", "x", "x", "x", "x", "x", "x")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, *NOISE) for i, t in texts], EXTRA)


TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one two three four five six seven eight nine ten eleven"),
    (5, "one two three four five six seven eight nine ten eleven"),
    (6, "one two three four five six seven eight nine ten eleven"),
    (7, "Released under the MIT License. " * 3),
    (None, "no id at all <|endoftext|> here é ß 漢字 🙂"),
    (8, "word " * 60_000),
    (9, "x" * 120_000),
]


def operators(spark):
    items = spark.createDataFrame([(1, "ONE two three four five six seven eight nine ten"), (2, "one"), (3, None), (4, ""), (None, "no id at all")], "item_id bigint, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    return {
        "katz": lambda d: katz.score_texts(d),
        "decontam": lambda d: decontam.find_contamination(d, items),
        "bpe": lambda d: bpe.encode_decode(d, registry.tokenizer_path(), keep_ids=True, keep_text=True),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "sharding": lambda d: sharding.shuffle_shards(d, 3),
        "simhash": lambda d: simhash.near_duplicates(d),
        "licenses": lambda d: licenses.scan_licenses(d),
        "secrets": lambda d: secrets.scan_secrets(d),
    }


@pytest.mark.parametrize("name", ["katz", "decontam", "bpe", "toxicity", "sharding", "simhash", "licenses", "secrets"])
def test_edge_rows_come_back_once_each(spark, name):
    docs = documents(spark, TEXTS)
    rows = operators(spark)[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", ["katz", "decontam", "bpe", "toxicity", "sharding", "simhash", "licenses", "secrets"])
def test_empty_table(spark, name):
    assert operators(spark)[name](documents(spark, [])).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_katz_values_on_edges(spark):
    rows = by_id(katz.score_texts(documents(spark, TEXTS)))
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == rows[3]["n_tokens"] == 1
    assert rows[8]["n_tokens"] == 60_001
    assert all(r["score"] <= 1e-9 and r["base_score"] < 0 for r in rows.values())


def test_decontam_values_on_edges(spark):
    docs = documents(spark, TEXTS)
    items = spark.createDataFrame([(1, "ONE two three four five six seven eight nine ten"), (2, "one"), (3, None), (4, "")], "item_id bigint, text string")
    rows = by_id(decontam.find_contamination(docs, items))
    assert (rows[5]["n_hit"], rows[5]["n_items"]) == (10, 2)
    assert (rows[4]["n_hit"], rows[4]["n_items"]) == (1, 1)
    assert (rows[1]["n_words"], rows[1]["n_hit"], rows[1]["contaminated"]) == (0, 0, False)
    none = decontam.find_contamination(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0
    kept = decontam.filter_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "7", "8", "9", "None"])
    # windows that are too many to broadcast give the same rows
    many = decontam.filter_clean(docs, items, broadcast_windows=0)
    assert many.columns == docs.columns and sorted(map(str, many.collect())) == sorted(map(str, kept.collect()))


def test_simhash_values_on_edges(spark):
    rows = by_id(simhash.near_duplicates(documents(spark, TEXTS)))
    assert rows[1]["fingerprint"] == rows[3]["fingerprint"] == "0" * 16
    assert rows[1]["component_id"] == rows[2]["component_id"] == rows[3]["component_id"] == 1
    assert rows[6]["component_id"] == 5
    kept = simhash.keep_first(documents(spark, TEXTS)).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(5) == 1 and 6 not in ids and 1 in ids and 2 not in ids


def test_license_values_on_edges(spark):
    rows = by_id(licenses.scan_licenses(documents(spark, TEXTS)))
    assert (rows[7]["n_words"], rows[7]["n_base"], rows[7]["first_word"], rows[7]["last_word"]) == (15, 3, 3, 13)
    assert rows[7]["base_labels"] == "mit" and rows[7]["labels"] == "mit,mit-notice"
    assert rows[1]["first_word"] is None and rows[1]["labels"] == "" and rows[1]["score"] == 0.0


def test_vectors_on_edges(spark):
    nan = float("nan")
    v = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [nan, 1.0], "a"), (6, [None, 1.0], "a"), (7, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (8, [1.0, 0.0, 0.0], "a"), (None, [0.0, 1.0], "a"), (9, [], "a")]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>, links string")
    rows = sorted(caps.near_duplicate_vectors(df).collect(), key=lambda r: (str(r[0]), r[1]))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows]
    want = [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 1, False), (8, 0, 8, True), (9, 0, 9, True), (None, 1, 1, False)]
    assert got == want
    assert caps.near_duplicate_vectors(df.limit(0)).collect() == []


def test_pages_on_edges(spark):
    pages = [(1, None, None), (2, "http://a.b/x", ""), (3, "x", "<p>one"), (3, "x", "<p>one"), (4, "http://a.b/y", "<div>" * 3000 + "deep"), (None, "http://a.b/z", "a &amp; b <" + "p"), (5, "http://a.b", "<article><p>" + "w " * 50_000 + "</article>")]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id bigint, url string, html string, template string")
    rows = webtext.extract_main_text(df).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in rows) == sorted([("1", 0), ("2", 0), ("3", 3), ("3", 3), ("4", 4), ("None", 5), ("5", 99_999)])
    assert webtext.extract_main_text(df.limit(0)).collect() == []


def test_masking_keeps_rows_and_nulls(spark):
    rows = [(1, "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" end", "s", 5), (2, None, None, None), (3, "clean text", "s", 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    out = {r["doc_id"]: r for r in secrets.mask_secrets(df).collect()}
    assert out[1]["text"] == 'token = "[SECRET]" end' and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "clean text" and out[3]["n_chars"] == 10
