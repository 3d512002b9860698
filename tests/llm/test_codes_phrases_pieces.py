"""Vector codes, collocations and piece vocabularies against brute force, the library, and odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sagewell.llm import codes, phrases, pieces, registry

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error string, ids string, block string, of_label string"
TEXTS = "doc_id bigint, lang string, text string, phrase string, f string, part string, rank string, n string"


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    """Whole numbers of Python throughout."""
    good = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    wide = -(-len(good[0][1]) // parts)
    whole = [[int(np.floor(np.float64(x) * 256)) for x in v] + [0] * (parts * wide - len(v)) for _, v, _ in good]
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in cut:
                own[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    of = collections.Counter()
    for (_, _, lab), e in zip(good, errors, strict=True):
        of[lab] += e
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), err, of[lab], sha) for (i, _, lab), f, err in zip(good, found, errors, strict=True))


@pytest.mark.parametrize(("n", "width", "spread"), [(300, 32, 1.0), (90, 20, 3.0), (40, 16, 0.02), (1, 5, 1.0), (70, 48, 40_000.0)])
def test_codes_by_hand(spark, n, width, spread):
    rnd = np.random.default_rng(n)
    rows = [(int(rnd.integers(0, n)), [float(np.float32(x)) for x in rnd.normal(0, spread, width)], None if i % 7 == 0 else i % 3) for i in range(n)]
    rows += [(i + 1, rows[0][1], 1) for i in range(3)]  # copies, and ids that occur again
    odd = [(7, None, 1), (8, [], 1), (9, [float("nan")] * width, 1), (10, [float("inf")] + [0.0] * (width - 1), 2), (11, [None] * width, 1), (10_000, [1.0] * (width + 1), 1), (None, rows[-1][1], None)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows + odd], VECTORS)
    got = codes.compress(df).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == codes_by_hand(rows + odd)


def test_codes_of_nothing_and_of_huge_components(spark):
    df = spark.createDataFrame([(1, None, 1, *"xxxxx"), (2, [float("nan")], 1, *"xxxxx")], VECTORS)
    assert codes.compress(df).collect() == []
    df = spark.createDataFrame([(1, [3e38, -3e38], 1, *"xxxxx"), (2, [2e38, -3e38], 1, *"xxxxx")], VECTORS)
    assert [r["error"] for r in codes.compress(df).collect()] == [0, 0]  # both count as the largest component
    assert len(codes.compress(df.drop("label"), label_col=None).collect()) == 2


def test_nearest_takes_the_first_of_equal_entries():
    books = np.array([[[0, 0], [2, 0], [2, 0]]])
    code, distance = codes.nearest(np.array([[1, 2, 9], [0, 0, 0]]), books)
    assert code.tolist() == [[0, 1, 1]] and distance.tolist() == [[1, 0, 49]]


def phrases_by_hand(rows, longest=3, least=10, top=2000, covered=50):
    counts, small = collections.defaultdict(collections.Counter), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(small)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in frequent.items():
            if any(100 * b >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in frequent.items() if len(h) > len(g)):
                continue
            score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        n = sum(c for g, c in f.items() if len(g) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def some_texts(seed, n=300):
    rnd = random.Random(seed)
    words = ["a", "b", "New", "york", "é", "ÉA", "漢字", "x y", "\x00", "the", "of", "city"]
    return [(rnd.choice(["en", "de", None, ""]), "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! "]) for _ in range(rnd.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_collocations_by_hand(spark, longest):
    rows = [*some_texts(longest), ("en", None), ("en", ""), (None, " \t . "), ("fr", "one two"), ("en", "new york city " * 9000), ("en", "w" * 100_000), *[("de", "The CITY of york, the city of York")] * 30]
    df = spark.createDataFrame([(i, lang, t, *"xxxxx") for i, (lang, t) in enumerate(rows)], TEXTS).repartition(5)
    got = phrases.collocations(df, longest, 10, 200).collect()
    assert sorted(map(tuple, got)) == phrases_by_hand(rows, longest, 10, 200)
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(1, "en", None, *"xxxxx"), (2, None, "one", *"xxxxx")], TEXTS)
    assert phrases.collocations(df).collect() == [] and phrases.collocations(df.limit(0)).collect() == []


def test_shards_cut_long_texts_where_pieces_end(monkeypatch):
    """Small shards, whatever their number, give the counts of a single one."""
    rows = [*some_texts(9), ("en", "a b. " * 400 + "c " * 700 + ", d e")]
    batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])
    whole = collections.Counter()
    for b in phrases._count_pairs(iter([batch])):
        whole.update({(lang, p): f for lang, p, f in zip(*(c.to_pylist() for c in b.columns), strict=True)})
    monkeypatch.setattr(phrases, "PART_BYTES", 50)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 300)
    monkeypatch.setattr(phrases, "AT_ONCE", 7)
    assert len(list(phrases.shards(iter([batch])))) > 20
    cut = collections.Counter()
    for b in phrases._count_pairs(iter([batch])):
        for lang, p, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cut[lang, p] += f
    assert cut == whole


def test_filter_knows_every_pair(spark):
    rows = [("en", f"w{i} v{i % 50}") for i in range(3000)] + [("de", "a b")]
    known = phrases.PairFilter.of(spark.createDataFrame(rows, "lang string, phrase string"))
    hashes = lambda pairs, lang: phrases.pair_hashes(*(phrases.word_hashes([x.encode() for x in side]) for side in zip(*pairs, strict=True)), lang)
    assert known.holds(hashes([p.split() for lang, p in rows if lang == "en"], "en")).all()
    assert known.holds(hashes([("a", "b")], "de")).all()
    assert known.holds(hashes([(f"x{i}", f"y{i}") for i in range(2000)], "en")).mean() < 0.1


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path("piece_bpe_32k.model"))


ODD = ["", " ", "  a  b ", "▁", "▁" * 40, "a▁ ▁b", "<s>a</s>\x00漢字퟿🙂\t\n  x", "<0x41><unk>", "a" * 3000, " " * 2000 + "x", "é" * 500, "ab " * 20_000, "one\rtwo\r\n", "🙂" * 200, "ｆｕｌｌ ﬁ é"]


def test_pieces_equal_the_library(spark, sf_dir, library):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(" ▁abeé漢字\n\t🙂s<>/0x1the in") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in pieces.encode_decode(df, registry.tokenizer_path("piece_bpe_32k.model"), keep_ids=True, keep_text=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t)
        back = library.decode(ids) if ids else ""
        assert got[i]["ids"] == ids and got[i]["decoded"] == back and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_both_agendas_agree(library):
    rnd = random.Random(5)
    agenda = pieces.Agenda(library)
    words = ["▁" + "".join(rnd.choice("▁abdehinorst漢é🙂") for _ in range(rnd.randint(1, 30))) for _ in range(2000)]
    assert agenda.merge_many(words) == [agenda.merge(w) for w in words]


def test_ids_unlike_the_librarys_are_an_error(library):
    codec = pieces.Codec(library.serialized_model_proto())
    codec.agenda.ranks = codec.agenda.ranks[::-1].copy()
    with pytest.raises(RuntimeError, match="other ids"):
        codec.encode_batch(["zkrsoned xqzvtions unbelievableness thereafteringtioner hippopotamuses"])


def test_pieces_on_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "no id"), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(*r, "s", "s", "s") for r in rows], "doc_id bigint, text string, ids string, n_tokens string, exact string")
    path = registry.tokenizer_path("piece_bpe_32k.model")
    got = pieces.encode_decode(df, path).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"] > 0) for r in got) == sorted((str(i), bool(t)) for i, t in rows)
    assert {r["ids_sha256"] for r in got if r["doc_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert pieces.encode_decode(df.limit(0), path).collect() == []


def test_word_memo_is_emptied_by_bytes(library, monkeypatch):
    codec = pieces.Codec(library.serialized_model_proto())
    monkeypatch.setattr(pieces, "MEMO_BYTES", 20_000)
    for i in range(30):
        codec.encode_batch([" ".join(f"word{i}x{j}" for j in range(60)) + " " + "long" * 50])
        assert codec.held < 60_000 and not any(len(w) > pieces.MEMO_CHARS for w in codec.known)


def test_codes_label_errors_sum_up(spark, sf_dir):
    rows = registry.op11_vector_codes(spark, sf_dir)
    per = rows.join(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label"), "vec_id").groupBy("label").agg(F.sum("error").alias("s"), F.min("label_error").alias("a"), F.max("label_error").alias("b"))
    assert all(r["s"] == r["a"] == r["b"] for r in per.collect())


def test_rows_of_repeated_labelled_ids_are_bounded(spark):
    from sagewell.llm import toxicity

    rows = [(1, "a bad text")] * 3000 + [(2, f"text {i}") for i in range(500)] + [(3, None)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    assert toxicity.bounded_rows(df, 4000).count() == 3501
    few = toxicity.bounded_rows(df, 100).collect()
    assert 0 < len(few) <= 100 and len(set(few)) == len(few)
    assert toxicity.bounded_rows(df, 600).count() == 502
    docs = spark.createDataFrame([(1, "vile bad words " * 3)] * 3000 + [(2, "kind good words")] * 3000, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, max_rows=2)
    assert len({r["doc_id"] for r in toxicity.score(docs, model).collect()}) == 2
