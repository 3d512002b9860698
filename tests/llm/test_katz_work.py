"""What the Katz model does once: questions are shuffled, read and answered in one go, n-grams sorted in one sort."""

import tracemalloc
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from sagewell.llm import katz

PARTS, BLOCKS, FREQUENT = 3, 5, 60


def groups(table, by):
    return {v: table.filter(pc.equal(table.column(by), v)).combine_chunks() for v in pc.unique(table.column(by)).to_pylist()}


def of_kind(table, kind):
    return table.filter(pc.equal(table.column("kind"), kind))


@pytest.fixture
def model(monkeypatch):
    """Chunks of few frequent and many rare words, some in held-out texts only, with the words' answers."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.4, rng.integers(0, 40)), 400)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([i % 5 == 1 for i in range(600)]), pa.array(texts)], names=["doc_id", "held", "text"])
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = pa.Table.from_batches(list(katz._encode(PARTS, pa.int64(), 3000)([batch])))
    asked = groups(of_kind(rows, "voc"), "part")
    words = {p: katz._count_words(PARTS)(t) for p, t in asked.items()}
    every = pa.concat_tables(words.values())
    tokens, distinct = (sum(every.column(c).to_pylist()) for c in ("total", "distinct"))
    totals = katz.Totals(3, BLOCKS, FREQUENT, katz.unigrams(np.sum(every.column("spectrum").to_pylist(), 0).tolist(), tokens, distinct))
    answers = pa.concat_tables([katz._answer_words(PARTS)((p,), t, words[p]) for p, t in asked.items()])
    return groups(of_kind(rows, "tok"), "chunk"), groups(answers, "chunk"), totals


def test_blocks_answer_what_they_count(model):
    """Counting with answers says what a table of the same n-grams answers; questions come in order of block, context and word."""
    chunks, answers, totals = model
    assert len(chunks) > 2
    for level in (2, 3):
        asks = groups(pa.concat_tables([katz._ask(level, SimpleNamespace(value=totals))((0,), c, answers[k]) for k, c in chunks.items()]), "part")
        assert len(asks) == BLOCKS
        spectrum, replies, wants = 0, [], 0
        for part, t in asks.items():
            for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
                k = katz._Keys(a, b)
                context = np.repeat(k.first, k.runs)
                assert (np.diff(k.first) > 0).all()
                assert (np.diff(k.word)[np.diff(context) == 0] > 0).all()
            both = katz._count_grams(level, True, level == 3)(t)
            alone = katz._count_grams(level)(t)
            assert of_kind(both, "gram").equals(of_kind(alone, "gram"))
            assert of_kind(both, "freq").equals(of_kind(alone, "freq"))
            other = katz._answer_grams(level, level == 3)((part,), t, of_kind(alone, "gram"))
            rows = of_kind(both, "ans"), of_kind(both, "want")
            assert pa.concat_tables(rows).equals(pa.concat_tables([of_kind(other, "ans"), of_kind(other, "want")]))
            spectrum, wants = spectrum + np.sum(of_kind(both, "gram").column("spectrum").to_pylist(), 0), wants + rows[1].num_rows
            replies.append(rows[0])
        assert wants > 0 or level == 3
        totals = replace(totals, ratios=(*totals.ratios, katz.discounts(spectrum.tolist())))
        new = groups(pa.concat_tables(replies), "chunk")
        answers = {k: pa.concat_tables([v, new[k]]) for k, v in answers.items()}


def test_training_shuffles_questions_once(spark, sf_dir, monkeypatch):
    """No level's questions go to its table a second time: that made op1_katz_backoff miss its CPU seconds."""
    monkeypatch.setattr(katz, "_answer_grams", lambda *_: pytest.fail("questions were shuffled again"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert katz.score_texts(docs).count() == docs.count()


@pytest.mark.parametrize("top", [1 << 20, 1 << 62])
def test_keys_are_numbered_in_order(top):
    """Also where key and place don't fit in 63 bits together."""
    keys = np.random.default_rng(5).integers(top - 300, top, 1000)
    found, which, first = katz._number(keys, top)
    want, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    assert (found == want).all()
    assert (which == inverse).all()
    assert (first == at).all()
    assert len(katz._number(keys[:0], 0)[0]) == 0


def test_a_block_is_counted_in_bounded_memory():
    """A block holds each of its questions' numbers once: measured 93 bytes a question, 160 while readers kept theirs."""
    rng, rows, total = np.random.default_rng(9), [], 0
    for chunk in range(8):
        keys = np.unique(rng.integers(0, 1 << 17, 60_000) << 16 | rng.integers(0, 1 << 16, 60_000))
        heads, runs = katz._runs(keys >> 16)
        a = [np.diff((keys >> 16)[heads], prepend=0), runs, np.zeros(len(heads), bool)]
        b = [keys & 0xFFFF, rng.integers(0, 3, len(keys)), rng.integers(1, 9, len(keys))]
        rows.append(("ask", 3, 0, chunk, b"", *(katz._join(list(map(katz.pack_ints, x))) for x in (a, b)), len(keys), [], 0))
        total += len(keys)
    asks = katz._table(rows)
    tracemalloc.start()
    katz._count_grams(3, True, True)(asks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 125 * total
