"""What a task of the Katz model holds at once, without Spark."""

import tracemalloc
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sagewell.llm import katz


def groups(table, by):
    return {v: table.filter(pc.equal(table.column(by), v)).combine_chunks() for v in pc.unique(table.column(by)).to_pylist()}


def of_kind(table, kind):
    return table.filter(pc.equal(table.column("kind"), kind))


def test_a_chunk_is_scored_in_bounded_memory(monkeypatch):
    rng, parts = np.random.default_rng(8), 4
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 500)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([i % 5 == 1 for i in range(400)]), pa.array(texts)], names=["doc_id", "held", "text"])
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = pa.Table.from_batches(list(katz._encode(parts, pa.int64(), 10**9)([batch])))
    chunk, asked = of_kind(rows, "tok"), groups(of_kind(rows, "voc"), "part")
    words = {p: katz._count_words(parts)(t) for p, t in asked.items()}
    every = pa.concat_tables(words.values())
    tokens, distinct = (sum(every.column(c).to_pylist()) for c in ("total", "distinct"))
    totals = katz.Totals(3, 8, katz.FREQUENT, katz.unigrams(np.sum(every.column("spectrum").to_pylist(), 0).tolist(), tokens, distinct))
    answers = pa.concat_tables([katz._answer_words(parts)((p,), t, words[p]) for p, t in asked.items()])
    for level in (2, 3):
        asks = groups(katz._ask(level, SimpleNamespace(value=totals))((0,), chunk, answers), "part")
        grams = {p: of_kind(katz._count_grams(level)(t), "gram") for p, t in asks.items()}
        spectrum = np.sum([x for g in grams.values() for x in g.column("spectrum").to_pylist()], 0).tolist()
        totals = replace(totals, ratios=(*totals.ratios, katz.discounts(spectrum)))
        replies = [katz._answer_grams(level, level == 3)((p,), t, grams[p]) for p, t in asks.items()]
        answers = pa.concat_tables([answers, *(of_kind(r, "ans") for r in replies)])
    tracemalloc.start()
    scores = katz._evaluate(SimpleNamespace(value=totals), pa.int64())((0,), chunk, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = sum(scores.column("n_tokens").to_pylist())
    assert n == 400 * 501
    assert peak < 220 * n
