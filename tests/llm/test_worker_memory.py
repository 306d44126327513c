"""What a worker holds follows its steps, not its batches; small sides of joins leave the texts where they are."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from tidewatch.llm import text
from tidewatch.session import materialise, table

SF = "/root/testdata/sf0.001"


def test_words_of_a_large_batch_take_little_memory():
    column = pa.array(["some words of a row, again and again " * 10] * 20_000, pa.string())
    data, offsets = text.utf8(column)
    text.release()
    tracemalloc.start()
    try:
        total = sum(len(hashes) for *_, hashes in text.hashed_words(data, offsets, text.ALNUM))
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert total == 20_000 * 10 * 8 and peak < 32 << 20


def test_steps_of_any_size_give_the_same_words(monkeypatch):
    rows = ["A few words, and 1 more", None, "", "x" * 100, "日本 語 é"] * 50
    out = []
    for size in (8, 64, 1 << 18):
        monkeypatch.setattr(text, "STEP_BYTES", size)
        out.append(np.concatenate([h for *_, h in text.hashed_words(*text.utf8(pa.array(rows)), text.ALNUM)]).tolist())
    assert out[0] == out[1] == out[2]


def test_few_cuts_batches_and_gives_back():
    text._power_tables(10)
    batches = [pa.record_batch({"x": list(range(n))}) for n in (5, 0, 2)]
    assert [b.column(0).to_pylist() for b in text.few(iter(batches), 2)] == [[0, 1], [2, 3], [4], [0, 1]]
    assert not text._powers


def test_contaminated_documents_are_joined_without_moving_texts(spark):
    docs = materialise(table(spark, SF, "documents"), "docs")
    plan = P.decontaminate(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
