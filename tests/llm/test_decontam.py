import re
from collections import Counter

import pytest

from tests.llm.cases import HARD, empty, hard
from tidewatch.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = Counter()
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, body in items:
            w = words(body)
            n = min(window, len(w))
            runs = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(own) - n + 1 if runs else 0):
                if tuple(own[i:i + n]) in runs:
                    hit.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        out[doc, len(own), len(hit), tuple(sorted(found))] += 1
    return out


ITEMS = [
    (10, "and the other thing were there, and the man was IN THE house"), (9, "the Hund ist"), (11, "Hund ist NICHT"), (11, "Hund ist NICHT"),
    (12, None), (13, "..."), (None, "word another1 third word another1 third word another1 third word another1"), (14, "日本語のテキスト"),
]


@pytest.mark.parametrize("small", [False, True])
def test_hard_cases(spark, monkeypatch, small):
    if small:  # many shards and several blocks of items
        monkeypatch.setattr(decontam, "BLOCK_CHARS", 40)
        monkeypatch.setattr(decontam, "SHARD_WORDS", 8)
    items = spark.createDataFrame(ITEMS, "item_id int, text string").selectExpr("*", "'clash' AS doc_id", "1 AS block")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontam.contamination(hard(spark).coalesce(1), items).collect())
    assert got == brute([(i, t) for i, t, _ in HARD], ITEMS)


def test_empty_sides(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert decontam.contamination(empty(spark), items).count() == 0
    none = decontam.contamination(hard(spark), items.filter("false")).collect()
    assert len(none) == len(HARD) and {r.n_hit for r in none} == {0}


def test_positions_of_phrases_and_near_words(spark):
    docs = spark.createDataFrame([(1, "a b c d a b"), (2, "b x x c a"), (3, "c b")], "doc_id long, text string")
    index = decontam.build_index(docs)
    items = spark.createDataFrame([("p", "a b")], "item_id string, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in decontam.phrase_matches(index, items).collect()}
    assert found == {1: [(0, 2), (4, 6)]}
    near = spark.createDataFrame([("q", "c b a")], "item_id string, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in decontam.near_matches(index, near, 4).collect()}
    assert found == {1: [(0, 3)]}  # the smallest span around c
    assert {r.doc_id for r in decontam.near_matches(index, near, 5).collect()} == {1, 2}
    with pytest.raises(ValueError):
        decontam.near_matches(index, near, decontam.GAP)
