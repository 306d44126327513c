import numpy as np

from tests.llm.cases import empty, hard
from tidewatch.llm import langid


def naive(text):
    """The bundle of a text, n-gram by n-gram."""
    letters, total = [0], np.zeros(langid.DIMENSIONS)
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or letters[-1]:
            letters.append(code)
    letters += [0] if letters[-1] else []
    for i in range(len(letters) - 2):
        a, b, c = (langid.letter_vector(x).astype(float) for x in letters[i:i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_scores_equal_brute_force(spark):
    docs = hard(spark)
    learned = langid.prototypes(docs)
    rows = docs.collect()
    for name in ("de", "en"):
        assert np.allclose(learned[name], sum(naive(r.text) for r in rows if r.lang == name and r.text and any(c.isalpha() for c in r.text)))
    for r in langid.identify(docs, learned).collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == (langid.UNKNOWN, 0.0)
            continue
        own = naive(r.text)
        cosines = {n: v @ own / np.linalg.norm(v) / np.linalg.norm(own) for n, v in learned.items()}
        assert r.lang_pred == max(sorted(cosines), key=cosines.get)
        assert abs(r.score - max(cosines[r.lang_pred], 0)) < 1e-6 and r.fp == "clash"


def test_ties_empty_tables_and_nothing_learned(spark):
    docs = hard(spark)
    same = {"b": np.ones(langid.DIMENSIONS), "a": np.ones(langid.DIMENSIONS)}
    assert {r.lang_pred for r in langid.identify(docs, dict(sorted(same.items()))).collect()} == {"a", langid.UNKNOWN}
    assert langid.prototypes(empty(spark)) == {}
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, {}).collect()} == {(langid.UNKNOWN, 0.0)}
    assert langid.identify(empty(spark), same).count() == 0


def test_a_crowded_memory_changes_nothing(monkeypatch):
    packed, counts = langid.grams("some words that share letters with other words")
    memory = langid.Memory()
    memory.learn(packed)
    whole = memory.bundle(packed, counts)
    monkeypatch.setattr(langid, "REMEMBERED", 5)
    monkeypatch.setattr(langid, "STEP", 7)
    memory = langid.Memory()
    memory.learn(packed)
    assert len(memory.keys) == 5 and np.array_equal(memory.bundle(packed, counts), whole)


def test_held_out_accuracy(spark):
    got = langid.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and len(held) > 200
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
