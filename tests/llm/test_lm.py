import math
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.cases import HARD, empty, hard
from tidewatch.llm import lm


def tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + ["\0end"]


def brute(rows, learns):
    """(n_tokens, n_known, base, score) of each row, from plain counters."""
    single, pairs, starts = Counter(), Counter(), Counter()
    for (_, text), on in zip(rows, learns, strict=True):
        if on:
            own = tokens(text)
            single.update(own)
            for a, b in zip(["\0start", *own], own, strict=False):
                pairs[a, b] += 1
                starts[a] += 1
    follow = Counter(a for a, _ in pairs)
    total, distinct = sum(single.values()), len(single)

    def stepped(x):
        return 10 ** (-np.rint(-np.log10(x) * lm.STEPS) / lm.STEPS)

    out = []
    for _, text in rows:
        own, base, score = tokens(text), 0.0, 0.0
        for a, w in zip(["\0start", *own], own, strict=False):
            p = (single[w] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            if starts[a]:
                p = stepped(lm.DISCOUNT * follow[a] / starts[a]) * p + (stepped((pairs[a, w] - lm.DISCOUNT) / starts[a]) if pairs[a, w] else 0)
            score += math.log10(p)
        out.append((len(own), sum(single[w] > 0 for w in own), base, score))
    return total, out


def same(got, rows, expected):
    left = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert left == sorted(((i is None, i or 0), n, k, round(b, 6), round(s, 6)) for (i, _), (n, k, b, s) in zip(rows, expected, strict=True))


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(300):
        values = np.sort(rng.integers(0, 2 ** int(rng.integers(1, 62)), int(rng.integers(0, 200))).astype(np.uint64))
        assert np.array_equal(lm.elias_fano_values(lm.elias_fano(values)), values)
    values = np.sort(rng.integers(0, 2**40, 200_000).astype(np.uint64))
    blob = lm.elias_fano(values)
    assert np.array_equal(lm.elias_fano_values(blob), values) and len(blob) * 8 / len(values) < 2 + 40 - math.log2(200_000) + 2


def test_level_finds_its_pairs_only():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 50, (400, 2)), axis=0).astype(np.uint64)
    counts = rng.integers(1, 9, len(pairs))
    level = lm.Level(lm.Level.pack(pairs[:, 0], pairs[:, 1], counts))
    asked = np.array([(a, b) for a in range(55) for b in range(55)], dtype=np.uint64)
    found = level.find(asked[:, 0], asked[:, 1])
    totals = Counter()
    for (a, _), n in zip(pairs.tolist(), counts.tolist(), strict=True):
        totals[a] += n
    expected = {tuple(p): int(lm.quantise(np.log10((np.array([n]) - lm.DISCOUNT) / totals[p[0]]))[0]) for p, n in zip(pairs.tolist(), counts.tolist(), strict=True)}
    assert [expected.get(tuple(p), lm.MISSING) for p in asked.tolist()] == found.tolist()


def test_hard_cases(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 40)
    docs = hard(spark).selectExpr("*", "doc_id IS NULL OR doc_id <> 1 AS learns")
    scores, trie = lm.train_and_score(docs, train="learns")
    rows = [(i, t) for i, t, _ in HARD]
    total, expected = brute(rows, [i != 1 for i, _ in rows])
    got = scores.collect()
    assert {r.train_tokens for r in got} == {total}
    same(got, rows, expected)
    assert {r.level for r in trie.collect()} == {1, 2}
    none, _ = lm.train_and_score(empty(spark).selectExpr("*", "true AS learns"), train="learns")
    assert none.count() == 0
    unlearned, _ = lm.train_and_score(docs.selectExpr("doc_id", "text", "false AS train"))
    same(unlearned.collect(), rows, brute(rows, [False] * len(rows))[1])


def test_frequent_context_is_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 120)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 50)
    rows = [(i, " ".join(f"hot w{(37 * i + j) % 400}" for j in range(40))) for i in range(60)] + [(60, "hot w3 w4 w5"), (61, "w9 hot new")]
    df = spark.createDataFrame([(*r, r[0] % 5 != 1) for r in rows], "doc_id long, text string, train boolean").repartition(3)
    scores, trie = lm.train_and_score(df)
    total, expected = brute(rows, [i % 5 != 1 for i, _ in rows])
    same(scores.collect(), rows, expected)
    levels = [lm.Level(r.blobs) for r in trie.filter("level = 2").collect()]
    follow = {(a, b) for (_, t), learns in zip(rows, [i % 5 != 1 for i, _ in rows], strict=True) if learns for a, b in zip(["", *tokens(t)], tokens(t), strict=False)}
    assert sum(len(x.successors) for x in levels) == len(follow) > 400
    assert max(len(x.successors) for x in levels) <= 2 * 50


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    got = lm.op9_lm_scoring(spark, "/root/testdata/sf0.001").collect()
    total, expected = brute(rows, [not h for h in held])
    same(got, rows, expected)
    assert {r.doc_id: r.held_out for r in got} == {i: h for (i, _), h in zip(rows, held, strict=True)} and {r.train_tokens for r in got} == {total}
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
