import hashlib
import random
from collections import Counter

import numpy as np

from tests.llm.cases import HARD, empty, hard
from tidewatch.llm import bpe, tokencount


def library(text):
    return bpe.packed(bpe.codec(bpe.VOCABULARY).library.encode(text or "", add_special_tokens=False).ids)


def test_tree_concatenation_equals_the_whole(monkeypatch):
    coder = bpe.codec(bpe.VOCABULARY)
    rng = random.Random(5)
    for k in range(300):
        text = "".join(rng.choice("abcdeé ñ12.\n  !the-'_") for _ in range(rng.randint(0, 300)))
        if k % 3 == 0:
            text = text.translate({ord(c): None for c in " \n.!"})
        if k % 7 == 0:
            text += bpe.SPECIAL + text[:20]
        monkeypatch.setattr(bpe, "LEAF", 10**6)
        whole = coder.encode(text)
        assert whole == library(text)
        monkeypatch.setattr(bpe, "LEAF", rng.choice([5, 17, 40]))
        monkeypatch.setattr(bpe, "WINDOW", rng.choice([1, 2, 8]))
        leaves = list(coder.leaves(text))
        assert "".join(part for _, part in leaves) == text
        coded = [(kind, bpe.packed(coder.piece(part.encode())) if kind else coder.encode(part)) for kind, part in leaves]
        assert bpe.concatenate(coder, coded) == whole


def test_every_plain_character_is_split_like_the_library():
    coder = bpe.codec(bpe.VOCABULARY)
    for c in [chr(i) for i in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]:
        text = f"a{c}b 1{c}2 {c}{c} .{c}. {c}a {c}1"
        assert coder.encode(text) == library(text), hex(ord(c))


def test_hard_cases(spark):
    done = bpe.decode(bpe.encode(hard(spark))).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in done) == Counter((i, library(t), t or "") for i, t, _ in HARD)
    assert bpe.encode(empty(spark)).count() == 0


def test_documents_keep_ids_and_text(spark):
    from tidewatch.llm.bpe import op2_bpe_roundtrip

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op2_bpe_roundtrip(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_line_counts_equal_the_offsets_of_the_library(spark):
    tokenizer = bpe.codec(bpe.VOCABULARY).library
    got = Counter((r.doc_id, r.n_tokens, tuple(tuple(s) for s in r.sections)) for r in tokencount.by_line(hard(spark)).collect())
    expected = Counter()
    for doc, text, _ in HARD:
        text = text or ""
        lines, at = [], 0
        for line in text.split("\n"):
            end = min(at + len(line) + 1, len(text))
            if end > at:
                lines.append((at, end))
            at = end
        offsets = tokenizer.encode(text, add_special_tokens=False).offsets
        counts = Counter(next(i for i, (a, b) in enumerate(lines) if a <= start < b) for start, _ in offsets)
        expected[doc, len(offsets), tuple((a, b, counts[i]) for i, (a, b) in enumerate(lines))] += 1
    assert got == expected
    assert tokencount.by_line(empty(spark)).count() == 0


def test_shares_and_fields(spark):
    sizes = np.array([3, 2, 4])
    assert tokencount.attribute(sizes, np.array([0, 4]), np.array([4, 9])).tolist() == [2, 1]
    assert np.allclose(tokencount.attribute(sizes, np.array([0, 4]), np.array([4, 9]), "share"), [1.5, 1.5])
    df = spark.createDataFrame([(1, "one two", None, "three"), (2, None, None, None)], "id long, a string, b string, c string")
    rows = {r.doc_id: r for r in tokencount.fields(df, "id", ["a", "b", "c"]).collect()}
    assert all(sum(r.tokens) == r.n_tokens and len(r.tokens) == 3 for r in rows.values())
    assert rows[1].tokens[0] == 3 and rows[1].tokens[2] >= 1


def test_the_count_query_on_whole_documents(spark):
    """op6 against the library's own offsets: a token counts for the line its first character is in."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines = {r.doc_id: [(s.start, s.end, s.tokens) for s in r.sections] for r in tokencount.by_line(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for row in tokencount.op6_token_counts(spark, sf).collect():
        text, own = texts[row.doc_id], lines[row.doc_id]
        ids = library(text)
        assert row.n_tokens == len(ids) and sum(t for *_, t in own) == len(ids)
        assert row.section_tokens == ",".join(str(t) for *_, t in own) and row.n_sections == len(own)
        assert row.most_tokens == max([t for *_, t in own], default=0)
        assert "".join(text[a:b] for a, b, _ in own) == text
