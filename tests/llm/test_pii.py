import random
import re
from collections import Counter

from tests.llm.cases import HARD, empty, hard
from tidewatch.llm import pii

RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1]))
            if (kind != 1 or all(int(p) < 256 for p in m[0].split("."))) and (kind != 2 or 16 <= len(digits) <= 19 and double % 10 == 0):
                if kind != 3 or 8 <= len(digits) <= 15:
                    out.append((kind, m.start(), m.end()))
    return out


def test_rules_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+- 2(3)é\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text


def test_field_on_held_out_rows():
    rows = pii.labelled(99)
    runs = [(i, run) for i, (text, _) in enumerate(rows) for run in pii.stretches(text)]
    labels = pii.decode([pii.features(rows[i][0], run) for i, run in runs], pii.default_model())
    hits = misses = extras = 0
    for (i, _), path in zip(runs, labels, strict=True):
        found = {pii.KINDS[(label - 1) // 2] for label in path if label}
        wanted = {kind for kind, _, _ in rows[i][1]}
        hits, misses, extras = hits + len(found & wanted), misses + len(wanted - found), extras + len(found - wanted)
    assert hits / (hits + misses) > 0.95 and hits / (hits + extras) > 0.95


def test_viterbi_equals_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    scores, moves = rng.normal(size=(3, 4, pii.LABELS)), np.where(pii._BARRED, -1e4, rng.normal(size=pii._BARRED.shape))
    sizes = np.array([4, 2, 1])
    for s, path, n in zip(scores, pii.viterbi(scores, sizes, moves), sizes, strict=True):
        def value(p, s=s):
            return sum(moves[a, b] + s[i, b] for i, (a, b) in enumerate(zip((pii.LABELS, *p), p, strict=False)))

        assert max(itertools.product(range(pii.LABELS), repeat=int(n)), key=value) == tuple(path[:n])


def test_phone_without_country_code_is_added_and_clean_numbers_are_not(spark):
    texts = ["call (415) 555-2671 today", "order 1234567890123456 of 2024-10-11 at 10:30", "mail joe.black@example.org or 10.0.0.1.", "token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\""]
    found = pii.all_spans(texts, pii.default_model())
    assert [(pii.KINDS[k], texts[0][s:e], b) for k, s, e, b in found[0]] == [("phone", "(415) 555-2671", False)]
    assert found[1] == [] and found[3] == []
    assert [(pii.KINDS[k], texts[2][s:e], b) for k, s, e, b in found[2]] == [("email", "joe.black@example.org", True), ("ip", "10.0.0.1", True)]


def test_hard_cases(spark):
    more = spark.createDataFrame([(20, "a@b.de, +49 30 1234567 und a@b.de", "de")], "doc_id long, text string, lang string")
    docs = hard(spark).unionByName(more, allowMissingColumns=True)
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.base)) for r in pii.find(docs).collect())
    rows = [(i, t) for i, t, _ in HARD] + [(20, "a@b.de, +49 30 1234567 und a@b.de")]
    assert got == Counter((i, tuple((pii.KINDS[k], s, e) for k, s, e in brute(t or ""))) for i, t in rows)
    clean = {(r.doc_id, r.text, r.fp) for r in pii.redact(docs).collect()}
    assert (20, "[email], [phone] und [email]", None) in clean and (2, None, "clash") in clean and (3, "", "clash") in clean
    assert pii.find(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_training_table_is_bounded(spark):
    rows = spark.createDataFrame([("call 555", [])], "text string, spans array<struct<kind:string,start:int,end:int>>")
    assert pii.all_spans(["call 555"], pii.model_of(rows)) == [[]]
    assert pii.all_spans(["call 555"], pii.fit([])) == [[]]


def test_the_query_tells_what_the_rules_and_the_field_find(spark):
    """Counts, digest and spans of op8 on whole documents, against the patterns and the spans found one by one."""
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    spans = dict(zip([i for i, _ in texts], pii.all_spans([t for _, t in texts], pii.default_model()), strict=True))

    def told(found):
        return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(found))

    rows = {r.doc_id: r for r in pii.op8_pii(spark, sf).collect()}
    assert set(rows) == set(spans) and any(brute(t) for _, t in texts)
    for i, text in texts:
        base, row = brute(text), rows[i]
        assert [row[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == n for k, _, _ in base) for n in range(len(pii.KINDS))]
        assert row.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        assert row.spans == told([s[:3] for s in spans[i]])
        assert {s[:3] for s in spans[i]} >= set(base)


def test_words_are_looked_at_whole():
    """What tells two long words apart behind character 200 changes their features; so do long neighbours."""
    def told(text):
        return pii.features(text, next(pii.stretches(text)))

    long = "a1" * 200
    assert told(long + "x") != told(long + "9") and told(long + "(415)") != told(long + "[415]")
    assert told("b" * 300 + "X 555") != told("b" * 300 + "y 555") and told("555 " + "b" * 300) != told("555 " + "c" * 300 + "D")
    assert told("call 555 now") == told("call   555\nnow")
