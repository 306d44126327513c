"""Filter interaction audit against plain Python over all orders."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidewatch.llm import audit

NAMES = "ABCDE"
TEXTS = [
    (1, "s", "one two three"),
    (2, "s", "one two three"),
    (2, "s", "one two three"),
    (3, "t", "one two three"),
    (4, None, None),
    (5, "t", ""),
    (6, "s", "same " * 80),
    (7, "s", "ABC DEF & " * 30),
    (8, "u", " ".join(f"w{i}" for i in range(60))),
    (9, "u", "\t".join(f"w{i}" for i in range(49)) + "\nw0\x0b"),
    (None, "s", "one two three"),
    (None, "u", "# " * 50),
    (10, "u", "é" * 19 + "A"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 1, 1), (8, 1, 0), (None, 1, 1), (99, 1, 1)]


def fails(doc, text, rows):
    text = text or ""
    words = [w for w in __import__("re").split("[ \x09-\x0d]+", text) if w]
    found = set()
    if len(words) < 50:
        found.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        found.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
        found.add("C")
    if set(text) & set("#$%&*|"):
        found.add("D")
    if doc is not None and any(d is not None and d < doc and (t or "") == text for d, _, t in rows):
        found.add("E")
    return found


def expected(rows, labels):
    told = {}
    for doc, good, toxic in labels:
        if doc is not None:
            old = told.get(doc, (0, 0))
            told[doc] = (max(old[0], good), max(old[1], toxic))
    docs = [(part or "", fails(doc, text, rows), *told.get(doc, (0, 0))) for doc, part, text in rows]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shares = dict.fromkeys(NAMES, 0)
        for order in permutations(NAMES):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                shares[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in d[1] for d in own) - len(gone), sum(d[1] == {name} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shares[order[step - 1]])
    return out


def test_against_all_orders(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in ("part", "mask", "words", "digest", "s", "n")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    rows = audit.audit(docs, labels, audit.standard_filters()).collect()
    got = {
        (r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
        for r in rows
    }
    assert got == expected(TEXTS, LABELS)
    assert len(rows) == len(got) == 4 * 600


def test_shares_add_up_and_follow_the_potential(spark):
    """Efficiency: the shares of all filters are what all of them remove; the potential of one filter is its own count."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, source string, text string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    masks = audit.failures(docs, audit.standard_filters())
    for row in audit.potentials(audit.coalitions(audit.counts(masks, labels), 5), 5).collect():
        grand = row["potential"][31]
        assert sum(grand - 5 * row["potential"][31 - (1 << i)] for i in range(5)) == 120 * row["removed"][31]
        assert [row["potential"][1 << i] for i in range(5)] == [row["removed"][1 << i] for i in range(5)]


def test_other_filters(spark):
    """Two conditions of the caller, no repeats: two orders."""
    docs = spark.createDataFrame([(1, "a"), (2, "b b"), (3, "")], "id long, body string").withColumn("host", F.lit("h"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit.audit(docs, labels, {"x": F.size("words") < 2, "y": F.col("text") == ""}, "id", "host", "body").collect()
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in rows}
    assert got == {("xy", 1): (1, 2, 0, 3), ("xy", 2): (1, 0, 1, 1), ("yx", 1): (2, 1, 0, 1), ("yx", 2): (1, 1, 1, 3)}
    with pytest.raises(ValueError):
        audit.audit(docs, labels, {"long": F.lit(True)})


def test_hard_cases(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit.audit(cases.hard(spark), labels, audit.standard_filters()).collect()
    assert len(rows) == 600
    assert {r["kept"] + r["removed"] for r in rows if r["step"] == 1} == {len(cases.HARD)}
    assert audit.audit(cases.empty(spark), labels, audit.standard_filters()).collect() == []
