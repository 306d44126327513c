"""Merkle manifest against a plain tree in Python, and tampering."""

import random
from hashlib import sha256

from pyspark.sql import functions as F

from tests.llm import cases
from tidewatch.llm import merkle


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def tree(digests, fanout):
    """(root, siblings before and after by leaf and level)."""
    paths, level, at = [[] for _ in digests], digests, list(range(len(digests)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            first = i // fanout * fanout
            path.append(("".join(level[first:i]), "".join(level[i + 1:first + fanout])))
        level = [h(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], paths


def expected(rows, fanout):
    """(id, text) -> leaf, subroot, root and siblings of each row of (id, part, text)."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    parts = {}
    for doc, part, text in rows:
        parts.setdefault(part, []).append((doc is not None, doc or 0, h(field(doc), field(part), field(text)), doc))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: tree([leaf for *_, leaf, _ in sorted(parts[p], key=lambda r: r[:3])], fanout) for p in order}
    root, above = tree([trees[p][0] for p in order], fanout)
    out = []
    for p, high in zip(order, above):
        for (*_, leaf, doc), low in zip(sorted(parts[p], key=lambda r: r[:3]), trees[p][1]):
            out.append((doc, leaf, trees[p][0], root, h(*[a + b for a, b in low + high])))
    return sorted(out, key=str)


def told(spark, rows, fanout, clash=()):
    df = spark.createDataFrame(rows, "doc_id long, part string, text string")
    df = df.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("part"), F.col("text"))).withColumns({c: F.lit("x") for c in clash})
    made = merkle.manifest(df, "part", ["doc_id"], ["doc_id"], fanout)
    shown = merkle.verified(made.leaves, "leaf").select(
        "doc_id", *[merkle.text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], merkle.proof_digest(F.col("path")).alias("proof"), "verified"
    ).collect()
    assert all(r["verified"] for r in shown)
    return sorted([tuple(r)[:5] for r in shown], key=str), made


def test_against_plain_trees(spark):
    random.seed(3)
    rows = [(i, f"p{random.randrange(4)}", f"text {i}\n") for i in range(90)] + [(500, "alone", "x"), (501, None, "null part"), (502, "", "empty part")]
    random.shuffle(rows)
    for fanout in (2, 3, 5):
        got, made = told(spark, rows, fanout, ["pos", "left", "grp", "digest", "load", "path", "root", "level", "o0"])
        assert got == expected(rows, fanout)
        assert {(r["part"], r["subroot"].hex()) for r in made.parts.collect()} == {(p, s) for (_, p, _) in rows for s in {g[2] for g in got} if (p, s) in {
            (q, e[2]) for e in expected(rows, fanout) for (d, q, _) in rows if d == e[0]}}


def test_nulls_ties_repeats_and_single_rows(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (None, "a", None), (None, "a", ""), (2, "é", "z"), (3, "z", "z"), (4, "a", "日本" * 10)]
    got, _ = told(spark, rows, 3)
    # rows equal in everything have proofs of their own, in any order
    assert got == expected(rows, 3)
    one, _ = told(spark, rows[:1], 3)
    assert one == expected(rows[:1], 3) and one[0][1] == one[0][3]


def test_a_hot_part_is_numbered_over_many_tasks(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("grp"), (5000 - F.col("id")).alias("o"))
    done = merkle.numbered(rows, "grp", ["o"]).groupBy("grp").agg(
        F.collect_list(F.struct("o", "pos")).alias("all"), F.max("left").alias("left"), F.count(F.lit(1)).alias("n")
    )
    for row in done.collect():
        assert row["left"] == row["n"]
        assert [p for _, p in sorted((r["o"], r["pos"]) for r in row["all"])] == list(range(row["n"]))


def test_a_changed_text_is_found(spark):
    df = spark.createDataFrame([(i, "s", f"line {i}\nend") for i in range(20)], "doc_id long, part string, text string")
    fields = [F.col("doc_id"), F.col("part")]
    df = df.withColumns({"leaf": merkle.leaf(*fields, F.col("text")), "now": merkle.leaf(*fields, F.when(F.col("doc_id") == 7, F.lit("line 7 end")).otherwise(F.col("text")))})
    rows = merkle.verified(merkle.manifest(df, "part", ["doc_id"], ["doc_id", "now"]).leaves, "now").collect()
    assert {r["doc_id"] for r in rows if not r["verified"]} == {7}


def test_hard_cases(spark):
    def run(df):
        return merkle.manifest(df.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("text"))), "lang", ["doc_id"], ["doc_id"])

    made = run(cases.hard(spark))
    assert merkle.verified(made.leaves, "leaf").filter("verified").count() == len(cases.HARD)
    assert made.parts.select("root").distinct().count() == 1
    nothing = run(cases.empty(spark))
    assert nothing.leaves.collect() == [] and nothing.parts.collect() == []
