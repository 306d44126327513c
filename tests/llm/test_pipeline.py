"""Stages against brute force, and the queries that have comparison SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from tests.llm.cases import empty, hard
from tests.llm.test_bpe import library
from tests.llm.test_decontam import words
from tests.llm.test_pii import brute as rule_spans
from tests.llm.test_setjoin import brute as classes
from tidewatch.llm import pii
from tidewatch.session import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_language_stage_drops_only_what_has_no_language(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[:2])
    assert set(after) == {i for i, r in before.items() if r.text and any(c.isalpha() for c in r.text)}
    assert stages[1].columns == stages[0].columns


def test_one_document_of_each_class_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({c for _, _, c in classes(rows, P.SHINGLE, P.PERCENT)})


def test_texts_move_once_behind_the_classes(spark, stages):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = P.near_copies(spark, stages[1], SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 2


def test_contaminated_documents_go(spark, stages):
    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        runs |= {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(r) for r in runs}

    def hit(text):
        w = words(text)
        return any(tuple(w[i:i + n]) in runs for n in sizes for i in range(len(w) - n + 1))

    assert {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect() if not hit(r.text)}


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, r in before.items():
        spans = pii.all_spans([r.text], pii.default_model())[0]
        assert {s[:3] for s in spans if s[3]} == set(rule_spans(r.text))
        assert after[i].text == pii.masked(r.text, spans) and after[i].n_chars == len(after[i].text)
        assert (after[i].lang, after[i].source) == (r.lang, r.source)


def test_tokens_of_the_rest(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert {r.doc_id: (r.text, r.n_tokens) for r in got} == {i: (t, len(library(t)) // 4) for i, t in texts.items()}


def test_run_and_hard_cases(spark, stages):
    assert P.run(spark, SF).count() == stages[5].count()
    for make in (hard, empty):
        docs = make(spark)
        for name, stage in P.STAGES:
            columns = docs.columns
            docs = materialise(stage(spark, docs, SF), name)
            assert name == "bpe" or docs.columns == columns
    assert docs.count() == 0


def test_rows_without_an_id(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) >= 10)
    near = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [
        (None, near[0]), (None, near[0] + " more"), (None, near[0]),  # copies of each other
        (7, near[1]), (None, near[1] + " more"), (-3, near[1] + " most"),  # copies of rows with ids
        (None, near[2]), (9, "alone in the world"), (None, f"before {item} after"), (10, f"so {item}"), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in P.near_copies(spark, docs, SF).collect()]
    first = [x for x in left if x in rows[:3]]
    assert len(first) == 1 and sorted(map(str, left)) == sorted(map(str, first + rows[5:8] + rows[9:]))  # 10 holds the item of the one before it
    clean = [(r.doc_id, r.text) for r in P.decontaminate(spark, docs, SF).collect()]
    assert sorted(map(str, clean)) == sorted(map(str, rows[:8] + rows[10:]))


def plain(value):
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", ["op3_decontamination", "op5_ngram_jaccard_join", "op7_chat_formatting"])
def test_queries_equal_their_sql(spark, name):
    database = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        database.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    theirs = sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in result.fetchall())
    assert sorted(names) == columns and sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == theirs


def test_every_operator_is_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == [] and "pipeline" in entry.queries()
