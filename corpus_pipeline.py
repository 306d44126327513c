"""Corpus pipeline over ``documents``: language, near copies, benchmark, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; its result is written
as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Rows with the same id and text are copies; rows without an id are told apart by
their text. Stages join on ``KEY``, a 64-bit hash of id and text that is never null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontam, langid, pii, setjoin
from tidewatch.session import discard, materialise, step, table

#: A text of at least this many characters that is this far from every language is rejected.
REJECT_CHARS, REJECT_COSINE = 400, 0.1
#: Near copies: words of a shingle and least percentage of the union.
SHINGLE, PERCENT = 5, 80
#: Name of a row in joins.
KEY = "stage_key"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64(F.col("doc_id"), F.col("text")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and long ones unlike every language; fills in a missing language."""
    told = langid.identify(docs, langid.prototypes(docs), prefix="stage_")
    far = (F.char_length("text") >= REJECT_CHARS) & (F.col("stage_score") < REJECT_COSINE)
    kept = told.filter((F.col("stage_lang_pred") != langid.UNKNOWN) & ~far)
    return kept.withColumn("lang", F.coalesce("lang", "stage_lang_pred")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, once: the one with the smallest id, one without an id if none has one."""
    rows = keyed(docs)
    classes = setjoin.linked_classes(rows, doc_id=KEY, shingle=SHINGLE, percent=PERCENT)
    classes = classes.select(F.col("doc_id").alias(KEY), "component_id").distinct()
    named = rows.select(KEY, "doc_id").distinct().join(classes, KEY)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(KEY))
    heads = named.groupBy("component_id").agg(F.min_by(KEY, order).alias("head")).select(F.col("head").alias(KEY))
    kept = rows.join(step(heads, "heads"), KEY, "left_semi")
    # KEY follows from the two, and copies are together by it since the join: texts move once
    return kept.dropDuplicates([KEY, "doc_id", "text"]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents in which a window of a benchmark item stands."""
    rows = keyed(docs)
    index = decontam.build_index(rows.drop("doc_id").withColumnRenamed(KEY, "doc_id"), decontam.term_filter(table(spark, sf_dir, "benchmark")))
    hit = decontam.phrase_matches(index, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(KEY)).distinct()
    # few against the rows: its measured size lets the join leave the texts where they are
    hit = step(hit, "contaminated")
    discard(index)
    return rows.join(hit, KEY, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them."""
    done = bpe.decode(bpe.encode(docs))
    return done.select(
        "doc_id", F.col("decoded").alias("text"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", decontaminate),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: The prototypes, the random field and the merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written before the next reads it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
