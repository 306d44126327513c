"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, whole. The character spans of its tokens are
interval-joined with the spans of its sections, and each token goes to one section
by the rule START: the section that holds the token's first character. A token that
begins inside a character begins at that character. With the rule SHARE a token is
split over the sections in proportion to its bytes.

Sections of ``by_line`` are the lines, each with its line break; they cover the text,
so the counts of a document add up to its tokens. Defined results: a null or empty
text has no tokens and no section; repeated rows give repeated results; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.bpe import VOCABULARY, batches, codec, encode
from tidewatch.llm.text import pick
from tidewatch.plans.registry import query
from tidewatch.session import table

START, SHARE = "start", "share"


def attribute(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = START) -> np.ndarray:
    """Tokens of each section.

    ``sizes``: bytes of each token in order; ``starts`` and ``ends``: byte spans of the
    sections, sorted and disjoint; text outside every section is left out.
    """
    if rule not in (START, SHARE):
        raise ValueError(f"unknown rule {rule}")
    upto = np.concatenate([[0], np.cumsum(sizes)])
    if rule == START:
        return np.searchsorted(upto[:-1], ends) - np.searchsorted(upto[:-1], starts)

    def passed(at: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(upto, at, side="right") - 1, 0, max(len(sizes) - 1, 0))
        return i + (at - upto[i]) / np.maximum(sizes[i], 1) if len(sizes) else np.zeros(len(at))

    return passed(ends) - passed(starts)


def _lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    ends = ends[ends > 0]
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def by_line(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: str = START, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens, sections (start, end in characters, tokens).

    Texts are recovered from the ids, byte by byte, so only ids travel between the steps.
    """
    number = pa.int64() if rule == START else pa.float64()
    section = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("tokens", number)])
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("sections", pa.list_(section))])

    def one(doc: int | None, ids: bytes) -> tuple:
        coder = codec(vocabulary)
        ids = np.frombuffer(ids, dtype="<u4")
        data = coder.spell(ids)
        if not data:
            return doc, 0, []
        sizes = coder.sizes[ids]
        starts, ends = _lines(data)
        raw = np.frombuffer(data, dtype=np.uint8)
        first = (raw & 0xC0) != 0x80
        if not first.all():  # a token inside a character begins where the character does
            head = np.maximum.accumulate(np.where(first, np.arange(len(raw)), 0))
            at = head[np.concatenate([[0], np.cumsum(sizes)[:-1]])]
            sizes = np.diff(np.append(at, len(raw))) if rule == START else sizes
        counts = attribute(sizes, starts, ends, rule)
        chars = np.concatenate([[0], np.cumsum(first)])
        spans = zip(chars[starts].tolist(), chars[ends].tolist(), counts.tolist(), strict=True)
        return doc, len(ids), [{"start": a, "end": b, "tokens": n} for a, b, n in spans]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            one(doc, ids)
            for part in parts
            for doc, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
        )
        yield from batches(schema, rows, lambda r: 8 * len(r[2]))

    kind = "long" if rule == START else "double"
    return encode(df, doc_id, text, vocabulary).mapInArrow(
        run, f"doc_id long, n_tokens long, sections array<struct<start:long,end:long,tokens:{kind}>>"
    )


def fields(df: DataFrame, row_id: str, names: list[str], separator: str = "\n", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each field of a record whose fields are encoded as one text.

    A separator belongs to the field before it. One row per record: row_id, n_tokens and
    ``tokens``, one count per name. A null field counts as empty.
    """
    parts = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
    ends = F.array(*[F.octet_length(F.concat_ws(separator, *parts[:i + 1])) for i in range(len(parts))])
    keyed = df.select(
        F.col(f"`{row_id}`").cast("bigint").alias("doc_id"), F.concat_ws(separator, *parts).alias("text"), ends.alias("ends"),
    )
    keyed = keyed.withColumn("digest", F.sha2("text", 256))
    sep = len(separator.encode())
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)

        def rows() -> Iterator[tuple]:
            for batch in batches_:
                for row in batch.to_pylist():
                    ids = np.frombuffer(coder.encode(row["text"]), dtype="<u4")
                    ends_ = np.array(row["ends"], dtype=np.int64) + sep
                    starts_ = np.concatenate([[0], ends_[:-1]])
                    yield row["doc_id"], row["digest"], len(ids), attribute(coder.sizes[ids], starts_, ends_).tolist()

        yield from batches(schema, rows(), lambda r: 8)

    return keyed.mapInArrow(run, "doc_id long, digest string, n_tokens long, tokens array<long>").drop("digest")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens of every whole text by line: how many, the most in a line, and the list."""
    done = by_line(pick(table(spark, directory, "documents"), doc_id="doc_id", text="text"))
    counts = F.transform("sections", lambda s: s["tokens"])
    return done.select(
        "doc_id", "n_tokens", F.size("sections").cast("bigint").alias("n_sections"),
        F.coalesce(F.array_max(counts), F.lit(0)).cast("bigint").alias("most_tokens"),
        F.array_join(counts.cast("array<string>"), ",").alias("section_tokens"),
    )
