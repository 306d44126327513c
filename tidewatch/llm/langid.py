"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point. An
n-gram's vector binds its letters: the first one's vector rotated n-1 places, the next
one's n-2 places, ..., multiplied element by element. A text bundles (adds up) the
vectors of its n-grams, a language the vectors of its training texts; a text gets the
language whose prototype has the largest cosine with it (ties: the first name).

Letters are compared in lower case; everything else counts as one border mark
between words. Defined results: a null text and one without letters get ``und`` and
score 0, and so does any text when there is no language to learn from; rows whose
language is null are not learned from; repeated rows count repeatedly; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.text import few, fold, pick
from tidewatch.plans.registry import query
from tidewatch.session import table

UNKNOWN = "und"
#: Length of the vectors and of the n-grams.
DIMENSIONS, GRAM = 1024, 3
#: n-gram vectors that a task remembers, those bound in one step, and rows of one batch.
REMEMBERED, STEP, ROWS = 32_768, 4_096, 4_096
#: Languages beyond this number are refused: prototypes go to every task.
MOST_LANGUAGES = 10_000


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@functools.cache
def letter_vector(code: int) -> np.ndarray:
    """The random +1/-1 vector of a code point (0: the border mark)."""
    bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as packed code points, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.int64)
    border = codes == 0
    if border.all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(border[1:] & border[:-1])
    keep[[0, -1]] &= ~border[[0, -1]]
    codes = codes[keep]
    codes = np.concatenate([[0], codes if codes[-1] else codes[:-1], [0]])  # one border at each end
    n = len(codes) - GRAM + 1
    packed = np.zeros(n, dtype=np.int64)
    for i in range(GRAM):
        packed = packed << 21 | codes[i:i + n]
    return np.unique(packed, return_counts=True)


def bind(packed: np.ndarray) -> np.ndarray:
    """Vectors of packed n-grams."""
    out = np.ones((len(packed), DIMENSIONS), dtype=np.int8)
    for i in range(GRAM):
        letters, at = np.unique(packed >> 21 * (GRAM - 1 - i) & 0x1FFFFF, return_inverse=True)
        vectors = np.stack([np.roll(letter_vector(int(c)), GRAM - 1 - i) for c in letters])
        out *= vectors[at]
    return out


class Memory:
    """n-gram vectors a task has bound already."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.int64)
        self.rows = np.zeros((0, DIMENSIONS), dtype=np.int8)

    def learn(self, packed: np.ndarray) -> None:
        """Make room for the n-grams of a batch, as far as there is room."""
        new = np.setdiff1d(packed, self.keys)
        if len(self.keys) + len(new) > REMEMBERED:
            self.__init__()
            new = np.unique(packed)[:REMEMBERED]
        if len(new):
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys)
            parts = [self.rows] + [bind(new[i:i + STEP]) for i in range(0, len(new), STEP)]
            self.keys, self.rows = keys[order], np.concatenate(parts)[order]

    def bundle(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors."""
        total = np.zeros(DIMENSIONS)
        for i in range(0, len(packed), STEP):
            part = packed[i:i + STEP]
            at = np.minimum(np.searchsorted(self.keys, part), max(len(self.keys) - 1, 0))
            if len(self.keys) and (self.keys[at] == part).all():
                rows = self.rows[at]
            else:
                rows = bind(part)
            total += counts[i:i + STEP].astype(np.float32) @ rows.astype(np.float32)
        return total


def _steps(texts: list[str | None], size: int = 1 << 21) -> Iterator[tuple[int, list]]:
    """n-grams of consecutive texts, by about ``size`` characters."""
    first, held, chars = 0, [], 0
    for i, text in enumerate(texts):
        held.append(grams(text or ""))
        chars += len(text or "")
        if chars >= size:
            yield first, held
            first, held, chars = i + 1, [], 0
    if held:
        yield first, held


def prototypes(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Bundled vector of every language, learned from all rows with a language.

    Tasks add up their own rows; one vector per task and language is shuffled by element.
    """
    schema = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in few(parts, ROWS):
            names = part.column(1).to_pylist()
            for first, held in _steps(part.column(0).to_pylist()):
                own = names[first:first + len(held)]
                for name in set(own):
                    mine = [g for g, n in zip(held, own, strict=True) if n == name]
                    packed, at = np.unique(np.concatenate([p for p, _ in mine]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([c for _, c in mine]), minlength=len(packed))
                    total = totals.setdefault(name, np.zeros(DIMENSIONS))
                    for i in range(0, len(packed), STEP):
                        total += counts[i:i + STEP] @ bind(packed[i:i + STEP]).astype(np.float64)
        for name, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()], schema.field(1).type)], schema=schema)

    rows = pick(df, text=text, lang=lang).filter("lang is not null and text is not null")
    sums = rows.mapInArrow(run, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("i", "x"))
    sums = sums.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("vector"))
    found = sums.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    learned = {r["lang"]: np.array([x["x"] for x in r["vector"]]) for r in found}
    return {name: v for name, v in sorted(learned.items()) if v.any()}


def identify(df: DataFrame, learned: dict[str, np.ndarray], text: str = "text", prefix: str = "") -> DataFrame:
    """The rows of ``df`` with ``lang_pred`` and ``score`` (cosine, at least 0) added.

    Only the text is read for the prediction; other columns pass through. ``prefix``
    goes before the new names, which replace columns of the same name.
    """
    names = list(learned)
    matrix = np.stack([learned[n] / np.linalg.norm(learned[n]) for n in names]) if names else np.zeros((0, DIMENSIONS))
    shared = df.sparkSession.sparkContext.broadcast((names, matrix))
    kept = [c for c in df.columns if c not in (f"{prefix}lang_pred", f"{prefix}score")]
    fields = [f for f in df.schema.fields if f.name in kept]
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*fields, StructField(f"{prefix}lang_pred", StringType()), StructField(f"{prefix}score", DoubleType())])
    at_text = kept.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        memory = Memory()
        for part in few(parts, ROWS):
            best, scores = [], []
            for _, held in _steps(part.column(at_text).to_pylist()):
                memory.learn(np.unique(np.concatenate([p for p, _ in held])))
                for packed, counts in held:
                    if not len(packed) or not names:
                        best.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    vector = memory.bundle(packed, counts)
                    cosines = matrix @ (vector / max(np.linalg.norm(vector), 1e-12))
                    i = int(np.argmax(cosines))
                    best.append(names[i])
                    scores.append(float(min(max(cosines[i], 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                names=[*part.schema.names, f"{prefix}lang_pred", f"{prefix}score"],
            )

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """One document in three, by the checksum of its id, is not learned from."""
    return fold(doc_id, 3) == 1


@query("op1_language_id")
def op1_language_id(spark: SparkSession, directory: str) -> DataFrame:
    """Predicted language of every document."""
    docs = pick(table(spark, directory, "documents"), doc_id="doc_id", text="text", lang="lang")
    learned = prototypes(docs.filter(~held_out(F.col("doc_id"))))
    done = identify(docs.select("doc_id", "text"), learned)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
