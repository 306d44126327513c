"""Vectorised words and hashes over Arrow string columns, shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes handled by one vectorised step; a longer text is a step of its own.
STEP_BYTES = 1 << 18

#: Odd factor of the polynomial word hash and its inverse modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class(pattern_bytes: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[pattern_bytes] = False
    return table


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = _class([0x20, *range(0x09, 0x0E)])
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are in lower case.
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_powers: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < size:
        size = max(size, STEP_BYTES + 1)
        for name, factor in (("up", _FACTOR), ("down", _INVERSE)):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def release() -> None:
    """Give back what a worker need not keep between tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()


def few(parts: Iterator[pa.RecordBatch], rows: int = 1 << 10) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a copy of one stays small; gives back memory at the end."""
    for part in parts:
        for low in range(0, part.num_rows, rows):
            yield part.slice(low, rows)
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after the other, and the rows' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def hashed_words(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words of consecutive rows: (first row, end row, words before each row, hashes).

    A-Z count as lower case. Each step covers rows of about STEP_BYTES, so
    memory follows the longest text, not the batch. ``words before each row``
    has one entry more than the step has rows.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1
        end = min(max(end, row + 1), rows)
        low, high = int(offsets[row]), int(offsets[end])
        local = offsets[row:end + 1] - low
        part = _LOWER[data[low:high]]
        inside = kind[part]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0] = after[-1] = False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cuts = local[(local > 0) & (local < len(inside))]
            before[cuts] = False
            after[cuts - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        yield row, end, np.searchsorted(starts, local), hashes
        row = end


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words; one of all words when there are fewer."""
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    out = np.full(n, min(size, len(words)), dtype=np.uint64)
    for i in range(min(size, len(words))):
        out = mix(out * np.uint64(_FACTOR) + words[i:i + n])
    return out


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator works on, under its own names.

    Extra columns and clashing names of the caller's table stay outside.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
