"""BPE encoding and decoding by tree concatenation.

A short text is encoded as it stands. A long one is cut where no token can cross
(a printable character before a space); a long stretch without such a place is cut
at pre-token borders, and a single long pre-token into leaves of LEAF characters.
Leaves are rows of their own, encoded in parallel by different tasks. Adjacent
leaves of one pre-token are then joined pairwise, level by level: the tokens around
a join are re-encoded in a window that grows until its first token equals the left
side's and its last token equals the right side's. All neighbouring pairs of tokens
are then pairs that the merges leave apart, which holds for one token sequence
only: the encoding of the whole.

Defined results: a null text counts as empty; an empty text has no tokens. Repeated
rows give repeated results. Extra columns are ignored. An empty table gives an empty
table. The special token's string inside a text becomes its id, as in the library.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.text import few, pick
from tidewatch.plans.registry import query
from tidewatch.session import table

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Characters of a leaf; a text of more than LONG characters is cut into leaves.
LEAF = 16_384
LONG = 4 * LEAF
#: Tokens on each side of a join in the first window.
WINDOW = 8
#: Remembered pre-tokens of a worker, emptied when full; longer ones are not kept.
REMEMBERED, REMEMBERED_BYTES = 200_000, 40
#: Texts that leave a task in one Arrow batch, by tokens.
BATCH_TOKENS = 1 << 20

#: Kinds of leaves.
TEXT, WHOLE, OPEN = 0, 1, 2
#: Characters on whose classes (letter, number, space) Python and the library agree.
_RARE = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]")
#: The library's pre-tokens of such characters, in the syntax of ``re``.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SAFE_CUT = re.compile("[!-~\xc0-\xd6\xd8-\xf6](?= [!-~])")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Vocabulary of one process."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        lines = map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.special = len(ranks)
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])] + [SPECIAL.encode()]
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.letters = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.merges = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )._core_bpe
        self.file = public_tokenizers.path(f"{name}.json")
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def piece(self, word: bytes) -> list[int]:
        """Tokens of one pre-token, or of a part of it."""
        if len(word) <= LEAF:
            return self.merges.encode_single_piece(word)
        middle = len(word) // 2
        return self.join(self.piece(word[:middle]), self.piece(word[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the concatenation of two parts of one pre-token."""
        if not left or not right:
            return left + right
        size = WINDOW
        while True:
            low, high = max(len(left) - size, 0), min(size, len(right))
            near = left[low:] + right[:high]
            again = self.merges.encode_single_piece(b"".join(map(self.tokens.__getitem__, near)))
            starts = low == 0 or again[0] == near[0]
            ends = high == len(right) or again[-1] == near[-1]
            if starts and ends:
                return left[:low] + again + right[high:]
            size *= 2

    def _word(self, word: str) -> bytes:
        ids = packed(self.piece(word.encode()))
        if len(word) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if _RARE.search(text):
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        known, new = self.known, self._word
        return b"".join([known.get(w) or new(w) for w in _WORDS.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if SPECIAL not in text:
            return self._plain(text)
        return packed([self.special]).join(map(self._plain, text.split(SPECIAL)))

    def spell(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.letters[shift + np.arange(len(shift))].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.spell(np.frombuffer(ids, dtype="<u4")).decode("utf-8", errors="replace")

    def leaves(self, text: str) -> Iterator[tuple[int, str]]:
        """Parts of a long text and their kinds: TEXT, WHOLE (a pre-token) or OPEN (a part of one that goes on)."""
        cut = 0
        while len(text) - cut > LEAF:
            found = None
            for found in _SAFE_CUT.finditer(text, cut, cut + LEAF):
                pass
            if found is None:
                found = _SAFE_CUT.search(text, cut + LEAF - 1)
            end = found.end() if found else len(text)
            if end - cut <= 2 * LEAF or _RARE.search(text, cut, end) or SPECIAL in text[cut:end]:
                yield TEXT, text[cut:end]
            else:
                yield from self._unsplit(text[cut:end])
            cut = end
        if cut < len(text):
            yield TEXT, text[cut:]

    def _unsplit(self, text: str) -> Iterator[tuple[int, str]]:
        """Cuts after pre-tokens that end in a printed character; white space looks ahead."""
        start = safe = 0
        spaces: list[str] = []
        for word in _WORDS.finditer(text):
            low, high = word.span()
            if high - low > LEAF:
                if safe > start:
                    yield TEXT, text[start:safe]
                for space in spaces:
                    yield WHOLE, space
                for at in range(low, high, LEAF):
                    yield OPEN if at + LEAF < high else WHOLE, text[at:min(at + LEAF, high)]
                start = safe = high
                spaces = []
            elif text[high - 1].isspace():
                spaces.append(word.group())
            else:
                safe, spaces = high, []
                if safe - start > LEAF:
                    yield TEXT, text[start:safe]
                    start = safe
        if start < len(text):
            yield TEXT, text[start:]


@functools.cache
def codec(name: str) -> Codec:
    return Codec(name)


def batches(schema: pa.Schema, rows: Iterator[tuple], weigh) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about BATCH_TOKENS in total weight."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row) + 16
        if weight >= BATCH_TOKENS:
            yield _batch(schema, held)
            held, weight = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _encoded(name: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(name).encode
        rows = (
            (doc, encode(text or ""))
            for part in few(parts)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
        )
        yield from batches(schema, rows, lambda r: len(r[1]) // 4)

    return run


def _cut(name: str):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("digest", pa.string()), ("copies", pa.int64()), ("leaf", pa.int32()),
        ("kind", pa.int32()), ("part", pa.string()),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = codec(name).leaves
        rows = (
            (row["doc_id"], row["digest"], row["copies"], i, kind, leaf)
            for part in few(parts)
            for row in part.to_pylist()
            for i, (kind, leaf) in enumerate(cut(row["text"]))
        )
        yield from batches(schema, rows, lambda r: len(r[5]))

    return run


def _encode_leaves(name: str):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("digest", pa.string()), ("copies", pa.int64()), ("leaf", pa.int32()),
        ("kind", pa.int32()), ("ids", pa.binary()),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(name)

        def ids(row: dict) -> bytes:
            if row["kind"] != TEXT:
                return packed(coder.piece(row["part"].encode()))
            return coder.encode(row["part"])

        rows = (
            (row["doc_id"], row["digest"], row["copies"], row["leaf"], row["kind"], ids(row))
            for part in few(parts)
            for row in part.to_pylist()
        )
        yield from batches(schema, rows, lambda r: len(r[5]) // 4)

    return run


def concatenate(coder: Codec, leaves: list[tuple[int, bytes]]) -> bytes:
    """Ids of a text from its leaves in order, joined pairwise, level by level."""
    out, run = [], []
    for kind, ids in leaves:
        if kind != OPEN and not run:
            out.append(ids)
            continue
        run.append(np.frombuffer(ids, dtype="<u4").tolist())
        if kind != OPEN:  # the last leaf of a pre-token
            while len(run) > 1:
                pairs = [coder.join(a, b) for a, b in zip(run[::2], run[1::2], strict=False)]
                run = pairs + run[2 * len(pairs):]
            out.append(packed(run.pop()))
    return b"".join(out)


def _join_leaves(name: str):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("leaf")
        leaves = list(zip(group["kind"].to_pylist(), group["ids"].to_pylist(), strict=True))
        ids = concatenate(codec(name), leaves)
        return pa.table({
            "doc_id": group["doc_id"].slice(0, 1), "copies": group["copies"].slice(0, 1), "ids": pa.array([ids], pa.binary()),
        })

    return run


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``df``: doc_id, ids (binary, little-endian 32-bit)."""
    docs = pick(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    is_long = F.coalesce(F.char_length("text") > LONG, F.lit(False))
    short = docs.filter(~is_long).mapInArrow(_encoded(vocabulary), "doc_id long, ids binary")
    long = docs.filter(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    long = long.withColumn("digest", F.sha2("text", 256))
    leaves = long.mapInArrow(_cut(vocabulary), "doc_id long, digest string, copies long, leaf int, kind int, part string")
    leaves = leaves.repartition(F.col("doc_id"), F.col("digest"), F.col("leaf"))
    coded = leaves.mapInArrow(_encode_leaves(vocabulary), "doc_id long, digest string, copies long, leaf int, kind int, ids binary")
    whole = coded.groupBy("doc_id", "digest").applyInArrow(_join_leaves(vocabulary), "doc_id long, copies long, ids binary")
    whole = whole.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")
    return short.unionByName(whole)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of an ``encode`` result with the decoded text: doc_id, ids, decoded."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = codec(vocabulary).decode
        rows = (
            (doc, ids, back(ids or b""))
            for part in few(parts)
            for doc, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
        )
        yield from batches(schema, rows, lambda r: len(r[1] or b"") // 4)

    return pick(df, doc_id="doc_id", ids=ids).mapInArrow(run, "doc_id long, ids binary, decoded string")


@query("op2_bpe_roundtrip")
def op2_bpe_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """Every whole text encoded and decoded; digests of ids and text."""
    done = decode(encode(table(spark, directory, "documents")))
    return done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
