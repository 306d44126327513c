"""Language-model scores from an Elias-Fano n-gram trie (words and word pairs).

The first level holds the training words with their counts, the second the pairs of
neighbouring training words below their first word, the context. A level is stored in shards:
monotone pointers from contexts to their successors and the successors themselves as
Elias-Fano sequences (successors made monotone over contexts by adding what came before), and
smoothed log10 probabilities quantised to steps of 1 / STEPS. Opening a level expands its
sequences to 64-bit arrays, on which successors are searched and tested against the context's
range. The stored first level is not queried: words are scored by their exact counts.

p(w | v) = (c(v, w) - D) / c(v) + D * successors(v) / c(v) * p(w), D = DISCOUNT, with
p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)); contexts never seen in training give p(w).

Nothing of the size of the corpus meets in one place. Documents are packed into blocks of about
BLOCK_TOKENS tokens. A block asks each shard for its distinct words (then pairs) in one
message, which also brings the block's training counts; a shard adds up the messages of all
blocks, writes its part of the level, and answers every block. Shards of words are ranges of
hashes, shards of pairs ranges of contexts that are cut by how often blocks use them. A context
that may bring more than SHARD_TOKENS pairs is split into ranges of its words: each part counts
its own pairs, and the parts' totals and numbers of successors are added up before probabilities
are made from the counts. So no shard hears of more than 2 * SHARD_TOKENS pairs, however
frequent a word is.

Defined results: a null text counts as empty and scores its end alone; repeated rows train and
score repeatedly; a null doc_id is in fold 0; extra columns are ignored; an empty table gives an
empty table. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.text import SPACED, fold, hashed_words, pick, utf8
from tidewatch.plans.registry import query
from tidewatch.session import materialise, table

DISCOUNT, STEPS = 0.75, 64
BLOCK_TOKENS, SHARD_TOKENS = 1 << 21, 1 << 21
#: The hash that stands for the end of a text, and the mark of something not found.
END, MISSING = np.uint64(0), 0xFFFF


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of small numbers: compressed byte by byte of their places."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def elias_fano(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of unsigned numbers, in about 2 + log2(range / n) bits each."""
    n = len(values)
    if not n:
        return np.zeros(2, dtype="<u8").tobytes()
    values = values.astype(np.uint64)
    low_bits = max(int(values[-1] // np.uint64(n)).bit_length() - 1, 0)
    high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bitmap = np.zeros(int(high[-1]) + 1, dtype=bool)
    bitmap[high] = True
    parts = [np.array([n, low_bits, len(bitmap)], dtype="<u8").tobytes(), np.packbits(bitmap).tobytes()]
    if low_bits:
        wide = (low_bits + 7) // 8 * 8
        step = 1 << 16  # a multiple of 8 rows, so that parts end on whole bytes
        for i in range(0, n, step):
            rows = values[i:i + step].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - wide // 8:]
            parts.append(np.packbits(np.unpackbits(rows, axis=1)[:, wide - low_bits:]).tobytes())
    return b"".join(parts)


def elias_fano_values(blob: bytes) -> np.ndarray:
    """The whole sequence."""
    head = np.frombuffer(blob, dtype="<u8", count=2)
    if not head[0]:
        return np.zeros(0, dtype=np.uint64)
    n, low_bits, size = (int(x) for x in np.frombuffer(blob, dtype="<u8", count=3))
    raw = np.frombuffer(blob, dtype=np.uint8, offset=24)
    cut = (size + 7) // 8
    high = np.flatnonzero(np.unpackbits(raw[:cut], count=size)) - np.arange(n)
    out = high.astype(np.uint64) << np.uint64(low_bits)
    if low_bits:
        wide = (low_bits + 7) // 8 * 8
        step, at = 1 << 16, cut
        for i in range(0, n, step):
            rows = min(step, n - i)
            taken = (rows * low_bits + 7) // 8
            bits = np.zeros((rows, wide), dtype=np.uint8)
            bits[:, wide - low_bits:] = np.unpackbits(raw[at:at + taken], count=rows * low_bits).reshape(rows, low_bits)
            whole = np.zeros((rows, 8), dtype=np.uint8)
            whole[:, 8 - wide // 8:] = np.packbits(bits, axis=1)
            out[i:i + rows] |= whole.view(">u8").ravel().astype(np.uint64)
            at += taken
    return out


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-logs * STEPS), MISSING - 1).astype("<u2")


class Level:
    """A shard of the second level: contexts, their pointers, successors, probabilities."""

    def __init__(self, blobs: list[bytes]):
        self.contexts = elias_fano_values(blobs[0])
        self.pointers = elias_fano_values(blobs[1]).astype(np.int64)
        self.successors = elias_fano_values(blobs[2])
        self.probabilities = np.frombuffer(blobs[3], dtype="<u2")
        self.weights = np.frombuffer(blobs[4], dtype="<u2")

    @staticmethod
    def pack(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, whole: tuple[int, int] | None = None) -> list[bytes]:
        """From the pairs in order of context and word, with their counts.

        ``whole``: total and number of successors of the one context these are a part of.
        """
        names, first, sizes = np.unique(contexts, return_index=True, return_counts=True)
        totals = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
        successors = sizes
        if whole:
            totals, successors = (np.full(len(first), x) for x in whole)
        own = np.repeat(totals, sizes)
        last = words[first + sizes - 1] + np.uint64(1) if len(first) else words
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)])[:-1]
        monotone = words + np.repeat(before, sizes)
        return [
            elias_fano(names), elias_fano(np.append(first, len(words)).astype(np.uint64)), elias_fano(monotone),
            quantise(np.log10((counts - DISCOUNT) / np.maximum(own, 1))).tobytes(),
            quantise(np.log10(DISCOUNT * successors / np.maximum(totals, 1))).tobytes(),
        ]

    def ranges(self, contexts: np.ndarray) -> np.ndarray:
        """Number of each context, -1 where it is not in the level."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Quantised probabilities of pairs by successor search in the context's range."""
        out = np.full(len(words), MISSING, dtype="<u2")
        number = self.ranges(contexts)
        known = np.flatnonzero(number >= 0)
        if not len(known):
            return out
        i = number[known]
        low, high = self.pointers[i], self.pointers[i + 1]
        # what was added to a context's words is the end of the range before it
        before = np.where(low > 0, self.successors[np.maximum(low - 1, 0)] + np.uint64(1), np.uint64(0))
        wanted = words[known] + before
        at = np.searchsorted(self.successors, wanted)
        there = (at < high) & (at >= low)
        there &= self.successors[np.minimum(at, len(self.successors) - 1)] == wanted
        out[known[there]] = self.probabilities[at[there]]
        return out


BLOCKS = "block long, doc_ids array<long>, sizes binary, train binary, terms binary, usage binary, counts binary, uses binary, n_terms long"


def blocks(df: DataFrame) -> DataFrame:
    """Documents (doc_id, text, train) as stored blocks of token numbers."""
    schema = pa.schema([
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("sizes", "train", "terms", "usage", "counts", "uses")],
        ("n_terms", pa.int64()),
    ])

    def packed(number: int, ids: list, sizes: list, train: list, tokens: list) -> pa.RecordBatch:
        sizes_, learns = np.concatenate(sizes), np.array(train, dtype=bool)
        terms, uses, usage = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        counts = np.bincount(uses[np.repeat(learns, sizes_)], minlength=len(terms))
        rank = np.empty(len(terms), dtype=np.int64)
        rank[np.argsort(-usage, kind="stable")] = np.arange(len(terms))
        row = [
            number, ids, squeeze(sizes_), learns.tobytes(), terms.astype("<u8").tobytes(), squeeze(usage), squeeze(counts), squeeze(rank[uses]), len(terms),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for part in parts:
            ids, learns = part.column(0).to_pylist(), part.column(2).to_pylist()
            for first, end, upto, words in hashed_words(*utf8(part.column(1)), SPACED):
                tokens = np.full(len(words) + end - first, END, dtype=np.uint64)
                inner = np.ones(len(tokens), dtype=bool)
                inner[upto[1:] + np.arange(end - first)] = False
                tokens[inner] = words
                for target, new in zip(held, (ids[first:end], [np.diff(upto) + 1], learns[first:end], [tokens]), strict=True):
                    target += new
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield packed(number, *held)
                    number += 1
                    held, size = ([], [], [], []), 0
        if size:
            yield packed(number, *held)

    return materialise(df.mapInArrow(run, BLOCKS), "blocks")


#: ``usage``: of words only, the most pairs that the block can ask for with the word as context.
MESSAGES = "shard long, block long, keys binary, counts binary, usage binary"
_MESSAGES = pa.schema([("shard", pa.int64()), ("block", pa.int64()), *[(n, pa.binary()) for n in ("keys", "counts", "usage")]])
#: Answers and levels: answers have a block; a level has block null and its blobs, one of words
#: also the contexts at which shards of pairs begin and into how many each of these is split.
ANSWERS = "level int, shard long, block long, found binary, more binary, blobs array<binary>, total long, distinct long, size long, begin array<long>, parts array<long>"
_ANSWERS = pa.schema([
    ("level", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("found", pa.binary()), ("more", pa.binary()), ("blobs", pa.list_(pa.binary())),
    ("total", pa.int64()), ("distinct", pa.int64()), ("size", pa.int64()), ("begin", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())),
])
#: What an answer leaves empty.
_NO_LEVEL = (None,) * 6


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ask_words(bits: int):
    """Messages of a block about its words, one per shard of the hash's first bits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for part in parts:
            for row in part.to_pylist():
                terms, counts = np.frombuffer(row["terms"], "<u8"), expand(row["counts"])
                usage = np.minimum(expand(row["usage"]), len(terms))
                cuts = [0, *np.searchsorted(terms, edges).tolist(), len(terms)]
                rows = [
                    (shard, row["block"], terms[a:b].tobytes(), squeeze(counts[a:b]), squeeze(usage[a:b]))
                    for shard, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a
                ]
                yield from _table(_MESSAGES, rows).to_batches()

    return run


def _cuts(weights: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Contexts at which ranges of at most twice ``limit`` begin, and the parts each is split into.

    A context above ``limit`` is a range of its own, in parts of at most ``limit``.
    """
    heavy = weights > limit
    group = np.cumsum(np.where(heavy, 0, weights)) // limit
    begin = heavy.copy()
    begin[0] = True
    begin[1:] |= heavy[:-1] | (group[1:] > group[:-1])
    at = np.flatnonzero(begin)
    return at.tolist(), np.where(heavy, -(-weights // limit), 1)[at].tolist()


def _answer_words(limit: int):
    """A shard of the first level: numbers and counts of the words of every block."""

    def run(messages: pa.Table) -> pa.Table:
        rows = messages.sort_by("block").to_pylist()
        keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
        words, numbers = np.unique(np.concatenate(keys), return_inverse=True)
        counts, usage = (
            np.bincount(numbers, np.concatenate([expand(r[c]) for r in rows]), minlength=len(words)).astype(np.int64) for c in ("counts", "usage")
        )
        shard, out, at = rows[0]["shard"], [], 0
        for r, own in zip(rows, keys, strict=True):
            mine = numbers[at:at + len(own)]
            at += len(own)
            out.append((1, shard, r["block"], mine.astype("<u4").tobytes(), squeeze(counts[mine]), *_NO_LEVEL))
        learned = np.flatnonzero(counts)
        blobs = [elias_fano(words[learned]), squeeze(counts[learned])]
        out.append((1, shard, None, None, None, blobs, int(counts.sum()), len(learned), len(words), *_cuts(usage, limit)))
        return _table(_ANSWERS, out)

    return run


class Block:
    """A block with the numbers and counts of its words."""

    def __init__(self, row: dict, answers: list[dict], offsets: np.ndarray):
        self.doc_ids, self.sizes = row["doc_ids"], expand(row["sizes"]).astype(np.int64)
        self.train = np.frombuffer(row["train"], dtype=bool)
        by_rank = np.argsort(-expand(row["usage"]).astype(np.int64), kind="stable")
        self.uses = by_rank[expand(row["uses"])]
        answers = sorted(answers, key=lambda a: a["shard"])
        self.numbers = np.concatenate([np.frombuffer(a["found"], "<u4").astype(np.uint64) + offsets[a["shard"]] for a in answers])
        self.counts = np.concatenate([expand(a["more"]) for a in answers]).astype(np.int64)
        self.width = offsets[-1] + np.uint64(1)  # one more than the words: the start of a text

    def pairs(self) -> np.ndarray:
        """Context and word of every token as one number."""
        words = self.numbers[self.uses]
        contexts = np.empty_like(words)
        contexts[1:] = words[:-1]
        contexts[np.cumsum(self.sizes) - self.sizes] = self.width - np.uint64(1)
        return contexts * self.width + words


def _shard_edges(cuts: list[tuple[int, int]], width: int) -> tuple[np.ndarray, dict[int, int]]:
    """(first pair of each shard, contexts of the shards that are parts), from (context, parts) in order."""
    edges, part_of = [], {}
    for context, parts in cuts:
        if parts > 1:
            part_of |= {len(edges) + i: context for i in range(parts)}
        edges += [context * width + width * i // parts for i in range(parts)]
    return np.array(edges, dtype=np.uint64), part_of


def _ask_pairs(offsets: np.ndarray, edges: np.ndarray):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        own = Block(row, answers.to_pylist(), offsets)
        pairs, uses = np.unique(own.pairs(), return_inverse=True)
        counts = np.bincount(uses[np.repeat(own.train, own.sizes)], minlength=len(pairs))
        cuts = [*np.searchsorted(pairs, edges).tolist(), len(pairs)]
        rows = [
            (shard, row["block"], elias_fano(pairs[a:b] - edges[shard]), squeeze(counts[a:b]), None)
            for shard, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a
        ]
        return _table(_MESSAGES, rows)

    return run


def _answer_pairs(width: int, edges: np.ndarray, part_of: dict[int, int]):
    def run(messages: pa.Table) -> pa.Table:
        rows = messages.sort_by("block").to_pylist()
        shard, out, at = rows[0]["shard"], [], 0
        keys = [elias_fano_values(r["keys"]) + edges[shard] for r in rows]
        pairs, numbers = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(numbers, np.concatenate([expand(r["counts"]) for r in rows]), minlength=len(pairs)).astype(np.int64)
        learned = counts > 0
        wide = np.uint64(width)
        kept = pairs[learned]
        if shard in part_of:  # counts; other parts are needed for probabilities
            for r, own in zip(rows, keys, strict=True):
                mine = counts[numbers[at:at + len(own)]]
                at += len(own)
                out.append((2, shard, r["block"], *halves(mine), *_NO_LEVEL))
            blobs = [elias_fano(kept % wide), *halves(counts[learned])]
        else:
            blobs = Level.pack(kept // wide, kept % wide, counts[learned])
            level = Level(blobs)
            for r, own in zip(rows, keys, strict=True):
                contexts = own // wide
                found = level.find(contexts, own % wide)
                known = level.ranges(np.unique(contexts))
                weights = np.where(known >= 0, level.weights[np.maximum(known, 0)] if len(level.weights) else MISSING, MISSING)
                out.append((2, shard, r["block"], squeeze(found), squeeze(weights), *_NO_LEVEL))
        out.append((2, shard, None, None, None, blobs, int(counts.sum()), int(learned.sum()), len(pairs), None, None))
        return _table(_ANSWERS, out)

    return run


def halves(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts of up to 64 bits."""
    return squeeze(counts & 0xFFFFFFFF), squeeze(counts >> 32)


def whole_counts(low: bytes, high: bytes) -> np.ndarray:
    return expand(low).astype(np.int64) | expand(high).astype(np.int64) << 32


def _pack_parts(part_of: dict[int, int], wholes: dict[int, tuple[int, int]]):
    """Levels of parts, from their words and counts; other levels stay as they are."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for row in part.to_pylist():
                shard, blobs = row["shard"], row["blobs"]
                if shard in part_of:
                    words = elias_fano_values(blobs[0])
                    contexts = np.full(len(words), part_of[shard], dtype=np.uint64)
                    blobs = Level.pack(contexts, words, whole_counts(*blobs[1:]), wholes[part_of[shard]])
                rows.append((row["level"], shard, blobs))
            yield from _table(_TRIE, rows).to_batches()

    return run


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


TRIE = "level int, shard long, blobs array<binary>"
_TRIE = pa.schema([("level", pa.int32()), ("shard", pa.int64()), ("blobs", pa.list_(pa.binary()))])


def _told(answer: dict, part_of: dict[int, int], wholes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Quantised probabilities of the pairs and weights of the contexts in a shard's answer."""
    if answer["shard"] not in part_of:
        return expand(answer["found"]), expand(answer["more"])
    counts = whole_counts(answer["found"], answer["more"])
    total, successors = wholes[part_of[answer["shard"]]]
    found = np.full(len(counts), MISSING)
    found[counts > 0] = quantise(np.log10((counts[counts > 0] - DISCOUNT) / max(total, 1)))
    return found, quantise(np.log10(np.array([DISCOUNT * successors / total]))) if total else np.array([MISSING])


def _score(offsets: np.ndarray, total: int, distinct: int, edges: np.ndarray, part_of: dict[int, int], wholes: dict[int, tuple[int, int]]):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row, told = block.to_pylist()[0], answers.to_pylist()
        own = Block(row, [a for a in told if a["level"] == 1], offsets)
        pair_answers = sorted((a for a in told if a["level"] == 2), key=lambda a: a["shard"])
        pairs, uses = np.unique(own.pairs(), return_inverse=True)
        found, weights = (np.concatenate(x) for x in zip(*[_told(a, part_of, wholes) for a in pair_answers], strict=True))
        # a weight was told for each context of a shard
        contexts, shards = pairs // own.width, np.searchsorted(edges, pairs, side="right")
        context = np.concatenate([[0], np.cumsum((contexts[1:] != contexts[:-1]) | (shards[1:] != shards[:-1]))])
        single = (own.counts + 0.5) / (total + 0.5 * (distinct + 1))
        weight = np.where(weights == MISSING, 1.0, 10.0 ** (weights / -float(STEPS)))
        direct = np.where(found == MISSING, 0.0, 10.0 ** (found / -float(STEPS)))
        logs = np.log10(direct[uses] + weight[context][uses] * single[own.uses])
        starts = np.cumsum(own.sizes) - own.sizes
        return _table(_SCORES, list(zip(
            own.doc_ids, own.sizes.tolist(), np.add.reduceat((own.counts > 0)[own.uses].astype(np.int64), starts).tolist(),
            np.add.reduceat(np.log10(single)[own.uses], starts).tolist(), np.add.reduceat(logs, starts).tolist(), strict=True,
        )))

    return run


def train_and_score(df: DataFrame, train: str = "train", doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(scores, trie): every row's scores under the model learned from rows where ``train`` holds.

    ``scores``: doc_id, n_tokens, n_known, train_tokens, base_score, score. ``trie``: level,
    shard, blobs (first level: words and counts; second: the parts of ``Level``).
    """
    spark = df.sparkSession
    rows = pick(df, doc_id=doc_id, text=text, train=train)
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce("train", F.lit(False)).alias("train"))
    packed = blocks(rows)
    asked, starts = packed.agg(F.sum("n_terms"), F.sum(F.least(F.size("doc_ids"), F.col("n_terms")))).first()
    if not asked:
        nothing = spark.createDataFrame([], SCORES).withColumn("train_tokens", F.lit(0).cast("bigint"))
        return nothing, spark.createDataFrame([], TRIE)
    # words asked for are a part of the tokens
    bits = max(3, int(-(-asked * 4 // SHARD_TOKENS)).bit_length())
    messages = packed.select("block", "terms", "counts", "usage").mapInArrow(_ask_words(bits), MESSAGES)
    first = materialise(messages.groupBy("shard").applyInArrow(_answer_words(SHARD_TOKENS), ANSWERS), "words")
    stats = first.filter("block is null").select("shard", "total", "distinct", "size", "begin", "parts").collect()  # a row per shard
    sizes = np.zeros(1 << bits, dtype=np.uint64)
    for r in stats:
        sizes[r["shard"]] = r["size"]
    offsets = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes, dtype=np.uint64)])
    total, distinct = sum(r["total"] for r in stats), sum(r["distinct"] for r in stats)
    width = int(offsets[-1]) + 1
    cuts = sorted((int(offsets[r["shard"]]) + at, n) for r in stats for at, n in zip(r["begin"], r["parts"], strict=True))
    edges, part_of = _shard_edges([*cuts, (width - 1, max(-(-starts // SHARD_TOKENS), 1))], width)

    answers = first.filter("block is not null").select("level", "shard", "block", "found", "more")
    by_block = packed.groupBy("block")
    pairs = by_block.cogroup(answers.groupBy("block")).applyInArrow(_ask_pairs(offsets, edges), MESSAGES)
    second = materialise(pairs.groupBy("shard").applyInArrow(_answer_pairs(width, edges, part_of), ANSWERS), "pairs")
    wholes = {context: (0, 0) for context in part_of.values()}
    if part_of:
        for r in second.filter("block is null").select("shard", "total", "distinct").collect():  # a row per shard
            if r["shard"] in part_of:
                before = wholes[part_of[r["shard"]]]
                wholes[part_of[r["shard"]]] = before[0] + r["total"], before[1] + r["distinct"]
    answers = answers.unionByName(second.filter("block is not null").select("level", "shard", "block", "found", "more"))
    scores = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(offsets, total, distinct, edges, part_of, wholes), SCORES)
    levels = [x.filter("block is null").select("level", "shard", "blobs") for x in (first, second)]
    trie = levels[0].unionByName(levels[1].mapInArrow(_pack_parts(part_of, wholes), TRIE))
    return scores.withColumn("train_tokens", F.lit(total).cast("bigint")), trie


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, directory: str) -> DataFrame:
    """Scores of every whole text; one document in five, by the checksum of its id, is held out."""
    docs = pick(table(spark, directory, "documents"), doc_id="doc_id", text="text")
    scores, _ = train_and_score(docs.withColumn("train", fold(F.col("doc_id"), 5) != 1))
    return scores.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
