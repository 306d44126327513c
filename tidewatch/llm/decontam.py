"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of the training tokens: each task cuts its
documents into shards of about SHARD_WORDS words, and a row of the stored table holds
one shard's terms (hashes of words) and, term by term, the sorted positions at which
they stand. Positions count through the shard, with a gap between documents, so one
number says document and place. Shards need no shuffle, and every document is in one.

``phrase_matches`` and ``near_matches`` read the index shard by shard. A phrase's terms
are taken from the rarest in the shard to the commonest; their position lists, each
shifted by the term's offset in the phrase, are intersected until none is left. The test
items are the stated query set: they are dealt into blocks of at most BLOCK_CHARS
characters and meet all shards block by block.

Defined results: a null text has no words, is never hit and hits nothing; a null item
id marks words but is not listed; repeated documents are separate rows; repeated
items count once; extra columns are ignored; an empty side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.text import ALNUM, few, hashed_words, pick, utf8
from tidewatch.plans.registry import query
from tidewatch.session import materialise, table

#: Words of a window, of a shard (about), and characters of a block of items.
WINDOW, SHARD_WORDS, BLOCK_CHARS = 10, 1 << 20, 1 << 26
#: Free positions between documents: more than any phrase or span searched for.
GAP = 256
#: The filter of terms worth indexing has 2 ** FILTER_BITS bits.
FILTER_BITS = 24

INDEX_SCHEMA = (
    "shard long, doc_ids array<long>, n_words array<long>, firsts binary, terms binary, lists binary, positions binary"
)


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    """Hashed words of a few texts."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    out = []
    for first, end, upto, hashes in hashed_words(data, offsets, ALNUM):
        out += [hashes[upto[i]:upto[i + 1]] for i in range(end - first)]
    return out


def item_blocks(items: DataFrame) -> list[list]:
    """The items, block by block: (item_id as text, text)."""
    rows = pick(items, item_id="item_id", text="text").select(F.col("item_id").cast("string"), "text")
    rows = rows.filter("text is not null").distinct()
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = size // BLOCK_CHARS + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for i in range(blocks):
        yield [(r["item_id"], r["text"]) for r in rows.filter(F.col("block") == i).collect()]


def term_filter(items: DataFrame) -> np.ndarray:
    """Packed bits of a fixed size, set for every term of the items (and some others)."""
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for block in item_blocks(items):
        for words in item_words([t for _, t in block]):
            bits[words >> np.uint64(64 - FILTER_BITS)] = True
    return np.packbits(bits)


def _set(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether the packed bits of ``term_filter`` are set for the words."""
    at = words >> np.uint64(64 - FILTER_BITS)
    return np.uint64(128) >> (at & np.uint64(7)) & bits[at >> np.uint64(3)] > 0


def build_index(docs: DataFrame, wanted: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored positional index of all documents.

    ``wanted`` (of ``term_filter``) leaves out postings of terms that no item holds; the
    positions of the others stay what they are. None indexes every term.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(None if wanted is None else wanted.tobytes())
    schema = pa.schema([
        ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("firsts", pa.binary()),
        ("terms", pa.binary()), ("lists", pa.binary()), ("positions", pa.binary()),
    ])

    def shard(number: int, ids: list, counts: list, firsts: list, hashes: list, held: list) -> pa.RecordBatch:
        firsts, words, places = np.concatenate(firsts), np.concatenate(hashes), np.concatenate(held)
        order = np.argsort(words, kind="stable")
        words, places = words[order], places[order]
        at = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
        blobs = [firsts.astype("<i8"), words[at].astype("<u8"), np.append(at, len(words)).astype("<i8"), places.astype("<i4" if not len(places) or places.max() < 1 << 31 else "<i8")]
        row = [number, ids, counts, *[b.tobytes() for b in blobs]]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared.value is None else np.frombuffer(shared.value, dtype=np.uint8)
        number = TaskContext.get().partitionId() << 32
        ids, counts, firsts, hashes, held, size, end_place = [], [], [], [], [], 0, 0
        for part in few(parts):
            names = part.column(0).to_pylist()
            for first, end, upto, words in hashed_words(*utf8(part.column(1)), ALNUM):
                own = np.diff(upto)
                ends = end_place + np.cumsum(own + GAP)
                starts = ends - own - GAP
                places = np.arange(len(words)) + np.repeat(starts - upto[:-1], own)
                size += len(words)
                if bits is not None:
                    keep = _set(bits, words)
                    words, places = words[keep], places[keep]
                ids += names[first:end]
                counts += own.tolist()
                firsts.append(starts)
                hashes.append(words)
                held.append(places)
                end_place = ends[-1]
                if size >= SHARD_WORDS:
                    yield shard(number, ids, counts, firsts, hashes, held)
                    number += 1
                    ids, counts, firsts, hashes, held, size, end_place = [], [], [], [], [], 0, 0
        if ids:
            yield shard(number, ids, counts, firsts, hashes, held)

    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return materialise(rows.mapInArrow(run, INDEX_SCHEMA), "positions")


class Shard:
    """One row of the index."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["shard"], row["doc_ids"]
        self.firsts = np.frombuffer(row["firsts"], dtype="<i8")
        self.terms = np.frombuffer(row["terms"], dtype="<u8")
        self.lists = np.frombuffer(row["lists"], dtype="<i8")
        total = int(self.lists[-1]) if len(self.lists) else 0
        width = len(row["positions"]) // total if total else 4
        self.positions = np.frombuffer(row["positions"], dtype=f"<i{width}")

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, its term's number and list length (0: not in the shard)."""
        if not len(self.terms):
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        sizes = np.where(self.terms[at] == words, self.lists[at + 1] - self.lists[at], 0)
        return at, sizes

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.lists[term]:self.lists[term + 1]]

    def phrase(self, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Positions at which the terms stand one after the other."""
        found = None
        for i in np.argsort(sizes, kind="stable"):
            own = self.postings(terms[i])
            if found is None:
                found = own.astype(np.int64) - i
            else:
                at = np.minimum(np.searchsorted(own, found + i), len(own) - 1)
                found = found[own[at] == found + i]
            if not len(found):
                break
        return found

    def near(self, terms: np.ndarray, sizes: np.ndarray, span: int) -> list[tuple[int, int]]:
        """Smallest spans (first, end) of at most ``span`` words around each rarest term that hold every term."""
        order = np.argsort(sizes, kind="stable")
        out = []
        for centre in self.postings(terms[order[0]]).tolist():
            events = []
            for i in order:
                own = self.postings(terms[i])
                a, b = np.searchsorted(own, [centre - span + 1, centre + span])
                events += [(int(p), int(terms[i])) for p in own[a:b]]
            best, need, have, low = None, len(set(terms.tolist())), {}, 0
            events = sorted(set(events))
            for place, term in events:
                have[term] = have.get(term, 0) + 1
                while len(have) == need:
                    first, other = events[low]
                    if place - first < span and first <= centre <= place and (best is None or place - first < best[1] - best[0] - 1):
                        best = first, place + 1
                    have[other] -= 1
                    if not have[other]:
                        del have[other]
                    low += 1
            if best:
                out.append(best)
        return sorted(set(out))

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, side="right") - 1


def windows(words: np.ndarray, size: int) -> list[np.ndarray]:
    """Runs of ``size`` words; all of them when there are fewer; none of nothing."""
    if not len(words):
        return []
    return [words[i:i + size] for i in range(max(len(words) - size + 1, 1))]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, as sorted disjoint ones."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:] - 1, len(starts) - 1)]


def _search(index: DataFrame, items: DataFrame, match) -> DataFrame:
    """Rows (shard, place, doc_id, item_id, spans) of ``match(shard, words)`` over all blocks."""
    schema = pa.schema([
        ("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.string()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
    ])

    def block_rows(block: list) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast(block)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items_ = shared.value
            queries = item_words([t for _, t in items_])
            # a shard at a time: a batch may hold many
            for part in few(parts, 1):
                for row in part.to_pylist():
                    shard, out = Shard(row), []
                    for (item, _), words in zip(items_, queries, strict=True):
                        starts, ends = match(shard, words)
                        if not len(starts):
                            continue
                        low, high = merged(np.asarray(starts, np.int64), np.asarray(ends, np.int64))
                        docs = shard.documents(low)
                        low, high = low - shard.firsts[docs], high - shard.firsts[docs]
                        cuts = np.flatnonzero(np.diff(docs)) + 1
                        for a, b, place in zip([0, *cuts], [*cuts, len(docs)], docs[np.concatenate([[0], cuts]).astype(int)].tolist(), strict=True):
                            spans = [{"first": x, "end": y} for x, y in zip(low[a:b].tolist(), high[a:b].tolist(), strict=True)]
                            out.append((shard.number, place, shard.doc_ids[place], item, spans))
                    if out:
                        columns = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return index.mapInArrow(run, "shard long, place long, doc_id long, item_id string, spans array<struct<first:long,end:long>>")

    found = None
    for block in item_blocks(items):
        rows = block_rows(block)
        found = rows if found is None else found.unionByName(rows)
    return found


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document and item, the word spans covered by the item's windows, exactly."""
    if window >= GAP:
        raise ValueError(f"a window has fewer than {GAP} words")

    def match(shard: Shard, words: np.ndarray):
        if not len(words):
            return [], []
        size = min(window, len(words))
        terms, sizes = shard.find(words)
        starts = []
        # a window with a missing term is out; the others are intersected from the rarest term
        missing = np.concatenate([[0], np.cumsum(sizes == 0)])
        for i in np.flatnonzero(missing[size:] == missing[:len(words) - size + 1]).tolist():
            starts.append(shard.phrase(terms[i:i + size], sizes[i:i + size]))
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return starts, starts + size

    return _search(index, items, match)


def near_matches(index: DataFrame, items: DataFrame, span: int = 30) -> DataFrame:
    """Per document and item, spans of at most ``span`` words that hold every word of the item."""
    if span >= GAP:
        raise ValueError(f"a span has fewer than {GAP} words")

    def match(shard: Shard, words: np.ndarray):
        terms, sizes = shard.find(np.unique(words))
        if not len(words) or (sizes == 0).any():
            return [], []
        found = shard.near(terms, sizes, span)
        return [a for a, _ in found], [b for _, b in found]

    return _search(index, items, match)


def _covered(spans: Column) -> Column:
    """Words in the union of spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach"))

    def add(state: Column, span: Column) -> Column:
        low = F.greatest(span["first"], state["reach"])
        return F.struct(
            (state["n"] + F.greatest(span["end"] - low, F.lit(0))).alias("n"),
            F.greatest(state["reach"], span["end"]).alias("reach"),
        )

    return F.aggregate(F.array_sort(spans), start, add, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document: doc_id, n_words, n_hit, item_ids (sorted as text), spans."""
    index = build_index(docs, term_filter(items))
    matches = phrase_matches(index, items, window)
    hits = matches.groupBy("shard", "place").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    every = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "doc")).select(
        "shard", F.col("place").cast("bigint").alias("place"), F.col("doc.doc_ids").alias("doc_id"), F.col("doc.n_words").alias("n_words")
    )
    joined = every.join(hits, ["shard", "place"], "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p, w FROM b WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM i
), sizes AS (SELECT DISTINCT n FROM iw
), dp AS (
  SELECT k, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, sizes WHERE len(w) >= n
), dw AS (SELECT k, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM dp
), m AS (SELECT dw.k, dw.n, dw.p, iw.item_id FROM dw JOIN iw USING (n, s)
), hit AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS x FROM m) GROUP BY k
), it AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, item_id FROM m) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN it USING (k)
"""


@query("op3_decontamination", SQL)
def op3_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """Words of every document that a benchmark window covers, and the items."""
    done = contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
