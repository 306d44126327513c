"""N-gram Jaccard join by parity sketches, and the classes of linked documents.

A document is the set of its distinct shingles of SHINGLE words. Two documents link when
``100 * intersection >= percent * union``, so sets of a and b shingles differ in at most
``D = (100 - percent) * (a + b) / (100 + percent)`` of them. Each shingle toggles one bit
of a sketch: the Hamming distance of two sketches is at most the size of the symmetric
difference. Within a size band (sizes up to twice the smallest, and a band across each
border between them) a sketch is cut into P > D blocks, so two linked sets have blocks
that are equal in all bits. Documents are joined on equal blocks.

Empty blocks say little. P is D + 1 + spare, and a set with no more than ``spare`` empty
blocks leaves them out; a set with more is also sketched with the next seed, and with the
last seed it keeps them. Two linked sets have over ``spare`` equal blocks: if one of
those is not empty they meet there, else both go on to the next seed. No link is lost.
``spare`` follows percent: it is above the number of empty blocks to be expected for the
smallest set of the band, so that few sets need a second seed and hardly any keeps empty blocks.
(At percents under about 65 no number is: sets there keep theirs, which costs time, not links.)

Sets are named by a 64-bit hash of their shingles, so copies meet once however many there
are. A set is first compared with the first sets of most of its blocks, and what links is
contracted. Then, ROUNDS times, one set of each class in a block is compared with one of the largest class there.
What still is in different classes is joined in full, and of two classes a few pairs are tried before the others. Candidates pass a sketch of the
whole sets, of four bits a shingle, and are verified on the sets, which are read again for those that have
candidates only. A step's tables and shuffle files are removed once the next is written. Classes do not depend on which of several equal copies is taken.

Defined results: a null text, and one without words, has an empty set, links with nothing
and is a class of its own; a null doc_id is ignored as a class id where others exist;
repeated rows are copies; extra columns are ignored; an empty table gives an empty table.
Equality of shingles and sets rests on 64-bit hashes: among n distinct sets the chance of
any clash is about n * n / 2**65.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.text import SPACED, hashed_words, mix, pick, release, shingle_hashes, utf8
from tidewatch.plans.registry import query
from tidewatch.session import discard, step, table

#: Words of a shingle and least percentage of the union for the registered query.
SHINGLE, PERCENT = 4, 85
#: Seeds of the block sketches, least spare blocks for empty ones (a share of the others).
SEEDS, SPARE = 4, 0.07
#: Bits that a shingle can toggle in a block (so many that blocks of a single shingle hardly ever
#: meet by chance, whatever the number of sets); least and most words of the sketch of a whole
#: set, which has four bits a shingle (a set beyond the most still gets a valid bound), and most words
#: of the one that goes with each block of a set.
BLOCK_BITS, SKETCH_WORDS, MOST_WORDS, CARRIED_WORDS = 1 << 32, 8, 4096, 32
#: Rows of a batch looked at in one step.
ROWS = 512
#: Size of the bit field that picks the texts to read again, rounds of contraction, pairs that a
#: set (or two classes) is tried with at a time, and earlier blocks of a set that a pair is looked up in before it is told again.
FILTER_BITS, ROUNDS, LEADS, EARLIER = 22, 2, 4, 8


def most_apart(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of a and b shingles."""
    return (100 - percent) * (a + b) // (100 + percent)


@functools.cache
def spare_blocks(apart: int, least: int) -> int:
    """Spare blocks of a band whose sets, of ``least`` shingles or more, differ in ``apart``.

    The fewest that are a standard deviation above the empty blocks of such a set.
    """
    fewest = max(1, int(SPARE * (apart + 1)))
    spare = np.arange(fewest, 8 * apart + fewest + 1)
    blocks = apart + 1 + spare
    share = np.exp(-least / blocks)
    enough = blocks * share + np.sqrt(blocks * share * (1 - (1 + least / blocks) * share)) <= spare
    return int(spare[np.argmax(enough)])


@functools.cache
def bands(size: int, percent: int) -> list[tuple[int, int, int]]:
    """Bands of a set: (number, blocks, spare blocks); none when only equal sets can link."""
    k = size.bit_length() - 1
    out = [(2 * k, 2 * (1 << k + 1) - 2, 1 << k)]  # the set's own band: sizes from 2**k up to below 2**(k+1)
    for border, number in ((1 << k, 2 * k - 1), (1 << k + 1, 2 * k + 1)):
        low = border - 1
        if 100 * size >= percent * border and percent * size <= 100 * low:
            out.append((number, low + 100 * low // percent, -(-percent * border // 100)))
    found = []
    for number, both, least in out:
        apart = most_apart(both, 0, percent)
        if apart:
            spare = spare_blocks(apart, least)
            found.append((number, apart + 1 + spare, spare))
    return found


def block_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the blocks under which a set (sorted hashes) meets others."""
    out = []
    for number, blocks, spare in bands(len(shingles), percent):
        for seed in range(SEEDS):
            mixed = shingles if seed == 0 else np.sort(mix(shingles + np.uint64(seed)))
            block = (mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
            bits = mix((mixed & np.uint64(BLOCK_BITS - 1)) + np.uint64(1))
            edges = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
            full = np.flatnonzero(edges[1:] > edges[:-1])
            content = np.zeros(blocks, dtype=np.uint64)
            content[full] = np.bitwise_xor.reduceat(bits, edges[full])
            empty = blocks - len(full)
            last = seed == SEEDS - 1
            kept = np.arange(blocks) if last and empty > spare else full
            name = mix(np.uint64([number * SEEDS + seed + 1]))[0]
            out.append(mix(content[kept] + mix(kept.astype(np.uint64) ^ name)))
            if empty <= spare:
                break
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The whole set's parity sketch, as words; their number is a power of two that follows the set."""
    words = min(max(SKETCH_WORDS, 1 << max(len(shingles) // 16 - 1, 0).bit_length()), MOST_WORDS)
    at = (shingles >> np.uint64(20)) % np.uint64(64 * words)
    odd = (np.bincount(at.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def folded(sketch: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """The sketch the same set has with fewer words."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def name(shingles: np.ndarray) -> int:
    """Hash of a set."""
    total = np.add.reduce(mix(shingles), keepdims=True) + np.bitwise_xor.reduce(shingles, keepdims=True)
    return int(mix(total + np.uint64(len(shingles))).view(np.int64)[0])


def _sets(part: pa.RecordBatch, shingle: int) -> Iterator[tuple]:
    """(doc_id, sorted distinct shingles) of a batch of (doc_id, text)."""
    for low in range(0, part.num_rows, ROWS):
        some = part.slice(low, ROWS)
        ids = some.column(0).to_pylist()
        for first, end, upto, words in hashed_words(*utf8(some.column(1)), SPACED):
            for i in range(end - first):
                yield ids[first + i], np.unique(shingle_hashes(words[upto[i]:upto[i + 1]], shingle))


def sketches(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, with_keys: bool = True) -> DataFrame:
    """One row per document: doc_id, fp, n, short, carried, sketch, keys; a task gives a set's sketches and keys once.

    Keys are many; without them a pass costs less and its result is small enough to store.
    """
    lists = ("short", "carried", "sketch", "keys")
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), *[(c, pa.list_(pa.int64())) for c in lists]])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, fps, sizes, *arrays = zip(*rows, strict=True)
        lists = [
            pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(x) for x in column])]).astype(np.int32), pa.array(np.concatenate(column), pa.int64())
            )
            for column in arrays
        ]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), *lists], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nothing = np.zeros(0, dtype=np.int64)
        for part in parts:
            held, size = [], 0
            for doc, shingles in _sets(part, shingle):
                if not len(shingles):
                    held.append((doc, None, 0, *[nothing] * len(lists)))
                    continue
                fp = name(shingles)
                if fp in seen:
                    held.append((doc, fp, len(shingles), *[nothing] * len(lists)))
                    continue
                seen.add(fp)
                keys = block_keys(shingles, percent).view(np.int64) if with_keys else nothing
                sketch = parity(shingles)
                held.append((doc, fp, len(shingles), folded(sketch), folded(sketch, min(len(sketch), CARRIED_WORDS)), sketch, keys))
                size += len(keys) + len(sketch) + 16
                if size > 1 << 19:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)
        release()

    return df.mapInArrow(run, f"doc_id long, fp long, n long, {', '.join(f'{c} array<long>' for c in lists)}")


def _bits(ids: DataFrame) -> np.ndarray:
    """A bit field of 2 ** FILTER_BITS bits with the hashed ids of (doc_id) set.

    It has that size whatever the number of ids: with very many it lets more rows
    pass than are needed, which the join after it takes out.
    """
    words = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("place")).selectExpr(
        "cast(shiftright(place, 6) as int) AS word", "shiftleft(1L, cast(place % 64 as int)) AS bit"
    )
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row["word"]] = row["bits"]
    return out


def _set_rows(df: DataFrame, shingle: int, wanted: np.ndarray) -> DataFrame:
    """(fp, shingles) of the documents that pass the bit field."""
    schema = pa.schema([("fp", pa.int64()), ("shingles", pa.binary())])
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            place = np.asarray(part.column("place"))
            part = part.filter(pa.array(shared.value[place >> 6] >> (place & 63) & 1 == 1))
            held, size = [], 0
            for _, shingles in _sets(part, shingle):
                if not len(shingles):
                    continue
                held.append((name(shingles), shingles.tobytes()))
                size += len(shingles)
                if size > 1 << 18:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)
        release()

    placed = df.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("place"))
    return placed.mapInArrow(run, "fp long, shingles binary")


def _near(percent: int, a: str, b: str) -> Column:
    """The sizes fit, and the short sketches are no further apart than linked sets can be.

    ``a`` and ``b`` end the names of the two sides' columns.
    """
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    apart = sum(
        (F.bit_count(F.get(F.col(f"short_{a}"), F.lit(i)).bitwiseXOR(F.get(F.col(f"short_{b}"), F.lit(i)))) for i in range(SKETCH_WORDS)), F.lit(0)
    )
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def _may_link(percent: int, a: str, b: str, sketch: str = "sketch") -> Column:
    """``_near``, and so are the wider sketches of that name.

    Sizes that fit differ by less than the factor two, so at most one side's sketch is
    folded once.
    """
    def fold(x: Column) -> Column:
        half = F.shiftright(F.size(x), 1)
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    x, y = F.col(f"{sketch}_{a}"), F.col(f"{sketch}_{b}")
    left, right = F.when(F.size(x) > F.size(y), fold(x)).otherwise(x), F.when(F.size(y) > F.size(x), fold(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(left, right, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    return _near(percent, a, b) & (apart * (100 + percent) <= (F.col(f"n_{a}") + F.col(f"n_{b}")) * (100 - percent))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of set names that link."""
    pairs = step(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    holders = nodes.select("fp", "holder").join(needed, "fp", "left_semi").select(F.col("holder").alias("doc_id"))
    sets = step(_set_rows(docs, shingle, _bits(holders)), "sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = both.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("of_b")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for x, y in zip(part.column("of_a"), part.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(kept), part.column("b").filter(kept)], schema=schema)

    # a set may have been read from two documents; a link counts once
    links = step(both.mapInArrow(run, "a long, b long").distinct(), "links")
    discard(pairs, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(v, root): the smallest node reachable from each node of the links (a, b).

    Every round takes the smallest label among the neighbours and then the label of that
    label, so labels travel along chains in a logarithmic number of rounds.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = step(both, "edges")
    labels = step(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        told = step(labels.join(near, "v").select("v", F.least("root", "near").alias("root"), F.col("root").alias("old")), "labels")
        jump = told.select(F.col("v").alias("root"), F.col("root").alias("further"))
        after = step(told.join(jump, "root", "left").select("v", F.least("root", F.coalesce("further", "root")).alias("root"), "old"), "labels")
        discard(labels, told)
        if after.filter("root <> old").isEmpty():
            discard(both)
            return after.select("v", "root")
        labels = after


def linked_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    docs = pick(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # the blocks before all else: nothing is stored yet beside their shuffle, the largest
    block = Window.partitionBy("k")
    met = sketches(docs, shingle, percent).select(F.explode("keys").alias("k"), "fp")
    met = met.withColumns({"lead": F.min("fp").over(block), "last": F.max("fp").over(block)}).filter("lead < last")
    met = step(met.select("k", "fp", "lead").distinct(), "blocks")

    drawn = step(sketches(docs, shingle, percent, with_keys=False).drop("keys"), "sketches")
    # equal sets: one node each, with the sketch of whichever task gave one
    nodes = drawn.filter("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("holder"), F.first("n").alias("n"),
        *[F.max(F.when(F.size(c) > 0, F.col(c))).alias(c) for c in ("short", "carried", "sketch")],
    )
    nodes = step(nodes, "nodes")
    members = step(drawn.select("doc_id", "fp", F.col("n").alias("n_shingles")), "members")
    discard(drawn)

    def side(end: str) -> DataFrame:
        return nodes.select(F.col("fp").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "short", "sketch")])

    def fits(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(_may_link(percent, "a", "b")).select(pairs.columns)

    def all_of(tables: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.union, tables)

    def closest(pairs: DataFrame) -> DataFrame:
        """A few pairs per set: with the leads of most of its blocks."""
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        place = Window.partitionBy("b").orderBy(F.desc("n"), F.desc("a"))
        return counted.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= LEADS).select("a", "b")

    def with_roots(rows: DataFrame, roots: DataFrame, name: str = "fp", to: str = "root") -> DataFrame:
        told = rows.join(roots.select(F.col("v").alias(name), F.col("root").alias(to)), name, "left")
        return told.withColumn(to, F.coalesce(to, name))

    def open_blocks(links: DataFrame) -> DataFrame:
        """(k, fp, root, size) of the blocks whose members are in several classes; size is that of the class."""
        roots = components(links)
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        known = with_roots(met.select("k", "fp"), roots)
        known = known.withColumns({"low": F.min("root").over(block), "high": F.max("root").over(block)}).filter("low < high")
        known = known.select("k", "fp", "root").join(sizes, "root", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        return step(known.select("k", "fp", "root", "size"), "open-blocks")

    # first each set with a few leads, then, round by round, a set of each class in a block with one of the largest class
    found = [_verified(fits(closest(met.filter("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b")))), docs, nodes, shingle, percent)]
    known = open_blocks(all_of(found))
    for _ in range(ROUNDS):
        heads = known.groupBy("k", "root", "size").agg(F.min("fp").alias("b"))
        lead = F.min(F.struct(-F.col("size"), F.col("b"))).over(block)
        pairs = heads.withColumn("a", lead["b"]).filter("a <> b").select("a", "b")
        found.append(_verified(fits(closest(pairs)), docs, nodes, shingle, percent))
        discard(known)
        known = open_blocks(all_of(found))

    # at last all members of a block that are not in one class
    # (a pair is told by its first common block, which no earlier block of both precedes, and
    # by few of the others: those whose EARLIER blocks before have none in common)
    own = Window.partitionBy("fp").orderBy("k")
    told = known.withColumn("earlier", F.array(*[F.coalesce(F.lag("k", i).over(own), F.col("fp")) for i in range(1, EARLIER + 1)]))
    # the wider sketch goes along, so that of a large group of near copies only those close to the threshold leave the join
    told = step(told.join(nodes.select("fp", "n", "short", "carried"), "fp"), "open-sets")
    discard(met, known)
    columns = ("fp", "root", "n", "short", "carried", "earlier")
    sides = [told.select("k", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "ab"]
    apart = sides[0].join(
        sides[1],
        (sides[0]["k"] == sides[1]["k"]) & (F.col("fp_a") < F.col("fp_b")) & (F.col("root_a") != F.col("root_b")) & _may_link(percent, "a", "b", "carried")
        & ~F.arrays_overlap("earlier_a", "earlier_b"),
    )
    # long sets fill the sketch that went along, and any two pass it: the one that follows their size tells before sets are read
    rest = step(fits(apart.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"), "root_a", "root_b").distinct()), "rest")
    discard(told)
    # of two classes a few pairs first: if one links, the others of these classes need not be looked at
    place = Window.partitionBy("root_a", "root_b").orderBy(F.xxhash64("a", "b"))
    few = rest.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= LEADS).select("a", "b")
    found.append(_verified(few, docs, nodes, shingle, percent))
    roots = components(all_of(found))
    left = with_roots(with_roots(rest.select("a", "b"), roots, "a", "root_a"), roots, "b", "root_b").filter("root_a <> root_b")
    found.append(_verified(left.select("a", "b"), docs, nodes, shingle, percent))
    roots = components(all_of(found))

    classes = nodes.select("fp", "holder").join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left")
    classes = step(classes.select("fp", "holder", F.coalesce("root", "fp").alias("root")), "classes")
    discard(nodes, rest, *found)
    heads = classes.groupBy("root").agg(F.min("holder").alias("component_id"))
    named = classes.select("fp", "root").join(heads, "root").select("fp", "component_id")
    return members.join(named, "fp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+') IF x <> ''] AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION SELECT links.y, reach.r FROM reach JOIN links ON links.x = reach.v
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r) FROM reach WHERE v = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""


@query("op5_ngram_jaccard_join", SQL)
def op5_ngram_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    """Set size and class of every document."""
    return linked_classes(table(spark, directory, "documents"))
