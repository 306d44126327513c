"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, by CENTROIDS centroids each, learned
by k-means from a sample of at most SAMPLE vectors (those with the smallest id hashes).
The pair of centroids is the vector's cell; every vector is indexed. A query walks the
cells by the sum of its two squared centroid distances, with a heap over the two sorted
lists, in two rounds:

1. until the cells hold at least FIRST vectors; these are reranked exactly and give the
   distance of the k-th found so far;
2. on to every further cell that may still hold a nearer vector: a vector's squared distance
   is the cell's plus its own residual, less a term that spreads with the root of their
   product; SLACK spreads are allowed for. On clustered vectors this round ends soon, on
   vectors without structure it reads a good part of them; measured recall is in the README.

Vectors and queries meet per patch of PATCH cells, in packed blocks: a query's vector is sent once
per patch with a mask of the cells it visits there, and is compared with the vectors of these cells
only. Each task keeps only the k nearest of every query. Equal vectors beyond the k+1 smallest ids are never among the k nearest and are
left out before the shuffle, so a very common vector does not fill a cell.

Nearness is Euclidean, in double precision, on the original vectors; ties go to the smaller
id. Defined results: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components take no part, nor do rows without an id; repeated rows count
once; with fewer than k candidates all are found; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.text import few, pick
from tidewatch.plans.registry import query
from tidewatch.session import materialise, table

CENTROIDS, SAMPLE, FIRST, SLACK, K = 64, 20_000, 2_000, 3.5, 10
#: Vectors and queries of a packed block, and the parts a cell is dealt to.
BLOCK, PARTS = 2_048, 8
#: Cells of a patch (at most 63: their mask is a long).
PATCH = 8


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    rows = pick(df, vec_id=vec_id, vector=vector).filter("vec_id is not null and size(vector) > 0")
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.filter(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    most = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (most["n"] if most else 0))


def _kmeans(points: np.ndarray, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(0)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.choice(len(distinct), min(CENTROIDS, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = _squared(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None], 0)


def codebooks(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Centroids of the two halves, from the sample."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).collect()
    if not sample:
        return None
    points = np.array([r["vector"] for r in sample])
    half = points.shape[1] // 2
    return _kmeans(points[:, :half]), _kmeans(points[:, half:])


def _vectors(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def build(rows: DataFrame, books: tuple[np.ndarray, np.ndarray], k: int = K) -> DataFrame:
    """The stored index: blocks of a patch's vectors (patch, ids, cells, residuals, vectors), by cell."""
    same = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.withColumn("place", F.dense_rank().over(same)).filter(F.col("place") <= k + 1).drop("place")
    kept = kept.dropDuplicates(["vec_id", "vector"])
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value
        for part in parts:
            x = _vectors(part.column("vector"))
            a, b = _squared(x[:, :first.shape[1]], first), _squared(x[:, first.shape[1]:], second)
            i, j = a.argmin(axis=1), b.argmin(axis=1)
            left = a[np.arange(len(x)), i] + b[np.arange(len(x)), j]
            columns = [part.column("vec_id"), part.column("vector"), pa.array(i * len(second) + j, pa.int64()), pa.array(left, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "cell", "residual"])

    placed = kept.mapInArrow(assign, "vec_id long, vector array<double>, cell long, residual double")
    placed = placed.withColumn("patch", F.floor(F.col("cell") / PATCH))
    placed = placed.repartition(F.col("patch"), F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).sortWithinPartitions("patch", "cell")
    blocks = placed.mapInArrow(_pack(["vec_id", "cell", "residual"]), "patch long, n long, vec_id binary, cell binary, residual binary, vectors binary")
    return materialise(blocks, "cells")


def _pack(names: list[str]):
    """Consecutive rows of a patch as one row of packed arrays."""
    kinds = {"vec_id": np.int64, "query_id": np.int64, "cell": np.int64, "cells": np.int64, "residual": np.float64, "reach": np.float64}
    schema = pa.schema([("patch", pa.int64()), ("n", pa.int64()), *[(n, pa.binary()) for n in names], ("vectors", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patch, held, size = None, [], 0

        def packed() -> pa.RecordBatch:
            values = [b"".join(h[i] for h in held) for i in range(len(names) + 1)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([patch, size, *values], schema, strict=True)], schema=schema)

        for part in few(parts):
            patches = np.asarray(part.column("patch"))
            x = _vectors(part.column("vector"))
            columns = [np.asarray(part.column(n)).astype(kinds[n]) for n in names]
            cuts = np.flatnonzero(np.diff(patches)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(patches)], strict=True):
                if a == b:
                    continue
                if held and (patch != patches[a] or size + b - a > BLOCK):
                    yield packed()
                    held, size = [], 0
                patch = int(patches[a])
                for low in range(a, b, BLOCK):
                    high = min(low + BLOCK, b)
                    held.append([c[low:high].tobytes() for c in columns] + [x[low:high].tobytes()])
                    size += high - low
                    if size >= BLOCK:
                        yield packed()
                        held, size = [], 0
        if held:
            yield packed()

    return run


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int]]:
    """Cells of a query by summed distance, from the distances to each half's centroids."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    one, two = one.tolist(), two.tolist()
    heap, last = [(a[0] + b[0], 0, 0)], {}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield total, one[i] * len(b) + two[j]
        last[i] = j
        # (i, j) follows once its neighbours to the left and below have been passed
        if j + 1 < len(b) and (i == 0 or last.get(i - 1, -1) >= j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and last.get(i + 1, -1) == j - 1:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))


def visits(sizes: np.ndarray, residuals: np.ndarray, first: np.ndarray, second: np.ndarray, dims: int, reach: float | None) -> list[int]:
    """Cells of the first round (reach is None), or those of the second within the reach."""
    out, had = [], 0
    most = residuals.max(initial=0.0)
    least = residuals[sizes > 0].min(initial=np.inf)
    for total, cell in walk(first, second):
        starting = had < FIRST
        had += int(sizes[cell])
        if reach is None:
            if not starting:
                break
            if sizes[cell]:
                out.append(cell)
            continue
        if not starting:
            if total > SLACK**2 * most / dims and total + least - 2 * SLACK * np.sqrt(total * most / dims) > reach:
                break
            if sizes[cell] and total + residuals[cell] - 2 * SLACK * np.sqrt(total * residuals[cell] / dims) <= reach:
                out.append(cell)
    return out


def _patches(cells: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The patches of the cells, and for each the mask of those cells."""
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cells = np.sort(np.array(cells, dtype=np.int64))
    patches, first = np.unique(cells // PATCH, return_index=True)
    return patches, np.bitwise_or.reduceat(np.int64(1) << cells % PATCH, first)


def _meet(index: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, squared) of each query's nearest in its cells."""
    packed = cells.repartition(F.col("patch"), F.pmod(F.xxhash64("query_id"), F.lit(PARTS))).sortWithinPartitions("patch")
    packed = packed.mapInArrow(_pack(["query_id", "reach", "cells"]), "patch long, n long, query_id binary, reach binary, cells binary, vectors binary")
    packed = packed.select("patch", "query_id", "reach", "cells", F.col("vectors").alias("queries"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("squared", pa.float64())])

    def nearest(found: list[tuple]) -> list[np.ndarray]:
        q, v, d = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((v, d, q))
        q, v, d = q[order], v[order], d[order]
        start = np.concatenate([[True], q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
        return [q[place < k], v[place < k], d[place < k]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        # a pair of blocks at a time: a batch may hold many
        for part in few(parts, 1):
            for row in part.to_pylist():
                ids, qs = np.frombuffer(row["vec_id"], np.int64), np.frombuffer(row["query_id"], np.int64)
                own, masks = np.frombuffer(row["cell"], np.int64), np.frombuffer(row["cells"], np.int64)
                reach = np.frombuffer(row["reach"], np.float64)
                x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                y = np.frombuffer(row["queries"], np.float64).reshape(len(qs), -1)
                cuts = (np.flatnonzero(np.diff(own)) + 1).tolist()
                for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                    asking = np.flatnonzero(masks >> own[a] % PATCH & 1)
                    step = max(1, (1 << 20) // x[a:b].size)
                    for low in range(0, len(asking), step):
                        some = asking[low:low + step]
                        apart = x[None, a:b] - y[some, None]
                        squared = np.square(apart, out=apart).sum(axis=2)
                        i, j = np.nonzero((squared <= reach[some, None]) & (ids[None, a:b] != qs[some, None]))
                        if len(i):
                            found.append((qs[some[i]], ids[a + j], squared[i, j]))
                            size += len(i)
                if size > 1 << 19:
                    found = [tuple(nearest(found))]
                    size = len(found[0][0])
                    if size > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[0]], schema=schema)
                        found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in nearest(found)], schema=schema)

    both = index.join(packed, "patch").select("vec_id", "cell", "vectors", "query_id", "reach", "cells", "queries")
    return both.mapInArrow(run, "query_id long, vec_id long, squared double")


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Each query's k nearest rows: query_id, rank, vec_id, score (distance).

    ``rows`` and ``queries``: (vec_id, vector) of ``usable``. A query's own id is no answer.
    """
    spark = rows.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    books = codebooks(rows)
    if books is None:
        return spark.createDataFrame([], empty)
    index = build(rows, books, k)
    sums = index.select("cell", "residual").mapInArrow(_sums, "cell long, n long, residual double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("residual").alias("r"))
    sizes = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    residuals = np.zeros(len(sizes))
    for r in sums.collect():  # at most CENTROIDS ** 2 rows
        sizes[r["cell"]], residuals[r["cell"]] = r["n"], r["r"] / r["n"]
    shared = spark.sparkContext.broadcast((books, sizes, residuals))

    def cells(asked: DataFrame) -> DataFrame:
        """(patch, query_id, reach, cells, vector): the first round without ``reach``, else the second."""
        second_round = "reach" in asked.columns
        schema = pa.schema([("patch", pa.int64()), ("query_id", pa.int64()), ("reach", pa.float64()), ("cells", pa.int64()), ("vector", pa.list_(pa.float64()))])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (first, second), sizes_, residuals_ = shared.value
            for part in parts:
                for low in range(0, part.num_rows, 64):
                    some = part.slice(low, 64)
                    x = _vectors(some.column("vector"))
                    a, b = _squared(x[:, :first.shape[1]], first), _squared(x[:, first.shape[1]:], second)
                    reach = some.column("reach").to_pylist() if second_round else [None] * len(x)
                    found = [_patches(visits(sizes_, residuals_, a[i], b[i], x.shape[1], reach[i])) for i in range(len(x))]
                    at = np.repeat(np.arange(len(x)), [len(f) for f, _ in found])
                    if not len(at):
                        continue
                    limits = np.array([np.inf if r is None else r for r in reach])[at]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([f for f, _ in found])), some.column("vec_id").take(pa.array(at)),
                        pa.array(limits), pa.array(np.concatenate([m for _, m in found])), some.column("vector").take(pa.array(at)),
                    ], schema=schema)

        return asked.mapInArrow(run, "patch long, query_id long, reach double, cells long, vector array<double>")

    # a walk takes far longer than its row is wide, so queries are dealt out by number, not by size
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.dropDuplicates(["vec_id"]).repartition(spread, "vec_id")
    place = Window.partitionBy("query_id").orderBy("squared", "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)

    early = materialise(top(_meet(index, cells(asked), k)), "early")
    reach = early.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("squared").alias("reach"))
    asked = asked.join(reach, "vec_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    asked = asked.repartition(spread, "vec_id")
    late = _meet(index, cells(asked), k)
    done = top(early.drop("rank").unionByName(late))
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("squared").alias("score"))


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in few(parts):
        cells, left = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("cell", np.int64), ("residual", np.float64)))
        cells, at = np.unique(cells, return_inverse=True)
        columns = [pa.array(cells), pa.array(np.bincount(at)), pa.array(np.bincount(at, left))]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", "residual"])


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all others."""
    rows = usable(table(spark, directory, "embeddings"))
    return search(rows, rows.filter("vec_id % 100 = 0"))
