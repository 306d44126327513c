"""Stored lists: deep pages that read their range, and literal search that reads the files it must.

``PagedList`` keeps rows in ranges of their sort order with the number of rows of each; a page far down the list is
found by adding these numbers up, and no task passes over the rows before it. ``SearchList`` keeps rows
in ranges of the searched names and, for every three consecutive characters and every exact value, the ranges that hold
it; a search reads the ranges that hold all of a term's, and tests them by the search itself.

Both are built from a table and published as versions; a reader opens one manifest.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidewatch.operators.reports import MAX_PAGE_SIZE
from tidewatch.streaming.manifest import GRACE_MS, Manifests
from tidewatch.streaming.tables import kept_schema

#: Rows of a range, and characters of a gram.
ROWS_PER_RANGE, GRAM = 100_000, 3
#: Folders of postings, by token.
TOKEN_BUCKETS = 64


class _Ranges:
    """Rows in ranges by ``order``: a folder per range, and how many rows each holds."""

    def __init__(self, spark: SparkSession, path: str, order: list[Column], rows_per_range: int = ROWS_PER_RANGE) -> None:
        self.spark, self.path, self.order, self.rows_per_range = spark, path.rstrip("/"), order, rows_per_range
        self.log = Manifests(spark, path)

    def _write(self, rows: DataFrame) -> dict:
        wanted = max(1, math.ceil(rows.count() / self.rows_per_range))
        folder = self.log.new_folder()
        # rows that are equal in the order are told apart by a hash, so that they need not share a range
        keys = [*self.order, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]
        placed = rows.repartitionByRange(wanted, *keys).sortWithinPartitions(*self.order)
        placed.withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(f"{self.path}/{folder}/rows")
        counts = {}
        if self.log.names(f"{self.path}/{folder}/rows"):
            stored = self.spark.read.schema(StructType.fromJson(json.loads(kept_schema(rows))).add("__range", IntegerType())).parquet(f"{self.path}/{folder}/rows")
            counts = {r[0]: r[1] for r in stored.groupBy("__range").count().collect()}  # one row per range
        return {"schema": kept_schema(rows), "folder": folder, "ranges": sorted(counts.items())}

    def _rows(self, content: dict, ranges: list[int]) -> DataFrame:
        schema = StructType.fromJson(json.loads(content["schema"]))
        paths = [f"{self.path}/{content['folder']}/rows/__range={r}" for r in ranges]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _content(self) -> dict:
        content = self.log.snapshot().content
        if not content:
            raise LookupError(f"nothing built in {self.path}")
        return content

    def vacuum(self, keep_versions: int = 1, grace_ms: int = GRACE_MS) -> list[str]:
        return self.log.vacuum(lambda content: {content["folder"]}, keep_versions, grace_ms)


class PagedList(_Ranges):
    """Pages of a table in ``order``, which must not leave ties: let it end with an id."""

    def build(self, rows: DataFrame) -> None:
        content = self._write(rows)
        self.log.commit(lambda _: content)

    def page(self, number: int = 1, size: int = 20) -> tuple[DataFrame, int]:
        """One page in order, and the total; the size is clamped to 1..100.

        A task sorts what is left of the ranges the page falls into, at most two unless ranges are shorter than pages.
        """
        content = self._content()
        size = min(max(size, 1), MAX_PAGE_SIZE)
        start = max(number - 1, 0) * size
        chosen, before, skipped = [], 0, None
        for name, rows in content["ranges"]:
            if before + rows > start and before < start + size:
                chosen.append(name)
                skipped = start - before if skipped is None else skipped
            before += rows
        rows = self._rows(content, chosen).orderBy(*self.order).offset(max(skipped or 0, 0)).limit(size)
        return rows, before


class SearchList(_Ranges):
    """Rows whose ``names`` contain a text or whose ``exact`` values, an array of texts, hold it.

    ``names`` are columns; ``exact`` is an expression over the row, or None.
    """

    def __init__(self, spark: SparkSession, path: str, names: list[str], exact: Column | None = None, rows_per_range: int = ROWS_PER_RANGE) -> None:
        super().__init__(spark, path, [F.col(f"`{n}`") for n in names], rows_per_range)
        self.names, self.exact = names, exact

    def _tokens(self) -> Column:
        """A row's tokens: grams of each name, marked by the name's place, and exact values."""

        def grams(place: int, text: Column) -> Column:
            starts = F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1))
            return F.when(F.char_length(text) >= GRAM, F.transform(starts, lambda at: F.concat(F.lit(f"{place}:"), F.substring(text, at, F.lit(GRAM)))))

        parts = [grams(i, F.col(f"`{name}`")) for i, name in enumerate(self.names)]
        if self.exact is not None:
            parts.append(F.transform(F.filter(self.exact, lambda v: v.isNotNull()), lambda v: F.concat(F.lit("=:"), v)))
        return F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))

    @staticmethod
    def _bucket(token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(TOKEN_BUCKETS)).cast("int")

    def build(self, rows: DataFrame) -> None:
        content = self._write(rows)
        folder = f"{self.path}/{content['folder']}"
        schema = StructType.fromJson(json.loads(content["schema"])).add("__range", IntegerType())
        postings = self.spark.createDataFrame([], "token string, range int")
        if content["ranges"]:
            stored = self.spark.read.schema(schema).parquet(f"{folder}/rows")
            # names repeat within a range: tokens of distinct names only
            named = stored.select("__range", *[F.col(f"`{n}`") for n in self.names], *([self.exact.alias("__exact")] if self.exact is not None else [])).distinct()
            tokens = SearchList(self.spark, self.path, self.names, F.col("__exact") if self.exact is not None else None)._tokens()
            postings = named.select(F.explode(tokens).alias("token"), F.col("__range").alias("range")).distinct()
        postings.withColumn("bucket", self._bucket(F.col("token"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/tokens")
        buckets = [int(n.split("=", 1)[1]) for n in self.log.names(f"{folder}/tokens") if n.startswith("bucket=")]
        self.log.commit(lambda _: {**content, "buckets": sorted(buckets)})

    def ranges_of(self, term: str) -> list[int]:
        """Ranges that may hold rows with the term; all of them for a term shorter than a gram."""
        content = self._content()
        if len(term) < GRAM:
            return [r for r, _ in content["ranges"]]
        grams = {term[i:i + GRAM] for i in range(len(term) - GRAM + 1)}
        # alternatives: every gram in one of the names, or the term as an exact value
        wanted = [(f"{i}:", f"{i}:{g}") for i in range(len(self.names)) for g in sorted(grams)]
        wanted += [("=:", f"=:{term}")] if self.exact is not None else []
        asked = self.spark.createDataFrame(wanted, "kind string, token string").withColumn("bucket", self._bucket(F.col("token")))
        held = set(content["buckets"])
        buckets = sorted({r.bucket for r in asked.select("bucket").distinct().collect()} & held)
        if not buckets:
            return []
        paths = [f"{self.path}/{content['folder']}/tokens/bucket={b}" for b in buckets]
        found = self.spark.read.schema("token string, range int").parquet(*paths).join(F.broadcast(asked), "token")
        whole = found.groupBy("kind", "range").agg(F.count(F.lit(1)).alias("n"))
        enough = (F.col("n") == len(grams)) | (F.col("kind") == "=:")
        return sorted(r.range for r in whole.filter(enough).select("range").distinct().collect())

    def search(self, term: str) -> DataFrame:
        """The rows that hold the term, by the exact test; empty text finds every row."""
        content = self._content()
        hit = F.lit(False)
        for name in self.names:
            hit = hit | F.coalesce(F.contains(F.col(f"`{name}`"), F.lit(term)), F.lit(False))
        if self.exact is not None:
            hit = hit | F.coalesce(F.array_contains(self.exact, term), F.lit(False))
        rows = self._rows(content, self.ranges_of(term))
        return rows.filter(hit) if term else rows
