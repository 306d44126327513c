"""Exactly-once tables of micro-batches, and a keyed table whose merges rewrite few files.

Both publish versions in a log of manifests: a batch or merge is seen whole or not at all, a repeated
batch id is skipped, and a read opens one manifest however many batches were written.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.streaming.manifest import GRACE_MS, MAX_RETRIES, RETRY_INTERVAL_MS, CommitFailed, Conflict, Manifests


def kept_schema(df: DataFrame) -> str:
    """The schema as text, with nulls allowed at every depth, as files are read back."""
    text = df.schema.json()
    for flag in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{flag}":false', f'"{flag}":true')
    return text


def _schema(content: dict) -> StructType:
    return StructType.fromJson(json.loads(content["schema"]))


def _aligned(rows: DataFrame, content: dict) -> DataFrame:
    """The rows in the types the table has had from its first version on."""
    if "schema" not in content:
        return rows
    schema = _schema(content)
    if set(schema.names) != set(rows.columns):
        raise ValueError(f"the table has the columns {schema.names}, not {rows.columns}")
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


class BatchTable:
    """Batches by id, as a streaming sink hands them over.

    A version lists folded parts and the batches after them. Writing a batch costs what the batch
    costs; ``fold`` and ``compact`` keep the number of folders small, ``vacuum`` removes what they replaced.
    """

    def __init__(self, spark: SparkSession, path: str, retries: int = MAX_RETRIES, interval_ms: int = RETRY_INTERVAL_MS) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.log = Manifests(spark, path, retries, interval_ms)

    @staticmethod
    def _upto(content: dict) -> int:
        return max([p["upto"] for p in content.get("parts", [])], default=content.get("forgotten", -1))

    @staticmethod
    def _folders(content: dict) -> set[str]:
        return {p["folder"] for p in content.get("parts", [])} | set(content.get("batches", {}).values())

    def batch_ids(self) -> list[int]:
        """Committed batches that are in no folded part."""
        return sorted(map(int, self.log.snapshot().content.get("batches", {})))

    def _has(self, content: dict, batch_id: int) -> bool:
        return batch_id <= self._upto(content) or str(batch_id) in content.get("batches", {})

    def write(self, batch: DataFrame, batch_id: int) -> bool:
        """Write a batch unless it is already there; True when written."""
        before = self.log.snapshot().content
        if self._has(before, batch_id):
            return False
        folder = self.log.new_folder()
        stored = _aligned(batch.withColumn("batch_id", F.lit(batch_id)), before)
        stored.write.parquet(f"{self.path}/{folder}")

        def add(content: dict) -> dict | None:
            if self._has(content, batch_id):
                return None
            batches = {**content.get("batches", {}), str(batch_id): folder}
            return {"schema": kept_schema(stored), **content, "batches": batches}

        return self.log.commit(add).content["batches"].get(str(batch_id)) == folder

    def _rows(self, content: dict, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(_schema(content)).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """All committed rows of a version, the newest by default, with ``batch_id``; folded ones have the last id of their part."""
        content = self.log.snapshot(version).content
        if not self._folders(content):
            raise LookupError(f"no committed batch in {self.path}")
        return self._rows(content, sorted(self._folders(content)))

    def fold(self, merge: Callable[[DataFrame], DataFrame]) -> int | None:
        """Merge everything committed so far into one part, so reads stay short.

        ``merge`` must give the same result on folded data as on the batches (a mergeable summary).
        """
        return self._replace(lambda content: self._folders(content), merge, 0)

    def compact(self) -> int | None:
        """Put the batches since the last part together into one more part, for logs whose rows are never merged.

        Earlier parts are not read; rows keep their batch ids.
        """
        return self._replace(lambda content: set(content["batches"].values()), None, None)

    def _replace(self, sources: Callable[[dict], set[str]], merge: Callable[[DataFrame], DataFrame] | None, keep: int | None) -> int | None:
        before = self.log.snapshot().content
        if not before.get("batches"):
            return None
        upto = max(map(int, before["batches"]))
        rows = self._rows(before, sorted(sources(before)))
        if merge is not None:
            rows = _aligned(merge(rows).drop("batch_id").withColumn("batch_id", F.lit(upto)), before)
        folder = self.log.new_folder()
        rows.write.parquet(f"{self.path}/{folder}")

        def put(content: dict) -> dict:
            if content.get("parts", []) != before.get("parts", []):
                raise CommitFailed(f"{self.path}: folded by someone else in the meantime")
            parts = before.get("parts", [])[:keep] + [{"upto": upto, "folder": folder}]
            batches = {i: f for i, f in content["batches"].items() if int(i) > upto}
            return {**content, "parts": parts, "batches": batches}

        self.log.commit(put)
        return upto

    def forget(self, upto: int) -> None:
        """Let go of the batches up to an id, which another table has taken over; they still count as written."""

        def put(content: dict) -> dict:
            batches = {i: f for i, f in content.get("batches", {}).items() if int(i) > upto}
            return {**content, "parts": [], "batches": batches, "forgotten": max(upto, self._upto(content))}

        self.log.commit(put)

    def holds_rows(self) -> bool:
        return bool(self._folders(self.log.snapshot().content))

    def vacuum(self, keep_versions: int = 1, grace_ms: int = GRACE_MS) -> list[str]:
        """Remove old versions and the files only they refer to, and what dead writers have left."""
        return self.log.vacuum(self._folders, keep_versions, grace_ms)

    def refuse_fresh_checkpoint(self, checkpoint: str) -> None:
        """A new checkpoint over a filled table would replay the source into it."""
        if self.log.snapshot().content and not self.log.exists(f"{checkpoint}/offsets"):
            raise ValueError(f"{self.path} holds data but the checkpoint {checkpoint} is new")


class KeyedTable:
    """One row per key, in parts by the values of ``by`` and, within each, ``buckets`` by key hash.

    A version maps each part to the folder that holds it. A merge rewrites the parts its rows fall into, all
    others keep their files, and a look-up reads only the parts asked for. The number of buckets is fixed when
    the table is made: one task writes a part, so choose it for parts of some hundred MB.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 64,
        by: list[str] | None = None, ordered: bool = False, retries: int = MAX_RETRIES, interval_ms: int = RETRY_INTERVAL_MS,
    ) -> None:
        """``ordered``: parts are named by the one ``by`` column, a whole number, so that ranges of it can be read."""
        self.spark, self.path, self.keys, self.merge_rows, self.by, self.ordered = spark, path.rstrip("/"), keys, merge, by or [], ordered
        self.log = Manifests(spark, path, retries, interval_ms)
        self.buckets = self.log.snapshot().content.get("count", buckets)

    def _part(self) -> Column:
        """Name of a row's part: a digest of the ``by`` values, if any, and the bucket."""
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("string")
        if not self.by:
            return bucket
        return F.concat(self._digest(), F.lit("-"), bucket)

    def _digest(self) -> Column:
        if self.ordered:
            return F.col(f"`{self.by[0]}`").cast("bigint").cast("string")
        return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in self.by]).cast("binary"))

    @staticmethod
    def _folders(content: dict) -> set[str]:
        return {f.rsplit("/", 1)[0] for f in content.get("parts", {}).values()}

    def files(self) -> dict[str, str]:
        """Folder of each part that holds rows."""
        return dict(self.log.snapshot().content.get("parts", {}))

    def holds_rows(self) -> bool:
        return bool(self.files())

    def _rows(self, content: dict, chosen: list[str]) -> DataFrame:
        schema, held = _schema(content), content["parts"]
        paths = [f"{self.path}/{held[p]}" for p in sorted(chosen) if p in held]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, changes: DataFrame, batch_id: int | None = None, mark: tuple[str, str] | None = None) -> list[str] | None:
        """Fold ``changes`` into the rows of their keys; the parts rewritten, None for what was merged before.

        ``changes`` has the table's columns and is read twice, so a written table or a persisted batch.
        Several rows of a key are folded by ``merge``, of which the result on folded rows must be the same.
        What was merged before is told by ``batch_id``, a growing number, or by ``mark``: a name and what it merged last.
        """
        marked = changes.withColumn("__part", self._part())
        touched = sorted(r[0] for r in marked.select("__part").distinct().collect())  # at most as many as there are parts
        failures = 0
        while True:
            base = self.log.snapshot()
            marks = base.content.get("marks", {})
            if (batch_id is not None and batch_id <= base.content.get("upto", -1)) or (mark is not None and marks.get(mark[0]) == mark[1]):
                return None
            rows = changes
            if base.content:
                rows = self._rows(base.content, touched).unionByName(changes)
            folded = _aligned(self.merge_rows(rows), base.content)
            folder = self.log.new_folder()
            placed = folded.withColumn("__part", self._part()).repartition(max(len(touched), 1), "__part")
            placed.write.partitionBy("__part").parquet(f"{self.path}/{folder}")
            written = [n for n in self.log.names(f"{self.path}/{folder}") if n.startswith("__part=")]
            parts = {p: f for p, f in base.content.get("parts", {}).items() if p not in touched}
            parts |= {n.split("=", 1)[1]: f"{folder}/{n}" for n in written}
            content = {"schema": kept_schema(folded), **base.content, "count": self.buckets, "parts": parts}
            if batch_id is not None:
                content["upto"] = batch_id
            if mark is not None:
                content["marks"] = {**marks, mark[0]: mark[1]}
            try:
                self.log.publish(base.version + 1, content)
                return touched
            except Conflict:
                # rows of a touched part may have changed: merge with the newer ones
                failures += 1
                if failures > self.log.retries:
                    raise CommitFailed(f"{self.path}: other writers were faster {failures} times") from None

    def _content(self, version: int | None = None) -> dict:
        content = self.log.snapshot(version).content
        if not content:
            raise LookupError(f"nothing merged into {self.path}")
        return content

    def read(self, version: int | None = None) -> DataFrame:
        content = self._content(version)
        return self._rows(content, list(content["parts"]))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys (with their ``by`` columns), from their parts' files only."""
        content = self._content()
        wanted = keys.select(*[F.col(f"`{k}`") for k in dict.fromkeys([*self.by, *self.keys])]).distinct()
        parts = [r[0] for r in wanted.select(self._part().alias("p")).distinct().collect()]
        same = [F.col(f"t.`{k}`").eqNullSafe(F.col(f"w.`{k}`")) for k in self.keys]
        return self._rows(content, parts).alias("t").join(wanted.alias("w"), same, "left_semi")

    def within(self, values: DataFrame) -> DataFrame:
        """The rows of the given ``by`` values, from their parts' files only; ``values`` are few, as parts are."""
        content = self._content()
        digests = {r[0] for r in values.select(self._digest().alias("d")).distinct().collect()}
        return self._rows(content, [p for p in content["parts"] if p.rsplit("-", 1)[0] in digests])

    def upto(self, value: int) -> DataFrame:
        """The rows whose ``by`` number is at most ``value``, from their parts' files only."""
        content = self._content()
        return self._rows(content, [p for p in content["parts"] if int(p.rsplit("-", 1)[0]) <= value])

    def vacuum(self, keep_versions: int = 1, grace_ms: int = GRACE_MS) -> list[str]:
        return self.log.vacuum(self._folders, keep_versions, grace_ms)
