"""Anomaly records as a stored table: a run reads and writes its own rule's records only.

Records are parted by rule and, within a rule, into buckets by id. A run reads the parts of its rule, and
what it made or hit replaces the rows of the same ids in the buckets these fall into; files of other
rules and buckets stay as they are. A run that is repeated under its name changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import anomalies as A
from tidewatch.operators.rules import Rule, evaluate
from tidewatch.session import materialise
from tidewatch.streaming.tables import KeyedTable

VERSION = "version"


def newest_version(rows: DataFrame) -> DataFrame:
    """The row of each id with the highest version."""
    body = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy("id").agg(F.max_by(body, VERSION).alias("__row")).select("__row.*")


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark = spark
        self.table = KeyedTable(spark, path, ["id"], newest_version, buckets, by=["rule_id"])

    def all(self) -> DataFrame:
        return self.table.read().drop(VERSION) if self.table.holds_rows() else A.empty_records(self.spark)

    def of_rule(self, rule_id: str) -> DataFrame:
        """A rule's records; files of other rules are not read."""
        if not self.table.holds_rows():
            return A.empty_records(self.spark)
        # the file's name is a digest, so the value itself decides
        one = self.spark.createDataFrame([(rule_id,)], "rule_id string")
        return self.table.within(one).filter(F.col("rule_id") == rule_id).drop(VERSION)

    def put(self, touched: DataFrame, name: str, run_id: str) -> list[str] | None:
        """Put rows in place of those with the same ids; the parts rewritten, None if the run was put before.

        ``touched`` is a written table: it is read more than once.
        """
        columns = A.empty_records(self.spark).columns
        version = self.table.log.snapshot().version + 1
        return self.table.merge(touched.select(*columns).withColumn(VERSION, F.lit(version).cast("bigint")), mark=(name, run_id))

    def run(self, dataset: DataFrame, rule: Rule, order_by: list[str], run_id: str, now: datetime) -> DataFrame:
        """Evaluate a rule and store what it made or hit; those records, each with ``is_new`` and ``is_hit``."""
        matches = A.occurrence_keys(evaluate(dataset, rule, order_by), rule, run_id, now, order_by)
        folded = A.fold_matches(matches, order_by)
        touched = A.touched_records(self.of_rule(rule.rule_id), folded, rule, run_id, now)
        touched = materialise(A.snapshot_validation(touched, rule, dataset.columns, F.col("is_new")), "touched")
        self.put(touched, rule.rule_id, run_id)
        return touched
