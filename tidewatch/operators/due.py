"""What is due by now, from an index by time, so that a scan reads due entries and not the whole table.

An entry is an id and the moment it falls due: a record's deadline, the end of a job's claim. Entries are
parted by spans of time; looking for what is due reads the spans up to now. A changed moment takes the old entry
out and puts a new one in, each in its own span, and entries that were dealt with leave, so passed spans empty.
The index narrows a scan down; whether a row is due is decided by the row itself.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.anomalies import moment
from tidewatch.operators.outbox import CLAIM_LEASE, SCHEDULED_LEASE
from tidewatch.session import materialise
from tidewatch.streaming.tables import KeyedTable

SPAN_SECONDS = 3600


class DueIndex:
    def __init__(self, spark: SparkSession, path: str, span_seconds: int = SPAN_SECONDS, buckets: int = 1) -> None:
        self.spark, self.span_seconds = spark, span_seconds
        self.table = KeyedTable(spark, path, ["id", "due"], self._standing, buckets, by=["span"], ordered=True)

    @staticmethod
    def _standing(entries: DataFrame) -> DataFrame:
        """Entries put in and not taken out; an entry counts once however often it was put in."""
        summed = entries.groupBy("id", "due", "span").agg(F.sum("weight").alias("weight"))
        return summed.filter("weight > 0").withColumn("weight", F.lit(1))

    def _span(self, due: Column) -> Column:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.floor(F.timestamp_diff("SECOND", epoch, due) / self.span_seconds).cast("bigint")

    def change(self, before: DataFrame | None, after: DataFrame | None, batch_id: int | None = None) -> list[str] | None:
        """Take the entries of ``before`` (id, due) out and put those of ``after`` in; the parts rewritten.

        Rows without a moment are no entries.
        """
        sides = [(df, weight) for df, weight in ((before, -1), (after, 1)) if df is not None]
        entries = None
        for df, weight in sides:
            part = df.select("id", F.col("due").cast("timestamp_ntz").alias("due"), F.lit(weight).alias("weight")).filter("due is not null")
            entries = part if entries is None else entries.unionByName(part)
        changed = entries.groupBy("id", "due").agg(F.sum("weight").alias("weight")).filter("weight <> 0")
        spans = changed.withColumn("span", self._span(F.col("due"))).withColumn("weight", F.when(F.col("weight") > 0, 1).otherwise(-1))
        return self.table.merge(materialise(spans, "entries"), batch_id)

    def due(self, now: datetime | str) -> DataFrame:
        """(id, due) of what fell due by ``now``; files of later spans are not read."""
        at = now if isinstance(now, datetime) else datetime.fromisoformat(str(now))
        span = int((at - datetime(1970, 1, 1)) // timedelta(seconds=self.span_seconds))
        if not self.table.holds_rows():
            return self.spark.createDataFrame([], "id string, due timestamp_ntz")
        return self.table.upto(span).filter(F.col("due") <= moment(at)).select("id", "due")


def deadlines(records: DataFrame) -> DataFrame:
    """(id, due) of open records: their deadline."""
    return records.filter(F.col("status").isin("pending", "processing")).select("id", F.col("validation_deadline").alias("due"))


def claims(jobs: DataFrame, http_timeout_seconds: float) -> DataFrame:
    """(id, due) of claimed jobs: the moment from which the claim counts as lost."""
    status, updated = F.col("status"), F.col("updated_at")
    send = timedelta(seconds=http_timeout_seconds * 3 + 2)
    due = (
        F.when(status.isin("executing", "sending"), updated + F.lit(send))
        .when(status.isin("publishing", "dispatching"), updated + F.lit(CLAIM_LEASE))
        .when(status == "ds_scheduled", updated + F.lit(SCHEDULED_LEASE))
    )
    return jobs.select("id", due.alias("due"))
