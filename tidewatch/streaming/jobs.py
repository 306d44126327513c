"""Streaming jobs: the five-table warehouse and the window outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.sources.changelog import parse_changes
from tidewatch.streaming.keyed import PACKS, RETENTION_MS, checked_changes, keyed_state
from tidewatch.streaming.manifest import GRACE_MS
from tidewatch.streaming.tables import BatchTable, KeyedTable
from tidewatch.streaming.warehouse import (
    current_rows,
    delta_totals,
    dwd_rows,
    live_metrics,
    merge_totals,
    metric_minute,
    ods_rows,
    signed_deltas,
)
from tidewatch.streaming.windows import streaming_windows

# Group keys of the three metric tables.
STORE_KEYS = ["run_id", "store_id"]
MINUTE_KEYS = ["run_id", "metric_minute"]
RUN_KEYS = ["run_id"]


def newest_changes(changes: DataFrame) -> DataFrame:
    """The newest change per key, deletes included."""
    last = changes.groupBy("key").agg(
        F.max_by(F.struct("deleted", "row"), F.col("order")).alias("last"), F.max("order").alias("order")
    )
    return last.select("key", "last.deleted", "last.row", "order")


def live_rows(changes: DataFrame) -> DataFrame:
    """The newest change of each key that is not deleted."""
    return newest_changes(changes).filter(~F.col("deleted"))


@dataclass(frozen=True)
class Warehouse:
    """The target tables below one folder, and how to read them.

    Current orders are a keyed table, in ``buckets`` by order, and a log of the changes not merged into it yet.
    """

    spark: SparkSession
    root: str
    buckets: int = 64

    def table(self, name: str) -> BatchTable:
        return BatchTable(self.spark, f"{self.root}/{name}")

    def ods(self) -> DataFrame:
        """Event log; a batch is stored once however often it is replayed."""
        return self.table("ods").read().drop("batch_id")

    def orders(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/dwd_orders", ["key"], live_rows, self.buckets)

    def current(self) -> DataFrame:
        """Current orders: what is merged, and the newer changes."""
        parts = [t.read().drop("batch_id") for t in (self.orders(), self.table("dwd")) if t.holds_rows()]
        if not parts:
            raise LookupError(f"no committed batch in {self.root}")
        changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return dwd_rows(live_rows(changes).select("row.*"))

    def quarantine(self) -> DataFrame:
        """Changes whose before image was not the current row, as they came."""
        return self.table("quarantine").read().drop("batch_id")

    def store_metrics(self) -> DataFrame:
        return live_metrics(merge_totals(self.table("dws_store").read(), STORE_KEYS), STORE_KEYS)

    def minute_metrics(self) -> DataFrame:
        return live_metrics(merge_totals(self.table("dws_minute").read(), MINUTE_KEYS), MINUTE_KEYS, average=False)

    def run_metrics(self) -> DataFrame:
        return live_metrics(merge_totals(self.table("ads_run").read(), RUN_KEYS), RUN_KEYS)

    def fold(self) -> None:
        """Merge the keyed tables' batches and compact the logs; a regular job, which may run beside the streams.

        Of the current orders only the buckets with changes are rewritten.
        """
        log = self.table("dwd")
        ids = log.batch_ids()
        if ids:
            # the merged table is as old as its newest batch; the log lets go of it afterwards
            self.orders().merge(log.read().drop("batch_id"), ids[-1])
            log.forget(ids[-1])
        for name, keys in (("dws_store", STORE_KEYS), ("dws_minute", MINUTE_KEYS), ("ads_run", RUN_KEYS)):
            self.table(name).fold(lambda df, keys=keys: merge_totals(df, keys))
        for name in ("ods", "quarantine"):
            self.table(name).compact()

    def vacuum(self, keep_versions: int = 1, grace_ms: int = GRACE_MS) -> None:
        """Remove what folds and merges have replaced."""
        for table in (self.orders(), *[self.table(n) for n in ("ods", "dwd", "dws_store", "dws_minute", "ads_run", "quarantine")]):
            table.vacuum(keep_versions, grace_ms)


def run_stream(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], interval: str | None = None, mode: str = "append") -> StreamingQuery:
    """Start a stream into a batch function: all available data, or every interval."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def start_warehouse(
    raw: DataFrame, warehouse: Warehouse, checkpoints: str, interval: str | None = None, retention_ms: int = RETENTION_MS
) -> list[StreamingQuery]:
    """Feed all tables from one raw change stream.

    The log takes every raw record. The keyed tables read the repeat-free changes, of which state holds one position and
    row per key; one cached batch serves all of them, each storing a small mergeable summary instead
    of rewriting its state. A change that does not fit the current row counts like any other, as the log has it,
    and is put into the quarantine table for people to look at. On an interval, deleted keys are forgotten after
    ``retention_ms``.
    """
    ods, quarantine = warehouse.table("ods"), warehouse.table("quarantine")
    keyed = {name: warehouse.table(name) for name in ("dwd", "dws_store", "dws_minute", "ads_run")}
    for name, target in {"ods": ods, **keyed}.items():
        target.refuse_fresh_checkpoint(f"{checkpoints}/{'ods' if name == 'ods' else 'keyed'}")

    def write_log(batch: DataFrame, batch_id: int) -> None:
        ods.write(ods_rows(batch), batch_id)

    def write_keyed(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        sums = None
        try:
            changes = parse_changes(batch)
            keyed["dwd"].write(current_rows(changes, "id", ["partition", "offset"], with_marks=True), batch_id)
            deltas = signed_deltas(changes).withColumn("metric_minute", metric_minute(F.col("event_time")))
            # payloads are parsed for these once; the three tables are sums of the same groups
            sums = delta_totals(deltas, list(dict.fromkeys([*STORE_KEYS, *MINUTE_KEYS]))).persist()
            kind = sums.schema["amount_sum"].dataType
            for name, keys in (("dws_store", STORE_KEYS), ("dws_minute", MINUTE_KEYS), ("ads_run", RUN_KEYS)):
                keyed[name].write(merge_totals(sums, keys).withColumn("amount_sum", F.col("amount_sum").cast(kind)), batch_id)
            wrong = batch.filter("problem is not null")
            if not wrong.isEmpty():
                quarantine.write(wrong, batch_id)
        finally:
            batch.unpersist()
            if sums is not None:
                sums.unpersist()

    queries = [run_stream(raw, f"{checkpoints}/ods", write_log, interval)]
    with keyed_state(raw.sparkSession):
        changes = checked_changes(raw, "id", retention_ms=retention_ms if interval else None, packs=PACKS)
        queries.append(run_stream(changes, f"{checkpoints}/keyed", write_keyed, interval))
    return queries


def start_totals(deltas: DataFrame, target: BatchTable, keys: list[str], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Running group totals kept in streaming state (update mode).

    Every micro-batch writes the groups it changed; the newest batch per group
    is its current total.
    """
    target.refuse_fresh_checkpoint(checkpoint)
    return run_stream(delta_totals(deltas, keys), checkpoint, target.write, interval, mode="update")


def newest_totals(target: BatchTable, keys: list[str]) -> DataFrame:
    body = F.struct("order_count", "priced_count", "amount_sum")
    newest = target.read().groupBy(*keys).agg(F.max_by(body, F.col("batch_id")).alias("b"))
    return newest.select(*keys, "b.*")


def start_windows(deltas: DataFrame, target: BatchTable, checkpoint: str, interval: str | None = None, shop: str = "shop_id") -> StreamingQuery:
    """Closed sliding windows, each written once when the watermark passes it."""
    target.refuse_fresh_checkpoint(checkpoint)
    return run_stream(streaming_windows(deltas, shop), checkpoint, target.write, interval)
