"""One maintenance cycle of the outbox, applied to its state tables.

The steps follow each other on the state the previous one left: settled jobs are
reconciled, stale claims taken back, due deliveries queued, and pending jobs published.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import outbox as O
from tidewatch.operators.anomalies import moment
from tidewatch.operators.lifecycle import apply_updates
from tidewatch.session import materialise


@dataclass(frozen=True)
class Outbox:
    """State tables of the outbox."""

    jobs: DataFrame
    notifications: DataFrame
    requests: DataFrame
    broadcasts: DataFrame

    def states(self) -> DataFrame:
        return O.delivery_states(self.notifications, self.requests, self.broadcasts)


_DELIVERIES = {"notification": ("notifications", "status"), "validation": ("requests", "delivery_status"), "group_broadcast": ("broadcasts", "status")}


def apply_jobs(state: Outbox, updates: DataFrame, now) -> Outbox:
    """Job updates (``id`` and ``set_`` columns) written into the jobs table."""
    jobs = {c.removeprefix("set_") for c in updates.columns if c.startswith("set_")} & set(state.jobs.columns)
    own = updates.select("id", *[f"set_{c}" for c in sorted(jobs)]).withColumn("set_updated_at", moment(now))
    return replace(state, jobs=apply_updates(state.jobs, own))


def apply_deliveries(state: Outbox, updates: DataFrame) -> Outbox:
    """New delivery states (``kind``, ``delivery_id``, ``set_delivery_status``; null: as it is)."""
    changed = updates.filter(F.col("set_delivery_status").isNotNull())
    tables = {}
    for kind, (name, column) in _DELIVERIES.items():
        mine = changed.filter(F.col("kind") == kind).select(F.col("delivery_id").alias("id"), F.col("set_delivery_status").alias(f"set_{column}"))
        tables[name] = apply_updates(getattr(state, name), mine)
    return replace(state, **tables)


def add_jobs(state: Outbox, queued: DataFrame, now) -> Outbox:
    """Queued jobs: new ones inserted, failed ones sent again."""
    again = queued.filter(F.col("action") == "requeue").select("id", "set_status", "set_generation")
    state = apply_jobs(state, again, now)
    at = moment(now)
    values = {
        "id": F.col("id"), "anomaly_id": F.col("anomaly_id"), "kind": F.col("kind"), "delivery_id": F.col("delivery_id"), "generation": F.col("set_generation"),
        "status": F.col("set_status"), "cancel_requested": F.lit(False), "publish_attempts": F.lit(0), "created_at": at, "updated_at": at,
    }
    new = queued.filter(F.col("action") == "insert").select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in state.jobs.schema.fields]
    )
    return replace(state, jobs=state.jobs.unionByName(new))


def recover(state: Outbox, records: DataFrame, generation: int, now, aborting: bool = False) -> Outbox:
    """Failed jobs that may go out again are set to go, without a waiting time."""
    found = O.recover_failed(state.jobs, state.states(), records, generation, now, aborting)
    return apply_jobs(state, found.filter("requeue"), now)


def run_cycle(
    state: Outbox, records: DataFrame, generation: int, now, http_timeout_seconds: float = 10, limit: int = 50, aborting: bool = False
) -> tuple[Outbox, DataFrame]:
    """The state after one cycle, and the messages (``key``, ``value``) to publish.

    Each step's result is written out, as the next one reads it more than once.
    """

    def kept(changed: Outbox) -> Outbox:
        names = [n for n in ("jobs", "notifications", "requests", "broadcasts") if getattr(changed, n) is not getattr(state, n)]
        return replace(changed, **{n: materialise(getattr(changed, n), n) for n in names})

    settled = O.reconcile(state.jobs, state.states(), generation, limit)
    state = kept(apply_jobs(state, settled, now))
    stale = materialise(O.stale_jobs(state.jobs, state.states(), generation, now, http_timeout_seconds, limit, aborting), "stale")
    state = kept(apply_deliveries(apply_jobs(state, stale, now), stale))
    due = {
        "validation": O.due_requests(state.requests, now, limit, by_update=True),
        "notification": O.due_notifications(state.notifications, records, limit),
        "group_broadcast": O.due_broadcasts(state.broadcasts, limit),
    }
    for kind, rows in due.items():
        queued = materialise(O.queue_jobs(rows, state.jobs, kind, generation, now, aborting), "queued")
        state = kept(add_jobs(state, queued, now))
    messages = materialise(O.publishable(state.jobs, generation, limit, aborting), "messages")
    state = kept(apply_jobs(state, messages.withColumnRenamed("key", "id"), now))
    return state, messages.select("key", "value")
