"""One rule run from dataset to outbox, as lazy tables over one evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import anomalies as A
from tidewatch.operators import groups as G
from tidewatch.operators.rules import Rule, evaluate, run_summary
from tidewatch.session import materialise

GROUP_SCHEMA = (
    "rule_id string, detected_at timestamp_ntz, run_id string, rule_name string, scanned_rows bigint, "
    "matched_rows bigint, new_anomalies bigint, broadcast_enabled boolean, timeout_enabled boolean, "
    "timeout_webhook string, timeout_deadline timestamp_ntz, timeout_processed_at timestamp_ntz"
)
REQUEST_SCHEMA = "id string, anomaly_id string, recipient_user_id string, delivery_status string, created_at timestamp_ntz"


@dataclass(frozen=True)
class State:
    """The tables a run reads; empty ones for a first run."""

    records: DataFrame
    requests: DataFrame
    groups: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(
            A.empty_records(spark), spark.createDataFrame([], REQUEST_SCHEMA), spark.createDataFrame([], GROUP_SCHEMA)
        )


@dataclass(frozen=True)
class RunResult:
    folded: DataFrame
    records: DataFrame
    summary: DataFrame
    group: DataFrame
    members: DataFrame
    events: DataFrame
    requests: DataFrame
    notifications: DataFrame
    broadcasts: DataFrame | None
    jobs: DataFrame


def run_rule(
    dataset: DataFrame, rule: Rule, order_by: list[str], state: State, run_id: str, now: datetime,
    generation: int = 1, base_url: str = "",
) -> RunResult:
    """Evaluate, fold, merge, number and queue.

    The dataset is evaluated once: the folded matches and the records the run made
    or hit are written to the shared folder, and every other table is a lazy plan
    over those two; records it did not touch are not written again. All ids are derived, so a repeated run yields identical rows.
    """
    matches = A.occurrence_keys(evaluate(dataset, rule, order_by), rule, run_id, now, order_by)
    folded = materialise(A.fold_matches(matches, order_by), "folded")
    merged = A.touched_records(state.records, folded, rule, run_id, now)
    fields = dataset.columns
    merged = materialise(A.snapshot_validation(merged, rule, fields, F.col("is_new")), "touched")
    created = A.new_with_rows(merged, folded)
    if rule.validation_enabled:
        wanted = A.validation_targets(created, rule.validation_targets)
    else:
        wanted = A.validation_targets(created, []).limit(0)
    requests = A.new_requests(wanted, state.requests, now)
    notifications = A.new_notifications(A.notification_targets(created, rule.notification_targets), wanted)
    records = A.after_run(state.records, merged)
    summary = run_summary(dataset, folded, merged.filter("is_new"), rule, run_id)
    detected_at = G.unique_time(state.groups, rule.rule_id, now)
    members = G.group_members(merged, folded, rule, detected_at)
    group = G.group_row(summary, members, records, rule, detected_at)
    broadcasts = G.situation_messages(group, members, records, rule, base_url, fields)
    jobs = A.new_jobs(requests, "validation", generation).unionByName(A.new_jobs(notifications, "notification", generation))
    if broadcasts is not None:
        jobs = jobs.unionByName(A.new_jobs(broadcasts, "group_broadcast", generation))
    events = A.detected_events(merged, now).unionByName(A.requested_events(requests, now))
    return RunResult(folded, records, summary, group, members, events, requests, notifications, broadcasts, jobs)
