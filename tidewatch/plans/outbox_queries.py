"""Registered queries: the delivery outbox."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions.values import backoff_seconds, request_backoff_seconds
from tidewatch.operators import groups as G
from tidewatch.operators import outbox as O
from tidewatch.operators.due import DueIndex, claims
from tidewatch.operators.rule_state import newest_version
from tidewatch.plans.derived import GENERATION, NOW, ctes, frame, record_frame
from tidewatch.plans import registry
from tidewatch.plans.registry import query
from tidewatch.session import materialise, scratch_dir, table
from tidewatch.streaming.tables import KeyedTable


def states(spark, sf):
    return O.delivery_states(frame(spark, sf, "notifications"), frame(spark, sf, "requests"), frame(spark, sf, "broadcasts"))


BASE = ctes("records", "jobs", "notifications", "requests", "broadcasts", "members", "groups") + f""",
  st AS (SELECT 'notification' AS kind, id AS delivery_id, status AS ds, attempts, CAST(NULL AS TIMESTAMP) AS next_at FROM notifications
    UNION ALL SELECT 'validation', id, delivery_status, delivery_attempts, next_attempt_at FROM requests
    UNION ALL SELECT 'group_broadcast', id, status, attempts, next_attempt_at FROM broadcasts),
  j AS (SELECT jobs.*, st.ds, st.attempts, st.next_at FROM jobs LEFT JOIN st ON st.kind = jobs.kind AND st.delivery_id = jobs.delivery_id),
  t AS (SELECT TIMESTAMP '{NOW}' AS now)"""

DONE = """CASE WHEN ds = 'uncertain' THEN 'uncertain' WHEN kind = 'notification' AND ds = 'sent' THEN 'sent'
  WHEN kind = 'validation' AND ds IN ('sent', 'resolved', 'timed_out', 'update_failed') THEN 'sent' WHEN kind = 'group_broadcast' AND ds = 'sent' THEN 'sent'
  WHEN ds = 'aborted' THEN 'aborted' END"""

IN_TRANSIT = """SELECT DISTINCT anomaly_id FROM j WHERE generation = 2 AND NOT cancel_requested AND status NOT IN ('sent', 'aborted')
  AND kind <> 'group_broadcast' AND ds IN ('pending', 'failed', 'sending', 'uncertain')"""


@query("d1_in_transit", f"{BASE} {IN_TRANSIT}")
def d1(spark, sf):
    return O.in_transit(frame(spark, sf, "jobs"), states(spark, sf), GENERATION)


DUE_REQUESTS = """SELECT requests.* FROM requests, t WHERE (delivery_status IN ('pending', 'failed') AND (next_attempt_at IS NULL OR next_attempt_at <= now))
  OR (delivery_status = 'sending' AND (send_started_at IS NULL OR send_started_at <= now - INTERVAL 59 MINUTE
    OR (delivery_attempts < 3 AND updated_at <= now - INTERVAL 30 SECOND AND (next_attempt_at IS NULL OR next_attempt_at <= now))))"""


@query("d2_due_requests", f"{BASE} SELECT id, delivery_status FROM ({DUE_REQUESTS})")
def d2(spark, sf):
    return O.due_requests(frame(spark, sf, "requests"), NOW).select("id", "delivery_status")


@query(
    "d2_due_requests_batch",
    f"{BASE} SELECT id, delivery_status FROM ({DUE_REQUESTS}) ORDER BY coalesce(next_attempt_at, created_at), updated_at, id LIMIT 50",
)
def d2_batch(spark, sf):
    return O.due_requests(frame(spark, sf, "requests"), NOW, 50).select("id", "delivery_status")


def some_jobs(spark, sf):
    """Jobs of which those of small events are still to be created."""
    return frame(spark, sf, "jobs").filter("publish_attempts > 0")


def _queue_sql(kind: str, due: str, owner: str) -> str:
    return f"""{BASE}, due AS ({due}), mine AS (SELECT * FROM jobs WHERE kind = '{kind}' AND publish_attempts > 0)
      SELECT due.id AS delivery_id, {owner} AS anomaly_id, CASE WHEN mine.id IS NULL THEN 'insert' ELSE 'requeue' END AS action, 2 AS generation
      FROM due LEFT JOIN mine ON mine.delivery_id = due.id, t
      WHERE mine.id IS NULL OR (mine.status = 'failed' AND NOT mine.cancel_requested AND (mine.next_attempt_at IS NULL OR mine.next_attempt_at <= now))"""


def _queued(spark, sf, due, kind):
    out = O.queue_jobs(due, some_jobs(spark, sf), kind, GENERATION, NOW)
    return out.select("delivery_id", "anomaly_id", "action", F.col("set_generation").alias("generation"))


@query("d3_queue_validation_jobs", _queue_sql("validation", DUE_REQUESTS, "due.anomaly_id"))
def d3(spark, sf):
    return _queued(spark, sf, O.due_requests(frame(spark, sf, "requests"), NOW), "validation")


@query(
    "d3_queue_validation_batch",
    _queue_sql("validation", f"SELECT * FROM ({DUE_REQUESTS}) ORDER BY updated_at, id LIMIT 50", "due.anomaly_id"),
)
def d3_batch(spark, sf):
    return _queued(spark, sf, O.due_requests(frame(spark, sf, "requests"), NOW, 50, by_update=True), "validation")


@query(
    "d2_due_requests_of_rule",
    f"""{BASE} SELECT id, delivery_status FROM ({DUE_REQUESTS}) WHERE anomaly_id IN (SELECT id FROM records WHERE rule_id = 'rule-purchase')
        AND id IN (SELECT concat('d', event_id) FROM events WHERE user_id % 2 = 0)""",
)
def d2_of_rule(spark, sf):
    ids = table(spark, sf, "events").filter("user_id % 2 = 0").select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("id"))
    due = O.due_requests(frame(spark, sf, "requests"), NOW, request_ids=ids, rule_id="rule-purchase", records=record_frame(spark, sf))
    return due.select("id", "delivery_status")


@query(
    "d4_queue_notification_jobs",
    _queue_sql(
        "notification",
        """SELECT n.* FROM notifications n JOIN records r ON r.id = n.anomaly_id WHERE n.status IN ('pending', 'failed') AND n.attempts < 6 AND r.status <> 'resolved'""",
        "due.anomaly_id",
    ),
)
def d4(spark, sf):
    return _queued(spark, sf, O.due_notifications(frame(spark, sf, "notifications"), record_frame(spark, sf)), "notification")


@query(
    "d5_queue_broadcast_jobs",
    _queue_sql("group_broadcast", "SELECT * FROM broadcasts WHERE status IN ('pending', 'failed') AND attempts < 6", "CAST(NULL AS VARCHAR)"),
)
def d5(spark, sf):
    return _queued(spark, sf, O.due_broadcasts(frame(spark, sf, "broadcasts")), "group_broadcast")


@query(
    "d6_publish_batch",
    f"""{BASE} SELECT id AS key, '{{"version":1,"job_id":"' || id || '","generation":' || generation || ',"kind":"' || kind || '"}}' AS value, 'kafka_queued' AS set_status,
        publish_attempts + 1 AS set_publish_attempts FROM (SELECT * FROM jobs WHERE status = 'pending_publish' ORDER BY created_at, id LIMIT 500)
        WHERE generation = 2 AND NOT cancel_requested""",
)
def d6(spark, sf):
    return O.publishable(frame(spark, sf, "jobs"), GENERATION, 500).drop("set_next_attempt_at")


def messages(spark, sf):
    """A topic with one message per event: some of them broken, old or for unknown jobs."""
    kind = (
        F.when(F.col("event_type") == "view", "group_broadcast").when(F.col("event_type").isin("click", "signup"), "notification").otherwise("validation")
    )
    job = F.when(F.col("user_id") % 11 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("j"), F.col("event_id").cast("string")))
    body = F.struct(
        F.when(F.col("user_id") % 9 == 0, 2).otherwise(1).alias("version"), job.alias("job_id"),
        F.when(F.col("value") < 10, 1).otherwise(2).alias("generation"), kind.alias("kind"),
    )
    return table(spark, sf, "events").select(F.col("event_id").alias("message"), F.to_json(body).alias("value"))


MESSAGES = """m AS (SELECT event_id AS message, CASE WHEN user_id % 11 = 0 THEN 'unknown' ELSE concat('j', event_id) END AS job_id,
    CASE WHEN user_id % 9 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN value < 10 THEN 1 ELSE 2 END AS generation FROM events)"""


@query(
    "d7_consume_classification",
    f"""{BASE}, {MESSAGES} SELECT m.message, CASE WHEN m.version <> 1 OR j.id IS NULL THEN 'invalid'
        WHEN j.generation <> m.generation OR j.cancel_requested OR j.status IN ('ds_scheduled', 'executing', 'sending', 'sent', 'failed', 'aborted') OR j.generation <> 2 THEN 'duplicate'
        WHEN j.status IN ('publishing', 'dispatching') THEN 'in_progress' WHEN j.status <> 'kafka_queued' THEN 'duplicate'
        WHEN {DONE} IS NOT NULL THEN 'reconciled' ELSE 'dispatch' END AS verdict FROM m LEFT JOIN j ON j.id = m.job_id""",
)
def d7(spark, sf):
    out = O.classify_messages(messages(spark, sf), frame(spark, sf, "jobs"), states(spark, sf), GENERATION)
    return out.select("message", "verdict")


@query(
    "d8_reconcile",
    f"{BASE} SELECT id, kind, {DONE} AS set_status FROM j WHERE generation = 2 AND NOT cancel_requested AND status NOT IN ('sent', 'uncertain', 'aborted') AND {DONE} IS NOT NULL",
)
def d8(spark, sf):
    return O.reconcile(frame(spark, sf, "jobs"), states(spark, sf), GENERATION, None)


OFF = "CASE WHEN ds IN ('pending', 'failed') THEN 'aborted' WHEN ds = 'sending' THEN 'uncertain' END"


D9_SQL = f"""{BASE}, s AS (SELECT j.*, {DONE} AS done, {OFF} AS off FROM j, t WHERE (status IN ('executing', 'sending') AND updated_at <= now - INTERVAL 32 SECOND)
          OR (status IN ('publishing', 'dispatching') AND updated_at <= now - INTERVAL 30 SECOND) OR (status = 'ds_scheduled' AND updated_at <= now - INTERVAL 10 MINUTE))
        SELECT id, status, CASE WHEN cancel_requested THEN CASE WHEN off IS NOT NULL THEN off ELSE coalesce(done, 'aborted') END WHEN generation <> 2 THEN 'aborted'
            WHEN status = 'publishing' THEN 'pending_publish' WHEN status = 'dispatching' THEN 'kafka_queued' WHEN status = 'ds_scheduled' THEN 'pending_publish'
            WHEN done IS NOT NULL THEN done WHEN ds = 'sending' THEN CASE WHEN kind = 'validation' THEN 'failed' ELSE 'uncertain' END ELSE 'pending_publish' END AS set_status,
          CASE WHEN cancel_requested OR generation <> 2 THEN off WHEN status IN ('executing', 'sending') AND ds = 'sending' AND kind <> 'validation' THEN 'uncertain' END AS set_delivery_status
        FROM s"""


@query("d9_stale_leases", D9_SQL)
def d9(spark, sf):
    out = O.stale_jobs(frame(spark, sf, "jobs"), states(spark, sf), GENERATION, NOW, 10, None)
    return out.select("id", "status", "set_status", "set_delivery_status")


@query("d9_stale_leases_indexed", D9_SQL)
def d9_indexed(spark, sf):
    """Ends of claims from an index by hour; only the jobs found there are looked up."""
    folder = f"{scratch_dir(spark)}/claims-{uuid.uuid4().hex}"
    jobs = frame(spark, sf, "jobs")
    stored = KeyedTable(spark, f"{folder}/jobs", ["id"], newest_version, buckets=8)
    stored.merge(materialise(jobs.withColumn("version", F.lit(0)), "jobs"))
    index = DueIndex(spark, f"{folder}/claims")
    index.change(None, claims(jobs, 10))
    out = O.stale_jobs(stored.lookup(index.due(NOW).select("id")).drop("version"), states(spark, sf), GENERATION, NOW, 10, None)
    return out.select("id", "status", "set_status", "set_delivery_status")


ABORT = f"""touched AS (SELECT j.*, status IN ('pending_publish', 'kafka_queued', 'ds_scheduled', 'executing', 'failed') AS hit, {OFF} AS off FROM j
  WHERE generation < 3 AND status NOT IN ('sent', 'uncertain', 'aborted'))"""


@query(
    "d10_generation_abort",
    f"{BASE}, {ABORT} SELECT id, CASE WHEN hit THEN 'aborted' ELSE status END AS set_status, CASE WHEN hit THEN off END AS set_delivery_status FROM touched",
)
def d10(spark, sf):
    return O.abort_generation(frame(spark, sf, "jobs"), states(spark, sf), GENERATION + 1).select("id", "set_status", "set_delivery_status")


@query(
    "d10_generation_abort_counts",
    f"""{BASE}, {ABORT} SELECT count(*) AS aborted_jobs, count(*) FILTER (WHERE off = 'aborted' AND kind = 'notification') AS aborted_notifications,
        count(*) FILTER (WHERE off = 'aborted' AND kind = 'validation') AS aborted_validations,
        count(*) FILTER (WHERE off = 'aborted' AND kind = 'group_broadcast') AS aborted_group_broadcasts FROM touched WHERE hit""",
)
def d10_counts(spark, sf):
    return O.abort_counts(O.abort_generation(frame(spark, sf, "jobs"), states(spark, sf), GENERATION + 1))


@query("d10_generation_abort_events", f"{BASE}, {ABORT} SELECT DISTINCT anomaly_id, 'push_aborted' AS event_type FROM touched WHERE hit AND anomaly_id IS NOT NULL")
def d10_events(spark, sf):
    return O.abort_events(O.abort_generation(frame(spark, sf, "jobs"), states(spark, sf), GENERATION + 1), NOW).select("anomaly_id", "event_type")


CANCEL = f"""grp AS (SELECT DISTINCT rule_id, detected_at FROM members WHERE anomaly_id IN (SELECT anomaly_id FROM wanted)),
  shared AS (SELECT id FROM broadcasts JOIN grp USING (rule_id, detected_at)),
  hit AS (SELECT j.*, {DONE} AS done, {OFF} AS off FROM j WHERE status NOT IN ('sent', 'aborted') AND NOT cancel_requested
    AND (anomaly_id IN (SELECT anomaly_id FROM wanted) OR (kind = 'group_broadcast' AND delivery_id IN (SELECT id FROM shared)))),
  cancelled AS (SELECT id, kind, CASE WHEN status IN ('executing', 'sending') THEN status WHEN off IS NOT NULL THEN off ELSE coalesce(done, 'aborted') END AS set_status,
    CASE WHEN status IN ('executing', 'sending') AND coalesce(ds, '') NOT IN ('pending', 'failed') THEN NULL ELSE off END AS set_delivery_status FROM hit WHERE coalesce(done, '') <> 'sent')"""


@query("d11_cancel_pushes", f"{BASE}, wanted AS (SELECT id AS anomaly_id FROM records WHERE status = 'processing'), {CANCEL} SELECT * FROM cancelled")
def d11(spark, sf):
    ids = record_frame(spark, sf).filter("status = 'processing'").select(F.col("id").alias("anomaly_id"))
    out = O.cancel_pushes(frame(spark, sf, "jobs"), states(spark, sf), frame(spark, sf, "members"), frame(spark, sf, "broadcasts"), ids)
    return out.select("id", "kind", "set_status", "set_delivery_status")


OWNED = """grp AS (SELECT DISTINCT rule_id, detected_at FROM members WHERE anomaly_id IN (SELECT anomaly_id FROM wanted)),
  owned AS (SELECT 'notification' AS kind, id, status, CAST(NULL AS TIMESTAMP) AS next_at FROM notifications WHERE anomaly_id IN (SELECT anomaly_id FROM wanted)
    UNION ALL SELECT 'validation', id, delivery_status, next_attempt_at FROM requests WHERE anomaly_id IN (SELECT anomaly_id FROM wanted)
    UNION ALL SELECT 'group_broadcast', id, status, next_attempt_at FROM broadcasts JOIN grp USING (rule_id, detected_at)),
  off AS (SELECT *, CASE WHEN status IN ('pending', 'failed') THEN 'aborted' WHEN status = 'sending' AND EXISTS (SELECT 1 FROM jobs w WHERE w.kind = owned.kind AND w.delivery_id = owned.id
      AND w.publish_attempts > 0 AND w.status NOT IN ('sent', 'aborted', 'executing', 'sending') AND NOT w.cancel_requested) THEN 'uncertain' ELSE status END AS set_status FROM owned),
  changes AS (SELECT kind, id AS delivery_id, set_status, CASE WHEN set_status NOT IN ('aborted', 'sending', 'uncertain') THEN next_at END AS kept FROM off
    WHERE set_status <> status OR (next_at IS NOT NULL AND set_status IN ('aborted', 'sending', 'uncertain')))"""


@query(
    "d11_cancel_deliveries",
    f"{BASE}, wanted AS (SELECT id AS anomaly_id FROM records WHERE status = 'processing'), {OWNED} SELECT kind, delivery_id, set_status, kept IS NULL AS cleared FROM changes",
)
def d11_deliveries(spark, sf):
    """Deliveries of small events have no job; they are called off all the same."""
    ids = record_frame(spark, sf).filter("status = 'processing'").select(F.col("id").alias("anomaly_id"))
    tables = [frame(spark, sf, name) for name in ("notifications", "requests", "broadcasts", "members")]
    out = O.cancel_deliveries(some_jobs(spark, sf), *tables, ids)
    return out.select("kind", "delivery_id", "set_status", F.col("set_next_attempt_at").isNull().alias("cleared"))


@query(
    "d11_cancel_events",
    f"{BASE}, wanted AS ({IN_TRANSIT}) SELECT anomaly_id, 'push_aborted' AS event_type, '{O.CLEARED_TEXT}' AS description FROM wanted",
)
def d11_events(spark, sf):
    ids = O.in_transit(frame(spark, sf, "jobs"), states(spark, sf), GENERATION)
    return O.cancel_events(ids, NOW).drop("created_at")


RECOVER = """rec AS (SELECT j.id, j.kind, coalesce(j.generation = 2 AND NOT cancel_requested AND (j.next_attempt_at IS NULL OR j.next_attempt_at <= now)
    AND ds IN ('pending', 'failed') AND CASE kind WHEN 'notification' THEN attempts < 6 AND r.status <> 'resolved'
      WHEN 'validation' THEN (next_at IS NULL OR next_at <= now) AND r.status <> 'resolved' ELSE attempts < 6 AND (next_at IS NULL OR next_at <= now) END, false) AS requeue
  FROM j LEFT JOIN records r ON r.id = j.anomaly_id, t WHERE j.status = 'failed')"""


def recovered(spark, sf):
    return O.recover_failed(frame(spark, sf, "jobs"), states(spark, sf), record_frame(spark, sf), GENERATION, NOW)


@query("d12_recover_failed", f"{BASE}, {RECOVER} SELECT id, kind, requeue, CASE WHEN requeue THEN 'pending_publish' ELSE 'failed' END AS set_status FROM rec")
def d12(spark, sf):
    return recovered(spark, sf).drop("set_next_attempt_at")


@query(
    "d12_recover_counts",
    f"""{BASE}, {RECOVER} SELECT count(*) FILTER (WHERE requeue) AS requeued_jobs, count(*) FILTER (WHERE requeue AND kind = 'notification') AS requeued_notifications,
        count(*) FILTER (WHERE requeue AND kind = 'validation') AS requeued_validations, count(*) FILTER (WHERE requeue AND kind = 'group_broadcast') AS requeued_group_broadcasts,
        count(*) FILTER (WHERE NOT requeue) AS skipped_jobs FROM rec""",
)
def d12_counts(spark, sf):
    return O.recover_counts(recovered(spark, sf))


@query(
    "d13_backoff",
    """SELECT event_id, CAST(least(2 ** greatest(user_id % 12, 1), 300) AS BIGINT) AS job_delay,
        CAST(least(300 * 2 ** least(greatest(user_id % 14 - 1, 0), 10), 3600) AS BIGINT) AS request_delay,
        CAST(ts + to_seconds(CAST(least(2 ** greatest(user_id % 12, 1), 300) AS BIGINT)) AS VARCHAR) AS next_attempt_at FROM events""",
)
def d13(spark, sf):
    attempts, failures = F.col("user_id") % 12, F.col("user_id") % 14
    return table(spark, sf, "events").select(
        "event_id", backoff_seconds(attempts).alias("job_delay"), request_backoff_seconds(failures).alias("request_delay"),
        O.next_dispatch_at(F.col("ts"), attempts).cast("string").alias("next_attempt_at"),
    )


@query(
    "d16_card_refresh",
    f"""{BASE} SELECT q.id, r.status FROM requests q JOIN records r ON r.id = q.anomaly_id WHERE q.message_id IS NOT NULL AND (
        (r.status = 'timed_out' AND q.delivery_status IN ('sent', 'update_failed')) OR (r.status = 'resolved' AND q.delivery_status IN ('sent', 'timed_out', 'update_failed'))
        OR (q.synced_result_version < r.validation_result_version AND q.delivery_status IN ('sent', 'timed_out', 'resolved', 'update_failed')))""",
)
def d16(spark, sf):
    return O.card_refresh(frame(spark, sf, "requests"), record_frame(spark, sf)).select("id", "status")


@query(
    "d17_clear_in_transit",
    f"""{BASE}, wanted AS ({IN_TRANSIT}), {CANCEL} SELECT 'cancelled_jobs' AS what, count(*) AS n FROM cancelled
        UNION ALL SELECT 'resolved_records', count(*) FROM records WHERE id IN (SELECT anomaly_id FROM wanted) AND status <> 'resolved'""",
)
def d17(spark, sf):
    cancelled, decisions = O.clear_in_transit(
        frame(spark, sf, "jobs"), states(spark, sf), frame(spark, sf, "members"), frame(spark, sf, "broadcasts"),
        record_frame(spark, sf), GENERATION, "admin",
    )
    jobs = cancelled.agg(F.lit("cancelled_jobs").alias("what"), F.count("*").alias("n"))
    records = decisions.agg(F.lit("resolved_records").alias("what"), F.count_if(F.col("outcome") == "changed").alias("n"))
    return jobs.unionByName(records)


PAUSABLE = {
    "d3": "d3_queue_validation_jobs", "d4": "d4_queue_notification_jobs", "d5": "d5_queue_broadcast_jobs", "d6": "d6_publish_batch", "d9": "d9_stale_leases",
}


@query(
    "d10_paused_pipeline",
    " UNION ALL ".join(
        [f"SELECT '{name}' AS operator, 0 AS paused, count(*) AS running FROM ({registry.SQL[full]})" for name, full in PAUSABLE.items()]
        + [f"SELECT 'd12', 0, coalesce(sum(CASE WHEN requeue THEN 1 ELSE 0 END), 0) FROM ({registry.SQL['d12_recover_failed']})"]
        + ["SELECT 'd14', 0, 1", "SELECT 'd17', 0, 1"]
    ),
)
def d10_paused(spark, sf):
    """What each step takes while pushes are being aborted, and otherwise; d14 and d17: whether they act."""
    jobs, known = frame(spark, sf, "jobs"), states(spark, sf)
    tables = {n: frame(spark, sf, n) for n in ("notifications", "requests", "broadcasts", "members", "groups")}
    records = record_frame(spark, sf)
    due = {
        "d3": ("validation", O.due_requests(tables["requests"], NOW)), "d4": ("notification", O.due_notifications(tables["notifications"], records)),
        "d5": ("group_broadcast", O.due_broadcasts(tables["broadcasts"])),
    }

    def taken(aborting: bool) -> dict:
        out = {n: O.queue_jobs(rows, some_jobs(spark, sf), kind, GENERATION, NOW, aborting) for n, (kind, rows) in due.items()}
        out["d6"] = O.publishable(jobs, GENERATION, 500, aborting)
        out["d9"] = O.stale_jobs(jobs, known, GENERATION, NOW, 10, None, aborting)
        out["d12"] = O.recover_failed(jobs, known, records, GENERATION, NOW, aborting).filter("requeue")
        scan = G.timeout_scan(tables["groups"], tables["members"], records, tables["requests"], tables["broadcasts"], NOW, aborting=aborting)
        out["d14"] = scan.due.select(F.lit(1).alias("acts")).distinct()
        try:
            out["d17"] = O.clear_in_transit(jobs, known, tables["members"], tables["broadcasts"], records, GENERATION, "admin", aborting)[0].select(F.lit(1).alias("acts")).distinct()
        except O.PipelinePaused:
            out["d17"] = jobs.filter(F.lit(False))
        return out

    paused, running = taken(True), taken(False)
    rows = None
    for name in running:
        count = F.count(F.lit(1))
        row = running[name].agg(F.lit(name).alias("operator"), count.alias("running"))
        row = row.withColumn("paused", paused[name].agg(count).scalar())
        rows = row if rows is None else rows.unionByName(row)
    return rows
