"""Registered queries: anomaly records, groups, transitions and re-checks."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.functions.values import canonical_json, fingerprint, ntz_micros
from tidewatch.operators import anomalies as A
from tidewatch.operators import groups as G
from tidewatch.operators import lifecycle as L
from tidewatch.operators.conditions import Condition
from tidewatch.operators.due import DueIndex, deadlines
from tidewatch.operators.recheck import recheck, result_events, store_results
from tidewatch.operators.rule_state import RecordStore, newest_version
from tidewatch.operators.rules import Rule, Target, evaluate
from tidewatch.plans.derived import NOW, ctes, frame, record_frame
from tidewatch.plans.registry import query
from tidewatch.session import materialise, scratch_dir, table
from tidewatch.streaming.tables import KeyedTable

ORDER = ["ts", "event_id"]
KEYS = ["event_type", "user_id"]
RULE = Rule("high-value", [Condition("value", "gt", 20)], KEYS, name="High value", dataset_name="events", severity="high")
RUN_1, RUN_2 = "2024-01-15 00:00:00", "2024-01-31 00:00:00"
KEY_SQL = """'{"event_type":"' || event_type || '","user_id":' || user_id || '}'"""


def events(spark, sf):
    return table(spark, sf, "events")


def halves(spark, sf):
    """The events seen by a first and a second run."""
    df = events(spark, sf)
    border = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return df.filter(F.col("ts") < border), df.filter(F.col("ts") >= border)


def run(spark, records, df, run_id, now, rule=RULE):
    """Folded matches and merged records of a run, both written out as a real run does."""
    folded = materialise(A.fold_matches(A.occurrence_keys(evaluate(df, rule, ORDER), rule, run_id, now, ORDER), ORDER), "folded")
    return materialise(A.merge_matches(records, folded, rule, run_id, now), "records"), folded


def state(merged):
    return merged.drop("is_new", "is_hit", "hit_fp")


@query("a1_fingerprint", f"SELECT DISTINCT {KEY_SQL} AS business_key, sha256({KEY_SQL}) AS fingerprint FROM events")
def a1(spark, sf):
    df = events(spark, sf)
    keyed = df.select(canonical_json(df, ["user_id", "event_type"]).alias("business_key")).distinct()
    return keyed.select("business_key", fingerprint(F.col("business_key")).alias("fingerprint"))


@query(
    "a2_in_run_folding",
    f"""SELECT {KEY_SQL} AS business_key, count(*) AS run_hits, arg_min(event_id, (ts, event_id)) AS first_event,
        arg_max(event_id, (ts, event_id)) AS last_event FROM events WHERE value > 20 GROUP BY event_type, user_id""",
)
def a2(spark, sf):
    folded = A.fold_matches(evaluate(events(spark, sf), RULE, ORDER), ORDER)
    return folded.select(
        "business_key", "run_hits", F.col("first_row.event_id").alias("first_event"),
        F.get_json_object("row_details", "$.event_id").cast("bigint").alias("last_event"),
    )


A3_SQL = f"""WITH m AS (SELECT *, {KEY_SQL} AS k, ts < TIMESTAMP '2024-01-15' AS early FROM events WHERE value > 20),
        g AS (SELECT k, sum(CASE WHEN early THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN early THEN 0 ELSE 1 END) AS n2 FROM m GROUP BY k)
        SELECT k AS business_key, n1 + n2 AS hit_count, n1 = 0 AS is_new, n2 > 0 AS is_hit,
          CASE WHEN n1 > 0 THEN '{RUN_1}' ELSE '{RUN_2}' END AS first_seen, CASE WHEN n2 > 0 THEN '{RUN_2}' ELSE '{RUN_1}' END AS last_seen
        FROM g"""


@query("a3_match_merge", A3_SQL)
def a3(spark, sf):
    early, late = halves(spark, sf)
    first, _ = run(spark, A.empty_records(spark), early, "run-1", RUN_1)
    second, _ = run(spark, state(first), late, "run-2", RUN_2)
    return second.select(
        "business_key", "hit_count", "is_new", "is_hit", F.col("first_seen_at").cast("string").alias("first_seen"),
        F.col("last_seen_at").cast("string").alias("last_seen"),
    )


@query("a3_match_merge_stored", A3_SQL)
def a3_stored(spark, sf):
    """Two runs of the rule on stored records; a run of another rule in between leaves them alone."""
    store = RecordStore(spark, f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}", buckets=4)
    early, late = halves(spark, sf)
    store.run(early, RULE, ORDER, "run-1", datetime.fromisoformat(RUN_1))
    store.run(late, replace(RULE, rule_id="another rule"), ORDER, "run-2", datetime.fromisoformat(RUN_1))
    touched = store.run(late, RULE, ORDER, "run-2", datetime.fromisoformat(RUN_2))
    records = store.of_rule(RULE.rule_id).join(touched.select("id", "is_new", "is_hit"), "id", "left")
    return records.select(
        "business_key", F.col("hit_count").alias("hit_count"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_new", "is_hit")],
        F.col("first_seen_at").cast("string").alias("first_seen"), F.col("last_seen_at").cast("string").alias("last_seen"),
    )


@query(
    "a4_realert_after_resolve",
    f"""WITH m AS (SELECT *, {KEY_SQL} AS k, ts < TIMESTAMP '2024-01-15' AS early FROM events WHERE value > 20),
        g AS (SELECT k, event_type = 'error' AS solved, sum(CASE WHEN early THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN early THEN 0 ELSE 1 END) AS n2
              FROM m GROUP BY k, event_type)
        SELECT k AS business_key, 'resolved' AS status, n1 AS hit_count FROM g WHERE solved AND n1 > 0
        UNION ALL SELECT k, 'pending', n2 FROM g WHERE solved AND n2 > 0
        UNION ALL SELECT k, 'pending', n1 + n2 FROM g WHERE NOT solved""",
)
def a4(spark, sf):
    early, late = halves(spark, sf)
    first, _ = run(spark, A.empty_records(spark), early, "run-1", RUN_1)
    records = state(first)
    solved = records.filter(F.col("business_key").contains('"event_type":"error"')).select(
        "id", F.lit("resolved").alias("target_status"), F.lit("manual").alias("source"), F.lit("admin").alias("user_id")
    )
    records = L.apply_transitions(records, L.decide_transitions(records, solved), RUN_1)
    second, _ = run(spark, records, late, "run-2", RUN_2)
    return second.select("business_key", "status", "hit_count")


@query(
    "a5_repeat_occurrences",
    """SELECT event_type, user_id, count(*) AS occurrences, count(*) AS fingerprints, count(*) AS new_records
       FROM events WHERE value > 60 GROUP BY event_type, user_id""",
)
def a5(spark, sf):
    rule = Rule("each", [Condition("value", "gt", 60)], KEYS, repeat_push_enabled=True)
    merged, _ = run(spark, A.empty_records(spark), events(spark, sf), "run-1", RUN_1, rule)
    return merged.groupBy(
        F.get_json_object("business_key", "$.event_type").alias("event_type"),
        F.get_json_object("business_key", "$.user_id").cast("bigint").alias("user_id"),
    ).agg(
        F.sum("hit_count").alias("occurrences"), F.count_distinct("fingerprint").alias("fingerprints"),
        F.count_if("is_new").alias("new_records"),
    )


@query(
    "a7_event_log",
    f"""SELECT {KEY_SQL} AS business_key, 'detected' AS event_type, '规则首次检出异常' AS description, '{RUN_1}' AS created_at
        FROM events WHERE value > 20 GROUP BY event_type, user_id
        UNION ALL SELECT {KEY_SQL}, 'status_changed', '状态更新为 processing', '{RUN_2}'
        FROM events WHERE value > 20 AND event_type = 'view' GROUP BY event_type, user_id""",
)
def a7(spark, sf):
    merged, _ = run(spark, A.empty_records(spark), events(spark, sf), "run-1", RUN_1)
    records = state(merged)
    wishes = records.filter(F.col("business_key").contains('"event_type":"view"')).select(
        "id", F.lit("processing").alias("target_status"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("user_id")
    )
    log = A.detected_events(merged, RUN_1).unionByName(L.status_events(L.decide_transitions(records, wishes), RUN_2))
    named = records.select(F.col("id").alias("anomaly_id"), "business_key")
    return log.join(named, "anomaly_id").select(
        "business_key", "event_type", "description", F.col("created_at").cast("string").alias("created_at")
    )


def recipients(spark, sf):
    """One row per event with the row fields a target may point at."""
    owner = F.when(F.col("event_type") == "view", F.lit("  ")).when(F.col("event_type") == "error", F.lit(None)).otherwise(
        F.concat(F.lit(" u"), (F.col("user_id") % 5).cast("string"), F.lit(" "))
    )
    helper = F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))
    return events(spark, sf).select(
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("id"),
        F.struct(owner.alias("owner"), helper.alias("helper"), "user_id").alias("first_row"),
    )


ROWS_SQL = """r AS (SELECT concat('a', event_id) AS anomaly_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN NULL
   ELSE concat('u', user_id % 5) END AS owner, concat('u', user_id % 3) AS helper FROM events)"""
TARGETS = [
    Target("literal", value="u1"),
    Target("field", field="owner"),
    Target("field", field="helper"),
    Target("literal", value="chat-1", receive_id_type="chat_id"),
]


@query(
    "a8_notification_targets",
    f"""WITH {ROWS_SQL} SELECT DISTINCT anomaly_id, t AS receive_id_type, v AS recipient FROM (
        SELECT anomaly_id, 'user_id' AS t, 'u1' AS v FROM r UNION ALL SELECT anomaly_id, 'user_id', owner FROM r
        UNION ALL SELECT anomaly_id, 'user_id', helper FROM r UNION ALL SELECT anomaly_id, 'chat_id', 'chat-1' FROM r) WHERE v IS NOT NULL""",
)
def a8(spark, sf):
    return A.notification_targets(recipients(spark, sf), TARGETS).drop("place")


@query(
    "a9_validation_targets",
    f"""WITH {ROWS_SQL} SELECT anomaly_id, v AS recipient_user_id, min(p) AS rank FROM (
        SELECT anomaly_id, owner AS v, 0 AS p FROM r UNION ALL SELECT anomaly_id, helper, 1 FROM r) WHERE v IS NOT NULL GROUP BY 1, 2""",
)
def a9(spark, sf):
    targets = [Target("field", field="owner"), Target("unknown", value="nobody"), Target("field", field="helper")]
    found = A.validation_targets(recipients(spark, sf), targets)
    owners = recipients(spark, sf).select(F.col("id").alias("anomaly_id"), F.trim("first_row.owner").alias("owner"))
    rank = F.when(F.col("recipient_user_id") == F.col("owner"), 0).otherwise(1)
    return found.join(owners, "anomaly_id").select("anomaly_id", "recipient_user_id", rank.alias("rank"))


@query(
    "a10_requests_replace_notifications",
    f"""WITH {ROWS_SQL},
        asked AS (SELECT DISTINCT anomaly_id, owner AS u FROM r WHERE owner IS NOT NULL),
        had AS (SELECT DISTINCT anomaly_id, owner AS u FROM r WHERE owner = 'u1')
        SELECT anomaly_id, 'request' AS kind, u AS recipient FROM asked WHERE (anomaly_id, u) NOT IN (SELECT anomaly_id, u FROM had)
        UNION ALL SELECT DISTINCT anomaly_id, 'notification', helper FROM r WHERE owner IS DISTINCT FROM helper""",
)
def a10(spark, sf):
    rows = recipients(spark, sf)
    wanted = A.validation_targets(rows, [Target("field", field="owner")])
    existing = wanted.filter(F.col("recipient_user_id") == "u1").select("anomaly_id", "recipient_user_id")
    requests = A.new_requests(wanted, existing, RUN_1)
    plain = A.new_notifications(A.notification_targets(rows, [Target("field", field="helper")]), wanted)
    return requests.select("anomaly_id", F.lit("request").alias("kind"), F.col("recipient_user_id").alias("recipient")).unionByName(
        plain.select("anomaly_id", F.lit("notification").alias("kind"), "recipient")
    )


@query(
    "a11_config_snapshot",
    ctes("records")
    + """ SELECT id, CASE WHEN validation_method_snapshot IS NULL THEN 'checked by query' ELSE description END AS description, 'sql' AS method,
        CASE WHEN validation_method_snapshot IS NULL THEN 'src-1' ELSE json_extract_string(validation_config_snapshot, '$.datasource_id') END AS datasource_id,
        CASE WHEN validation_method_snapshot IS NULL THEN '["event_id","value"]' END AS dataset_fields FROM records""",
)
def a11(spark, sf):
    rule = Rule(
        "r", [Condition("value", "gt", 1)], ["event_id"], description="checked by query", validation_enabled=True,
        validation_method="sql", dataset_datasource_id="src-1",
    )
    out = A.snapshot_validation(record_frame(spark, sf), rule, ["event_id", "value"], F.lit(True))
    config = F.col("validation_config_snapshot")
    return out.select(
        "id", "description", F.col("validation_method_snapshot").alias("method"),
        F.get_json_object(config, "$.datasource_id").alias("datasource_id"),
        F.get_json_object(config, "$.dataset_fields").alias("dataset_fields"),
    )


@query(
    "a12_run_group_members",
    f"""WITH m AS (SELECT {KEY_SQL} AS k, min((ts, event_id)) AS first, max(ts) >= TIMESTAMP '2024-01-15' AS hit, min(ts) >= TIMESTAMP '2024-01-15' AS fresh,
          min((ts, event_id)) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS first_late FROM events WHERE value > 20 GROUP BY event_type, user_id)
        SELECT k AS business_key, row_number() OVER (ORDER BY first_late) - 1 AS position, fresh AS is_new FROM m WHERE hit""",
)
def a12(spark, sf):
    early, late = halves(spark, sf)
    first, _ = run(spark, A.empty_records(spark), early, "run-1", RUN_1)
    second, folded = run(spark, state(first), late, "run-2", RUN_2)
    members = G.group_members(second, folded, RULE, RUN_2)
    named = second.select(F.col("id").alias("anomaly_id"), "business_key")
    return members.join(named, "anomaly_id").select("business_key", "position", "is_new")


@query(
    "a13_unique_group_times",
    """WITH r AS (SELECT event_type AS rule_id, event_id AS run_id, epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS base FROM events)
       SELECT rule_id, CAST(run_id AS VARCHAR) AS run_id, base + row_number() OVER (PARTITION BY rule_id, base ORDER BY CAST(run_id AS VARCHAR)) - 1 AS at_us FROM r""",
)
def a13(spark, sf):
    runs = events(spark, sf).select(
        F.col("event_type").alias("rule_id"), F.col("event_id").cast("string").alias("run_id"),
        F.col("ts").cast("date").cast("timestamp_ntz").alias("detected_at"),
    )
    return G.unique_times(runs).select("rule_id", "run_id", ntz_micros(F.col("detected_at")).alias("at_us"))


@query(
    "a14_group_deadline",
    ctes("records", "members", "groups")
    + """ SELECT g.run_id, CASE WHEN g.timeout_enabled THEN CAST(max(r.validation_deadline) AS VARCHAR) END AS timeout_deadline
        FROM groups g LEFT JOIN members m ON m.rule_id = g.rule_id AND m.detected_at = g.detected_at AND m.is_new
        LEFT JOIN records r ON r.id = m.anomaly_id GROUP BY g.run_id, g.timeout_enabled""",
)
def a14(spark, sf):
    out = G.group_deadlines(frame(spark, sf, "groups"), frame(spark, sf, "members"), record_frame(spark, sf))
    return out.select("run_id", F.col("timeout_deadline").cast("string").alias("timeout_deadline"))


WISHES_SQL = """w AS (SELECT id, status, CASE user_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'timed_out' WHEN 3 THEN 'resolved'
   WHEN 4 THEN 'resolved' ELSE 'closed' END AS target, CASE WHEN user_id % 6 = 3 THEN 'manual' END AS source FROM records)"""


def wishes(records):
    slot = F.col("user_id") % 6
    target = F.when(slot == 0, "pending").when(slot == 1, "processing").when(slot == 2, "timed_out").when(slot.isin(3, 4), "resolved").otherwise("closed")
    return records.select(
        "id", target.alias("target_status"), F.when(slot == 3, "manual").alias("source"), F.lit(" admin ").alias("user_id")
    )


@query(
    "a15_status_transitions",
    ctes("records")
    + f""", {WISHES_SQL}, d AS (SELECT *, CASE WHEN target = 'closed' THEN 'unknown_status' WHEN target = 'timed_out' THEN 'system_only'
          WHEN target = 'resolved' AND source IS NULL THEN 'needs_known_user'
          WHEN target = 'pending' AND status IN ('processing', 'pending') THEN NULL WHEN target = 'processing' AND status IN ('pending', 'processing') THEN NULL
          WHEN target = 'resolved' THEN NULL WHEN status = 'resolved' THEN 'already_resolved'
          WHEN status = 'timed_out' THEN 'timed_out_needs_resolution' ELSE 'other' END AS reason FROM w)
        SELECT id, status AS current_status, target AS target_status, reason,
          CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN status = target THEN 'noop' ELSE 'changed' END AS outcome FROM d""",
)
def a15(spark, sf):
    records = record_frame(spark, sf)
    return L.decide_transitions(records, wishes(records)).select("id", "current_status", "target_status", "reason", "outcome")


@query(
    "a16_bulk_status",
    ctes("records")
    + f""" SELECT 'resolved' AS status,
        CASE WHEN status <> 'resolved' THEN 'admin' END AS resolver, CASE WHEN bool_or(status <> 'resolved') THEN '{NOW}' ELSE CAST(max(last_seen_at) AS VARCHAR) END AS resolved_at,
        count(*) AS n, 0 AS active FROM records GROUP BY 1, 2, status = 'resolved'""",
)
def a16(spark, sf):
    records = record_frame(spark, sf)
    ids = records.filter(F.col("status") != "resolved").select("id")
    after, _ = L.bulk_transition(records, ids.unionAll(ids), "resolved", "admin", NOW)
    return after.groupBy("status", F.col("resolved_by_user_id").alias("resolver")).agg(
        F.max("resolved_at").cast("string").alias("resolved_at"), F.count("*").alias("n"),
        F.count("active_fingerprint").alias("active"),
    )


@query(
    "a17_start_deadline",
    ctes("records", "notifications", "requests")
    + """, f AS (SELECT anomaly_id, min(sent_at) AS first FROM (SELECT anomaly_id, updated_at AS sent_at FROM notifications WHERE status = 'sent'
          UNION ALL SELECT anomaly_id, updated_at FROM requests WHERE delivery_status = 'sent') GROUP BY anomaly_id)
        SELECT r.id, CAST(f.first AS VARCHAR) AS first_delivered_at, CAST(f.first + to_seconds(r.deadline_seconds_snapshot) AS VARCHAR) AS validation_deadline
        FROM records r JOIN f ON f.anomaly_id = r.id WHERE r.deadline_seconds_snapshot IS NOT NULL AND r.validation_deadline IS NULL AND r.status IN ('pending', 'processing')""",
)
def a17(spark, sf):
    sent = frame(spark, sf, "notifications").filter("status = 'sent'").select("anomaly_id", F.col("updated_at").alias("delivered_at"))
    asked = frame(spark, sf, "requests").filter("delivery_status = 'sent'").select("anomaly_id", F.col("updated_at").alias("delivered_at"))
    out = L.start_deadlines(record_frame(spark, sf), sent.unionAll(asked))
    return out.filter(F.col("first_delivered_at").isNotNull()).select(
        "id", F.col("first_delivered_at").cast("string").alias("first_delivered_at"),
        F.col("validation_deadline").cast("string").alias("validation_deadline"),
    )


A18_SQL = (
    ctes("records")
    + f""" SELECT id, 'timed_out' AS status, '{NOW}' AS timed_out_at, 'validation_timed_out' AS event_type FROM records
        WHERE status IN ('pending', 'processing') AND validation_deadline <= TIMESTAMP '{NOW}'"""
)


# Rows of a stored part, which one task writes.
PART_ROWS = 100_000


@query("a18_expire_due", A18_SQL)
def a18(spark, sf):
    after, log = L.expire(record_frame(spark, sf).drop("event_type"), NOW)
    return log.join(after, F.col("anomaly_id") == F.col("id")).select(
        "id", "status", F.col("timed_out_at").cast("string").alias("timed_out_at"), "event_type"
    )


@query("a18_expire_due_indexed", A18_SQL)
def a18_indexed(spark, sf):
    """Deadlines from an index by day, the records looked up in their buckets and put back timed out."""
    folder = f"{scratch_dir(spark)}/due-{uuid.uuid4().hex}"
    records = record_frame(spark, sf).drop("event_type")
    first = materialise(records.withColumn("version", F.lit(0)), "records")
    stored = KeyedTable(spark, f"{folder}/records", ["id"], newest_version, buckets=max(8, first.count() // PART_ROWS))
    stored.merge(first)
    index = DueIndex(spark, f"{folder}/deadlines", 86_400)
    index.change(None, deadlines(records))
    due = index.due(NOW)
    after, log = L.expire(stored.lookup(due.select("id")).drop("version"), NOW)
    after = materialise(after, "expired")
    stored.merge(after.withColumn("version", F.lit(1)))
    index.change(due, deadlines(after))
    now_out = stored.read().filter("version = 1")
    return log.join(now_out, F.col("anomaly_id") == F.col("id")).select(
        "id", "status", F.col("timed_out_at").cast("string").alias("timed_out_at"), "event_type"
    )


@query(
    "a18_expire_due_batch",
    ctes("records")
    + f""" SELECT id, CAST(validation_deadline AS VARCHAR) AS validation_deadline FROM records
        WHERE status IN ('pending', 'processing') AND validation_deadline <= TIMESTAMP '{NOW}' ORDER BY records.validation_deadline, id LIMIT 50""",
)
def a18_batch(spark, sf):
    due = L.due_records(record_frame(spark, sf), NOW, 50)
    return due.select("id", F.col("validation_deadline").cast("string").alias("validation_deadline"))


SUBMISSIONS_SQL = """s AS (SELECT event_id AS submission_id, concat('a', user_id) AS anomaly_id, concat('u', event_id % 4) AS user_id,
    trim(CASE WHEN event_type = 'view' THEN '   ' ELSE concat(' ', props, ' ') END) AS text, ts AS submitted_at FROM events),
  asked AS (SELECT DISTINCT concat('a', user_id) AS anomaly_id, concat('u', n) AS user_id FROM events, range(3) t(n)),
  had AS (SELECT DISTINCT concat('a', user_id) AS anomaly_id, 'u2' AS holder FROM events WHERE user_id % 10 = 4)"""


def submissions(spark, sf):
    text = F.when(F.col("event_type") == "view", "   ").otherwise(F.concat(F.lit(" "), F.col("props"), F.lit(" ")))
    df = events(spark, sf)
    owner = F.concat(F.lit("a"), F.col("user_id").cast("string"))
    rows = df.select(
        F.col("event_id").alias("submission_id"), owner.alias("anomaly_id"),
        F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string")).alias("user_id"), text.alias("text"), F.col("ts").alias("submitted_at"),
    )
    keys = df.select(owner.alias("anomaly_id"), F.col("user_id").alias("n")).distinct()
    asked = keys.select("anomaly_id", F.explode(F.array(F.lit("u0"), F.lit("u1"), F.lit("u2"))).alias("recipient_user_id"))
    had = keys.filter(F.col("n") % 10 == 4).select("anomaly_id", F.lit("u2").alias("submitted_by_user_id"))
    return rows, asked, had


@query(
    "a19_first_wins_submission",
    ctes("records")
    + f""", {SUBMISSIONS_SQL},
        v AS (SELECT s.*, r.status, h.holder, CASE WHEN length(text) < 1 OR length(text) > 1000 THEN 'invalid_text' WHEN r.id IS NULL THEN 'unknown_record'
                WHEN a.user_id IS NULL THEN 'not_recipient' END AS problem
              FROM s LEFT JOIN records r ON r.id = s.anomaly_id LEFT JOIN asked a ON a.anomaly_id = s.anomaly_id AND a.user_id = s.user_id
              LEFT JOIN had h ON h.anomaly_id = s.anomaly_id),
        w AS (SELECT anomaly_id, arg_min(submission_id, (submitted_at, submission_id)) AS win, arg_min(user_id, (submitted_at, submission_id)) AS winner
              FROM v WHERE problem IS NULL AND status <> 'resolved' AND holder IS NULL GROUP BY anomaly_id)
        SELECT v.submission_id, v.anomaly_id, v.user_id, CASE WHEN problem IS NOT NULL THEN problem WHEN w.win = v.submission_id THEN 'accepted'
          WHEN coalesce(v.holder, w.winner) = v.user_id THEN 'duplicate' ELSE 'already_resolved' END AS outcome
        FROM v LEFT JOIN w ON w.anomaly_id = v.anomaly_id""",
)
def a19(spark, sf):
    rows, asked, had = submissions(spark, sf)
    return L.judge_submissions(record_frame(spark, sf), asked, had, rows).select("submission_id", "anomaly_id", "user_id", "outcome")


@query(
    "a19_resolved_by_submission",
    ctes("records")
    + f""", {SUBMISSIONS_SQL}, ok AS (SELECT s.* FROM s JOIN records r ON r.id = s.anomaly_id AND r.status <> 'resolved'
             JOIN asked a ON a.anomaly_id = s.anomaly_id AND a.user_id = s.user_id WHERE length(text) BETWEEN 1 AND 1000
             AND s.anomaly_id NOT IN (SELECT anomaly_id FROM had))
        SELECT anomaly_id AS id, 'resolved' AS status, 'validation' AS resolution_source, arg_min(user_id, (submitted_at, submission_id)) AS resolved_by_user_id,
          CAST(min(submitted_at) AS VARCHAR) AS resolved_at FROM ok GROUP BY anomaly_id""",
)
def a19_resolved(spark, sf):
    rows, asked, had = submissions(spark, sf)
    records = record_frame(spark, sf)
    accepted = L.accepted_submissions(L.judge_submissions(records, asked, had, rows))
    after = L.resolve_submitted(records, accepted)
    return after.filter("resolution_source = 'validation'").select(
        "id", "status", "resolution_source", "resolved_by_user_id", F.col("resolved_at").cast("string").alias("resolved_at")
    )


CHECK = Condition("l_quantity", "gt", 25)


def order_check(spark, sf):
    found = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", "o_orderstatus")
    check = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    return found, check


CHECK_SQL = """c AS (SELECT l_orderkey, count(*) AS n, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
  v AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN n IS NULL THEN 'no_rows' WHEN n > 1 THEN 'multiple_rows' WHEN q > 25 THEN 'condition_passed' ELSE 'condition_failed' END AS reason,
    CASE WHEN n = 1 THEN q END AS actual FROM orders LEFT JOIN c ON l_orderkey = o_orderkey)"""


@query("a20_sql_recheck", f"WITH {CHECK_SQL} SELECT id, reason, reason = 'condition_passed' AS passed, actual FROM v")
def a20(spark, sf):
    found, check = order_check(spark, sf)
    out = recheck(found, check, {"l_orderkey": "o_orderkey"}, CHECK)
    return out.select("id", "reason", "passed", F.col("actual").cast("double").alias("actual"))


@query(
    "a20_recheck_missing_field",
    f"WITH {CHECK_SQL} SELECT CASE WHEN reason LIKE 'condition%' THEN 'missing_field' ELSE reason END AS reason, count(*) AS n FROM v GROUP BY 1",
)
def a20_missing(spark, sf):
    found, check = order_check(spark, sf)
    out = recheck(found, check, {"l_orderkey": "o_orderkey"}, Condition("temperature", "gt", 1))
    return out.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "a22_recheck_results",
    f"""WITH {CHECK_SQL} SELECT id, CASE WHEN reason = 'condition_passed' THEN 'resolved' ELSE 'pending' END AS status, reason, 1 AS version,
        CASE WHEN reason = 'condition_passed' THEN 'passed' ELSE 'failed' END AS outcome,
        CASE WHEN reason = 'condition_passed' THEN 'validation_resolved' ELSE 'sql_validation_failed' END AS event_type FROM v""",
)
def a22(spark, sf):
    found, check = order_check(spark, sf)
    results = recheck(found, check, {"l_orderkey": "o_orderkey"}, CHECK)
    blank = A.empty_records(spark)
    held = {"id": F.col("id"), "status": F.lit("pending"), "validation_result_version": F.lit(0), "active_fingerprint": F.col("id")}
    records = found.select(*[held.get(c, F.lit(None)).cast(blank.schema[c].dataType).alias(c) for c in blank.columns])
    after = store_results(records, results, CHECK, "u1", NOW)
    log = result_events(results, CHECK, "u1", NOW).select("anomaly_id", "event_type")
    last = F.col("last_sql_validation_result")
    return after.join(log, F.col("anomaly_id") == F.col("id")).select(
        "id", "status", F.get_json_object(last, "$.reason").alias("reason"), F.col("validation_result_version").alias("version"),
        F.get_json_object(last, "$.outcome").alias("outcome"), "event_type",
    )


@query(
    "a23_severity_merge",
    "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'low' END AS severity, count(*) AS n FROM orders GROUP BY 1",
)
def a23(spark, sf):
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("low")
    return L.merge_severities(table(spark, sf, "orders").withColumn("severity", level)).groupBy("severity").agg(F.count("*").alias("n"))


@query("a24_deadline_backfill", "SELECT p_partkey, p_size AS minutes, p_size * 60 AS deadline_seconds FROM part")
def a24(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("minutes"))
    return L.minutes_to_seconds(parts, "minutes", "deadline_seconds")


@query(
    "a25_notified_at_backfill",
    ctes("members", "groups")
    + """ SELECT m.anomaly_id, CAST(CASE WHEN g.timeout_processed_at IS NOT NULL THEN g.timeout_processed_at ELSE m.timeout_notified_at END AS VARCHAR) AS timeout_notified_at
        FROM members m LEFT JOIN groups g ON g.rule_id = m.rule_id AND g.detected_at = m.detected_at""",
)
def a25(spark, sf):
    out = L.fill_notified_at(frame(spark, sf, "members"), frame(spark, sf, "groups"))
    return out.select("anomaly_id", F.col("timeout_notified_at").cast("string").alias("timeout_notified_at"))


@query(
    "a26_method_backfill",
    ctes("records")
    + """ SELECT CASE WHEN validation_deadline IS NOT NULL AND validation_method_snapshot IS NULL THEN 'pseudo' ELSE validation_method_snapshot END AS method, count(*) AS n
        FROM records GROUP BY 1""",
)
def a26(spark, sf):
    out = L.fill_method(record_frame(spark, sf))
    return out.groupBy(F.col("validation_method_snapshot").alias("method")).agg(F.count("*").alias("n"))
