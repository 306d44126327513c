"""State tables derived from the dataset tables, as SQL both engines read.

The anomaly platform's own tables are computed from ``events`` (and small
dimension tables) so that registered queries grow with the data they are given.
``NTZ`` stands for the engine's type name of a time without zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.anomalies import EVIDENCE
from tidewatch.session import table

NOW = "2024-01-16 00:00:00"
GENERATION = 2

_PICK = "CAST(floor(value * {times}) AS BIGINT) % {count}"


def _cases(times: int, names: list[str]) -> str:
    """A name per row, chosen by the event's value."""
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {_PICK.format(times=times, count=len(names))} {whens} END"


_JOB_STATUSES = [
    "pending_publish", "publishing", "kafka_queued", "dispatching", "ds_scheduled", "executing", "sending", "sent",
    "failed", "uncertain", "aborted",
]
_SENDING = ["pending", "failed", "sending", "sent", "uncertain", "aborted"]
_REQUESTS = ["pending", "failed", "sending", "sent", "resolved", "timed_out", "update_failed", "uncertain", "aborted"]

TABLES = {
    "records": f"""SELECT concat('a', CAST(event_id AS STRING)) AS id, concat('rule-', event_type) AS rule_id,
        concat('Rule ', event_type) AS rule_name, concat('Dataset_', CAST(user_id % 10 AS STRING)) AS dataset_name,
        {_cases(1, ["high", "medium", "low"])} AS severity,
        {_cases(10, ["processing", "timed_out", "resolved", "pending", "pending"])} AS status,
        'found by rule' AS description, concat('fp-', CAST(event_id AS STRING)) AS fingerprint,
        CASE WHEN CAST(floor(value * 10) AS BIGINT) % 5 <> 2 THEN concat('fp-', CAST(event_id AS STRING)) END AS active_fingerprint,
        concat('{{"event_id":', CAST(event_id AS STRING), '}}') AS business_key,
        concat('{{"event_type":"', event_type, '","owner":"u', CAST(user_id AS STRING), '","user_id":', CAST(user_id AS STRING), '}}') AS row_details,
        1 AS hit_count, ts AS first_seen_at, ts + INTERVAL 30 MINUTE AS last_seen_at,
        CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 12 HOUR END AS validation_deadline,
        CASE WHEN user_id % 4 <> 1 THEN 3600 * (1 + user_id % 5) END AS deadline_seconds_snapshot,
        user_id % 3 AS validation_result_version,
        CASE WHEN user_id % 6 = 0 THEN 'sql' END AS validation_method_snapshot,
        concat('{{"datasource_id":"src-', CAST(user_id % 40 AS STRING), '"}}') AS validation_config_snapshot,
        user_id, event_type, value FROM events""",
    "jobs": f"""SELECT concat('j', CAST(event_id AS STRING)) AS id,
        CASE WHEN event_type <> 'view' THEN concat('a', CAST(event_id AS STRING)) END AS anomaly_id,
        CASE event_type WHEN 'view' THEN 'group_broadcast' WHEN 'click' THEN 'notification' WHEN 'signup' THEN 'notification' ELSE 'validation' END AS kind,
        concat('d', CAST(event_id AS STRING)) AS delivery_id, CASE WHEN value < 8 THEN 1 ELSE 2 END AS generation,
        {_cases(100, _JOB_STATUSES)} AS status, user_id % 7 = 0 AS cancel_requested, user_id % 3 AS publish_attempts,
        user_id % 12 AS dispatch_attempts, CASE WHEN user_id % 2 = 0 THEN ts + INTERVAL 10 MINUTE END AS next_attempt_at,
        ts AS created_at, ts + INTERVAL 5 MINUTE AS updated_at FROM events""",
    "notifications": f"""SELECT concat('d', CAST(event_id AS STRING)) AS id, concat('a', CAST(event_id AS STRING)) AS anomaly_id,
        CASE WHEN user_id % 2 = 0 THEN 'user_id' ELSE 'open_id' END AS receive_id_type, concat('u', CAST(user_id AS STRING)) AS recipient,
        {_cases(7, _SENDING)} AS status, user_id % 8 AS attempts, ts + INTERVAL 3 MINUTE AS updated_at
        FROM events WHERE event_type IN ('click', 'signup')""",
    "requests": f"""SELECT concat('d', CAST(event_id AS STRING)) AS id, concat('a', CAST(event_id AS STRING)) AS anomaly_id,
        concat('u', CAST(user_id AS STRING)) AS recipient_user_id, {_cases(7, _REQUESTS)} AS delivery_status,
        user_id % 5 AS delivery_attempts, user_id % 14 AS consecutive_failures,
        CASE WHEN user_id % 3 <> 0 THEN ts + INTERVAL 1 MINUTE END AS send_started_at,
        CASE WHEN user_id % 4 = 0 THEN ts + INTERVAL 20 MINUTE END AS next_attempt_at,
        ts AS created_at, ts + INTERVAL 2 MINUTE AS updated_at, CASE WHEN user_id % 5 <> 0 THEN concat('m', CAST(event_id AS STRING)) END AS message_id,
        user_id % 2 AS synced_result_version FROM events WHERE event_type IN ('error', 'purchase')""",
    "broadcasts": f"""SELECT concat('d', CAST(event_id AS STRING)) AS id, concat('rule-', event_type) AS rule_id,
        CAST(CAST(ts AS DATE) AS NTZ) AS detected_at, 1 AS part_index,
        CASE WHEN user_id % 3 = 0 THEN 'timeout' ELSE 'situation' END AS broadcast_kind, user_id % 4 AS round_index, 1 AS total_parts,
        {_cases(7, _SENDING)} AS status, user_id % 8 AS attempts,
        CASE WHEN user_id % 4 = 0 THEN ts + INTERVAL 20 MINUTE END AS next_attempt_at, ts + INTERVAL 4 MINUTE AS updated_at
        FROM events WHERE event_type = 'view'""",
    "members": """SELECT concat('rule-', event_type) AS rule_id, CAST(CAST(ts AS DATE) AS NTZ) AS detected_at,
        concat('a', CAST(event_id AS STRING)) AS anomaly_id, event_id AS position, user_id % 2 = 0 AS is_new,
        CASE WHEN user_id % 5 = 0 THEN ts END AS timeout_notified_at FROM events""",
    "groups": """SELECT concat('rule-', event_type) AS rule_id, CAST(CAST(ts AS DATE) AS NTZ) AS detected_at,
        concat('run-', event_type, '-', CAST(CAST(ts AS DATE) AS STRING)) AS run_id, concat('Rule ', event_type) AS rule_name,
        count(*) + 100 AS scanned_rows, count(*) AS matched_rows, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS new_anomalies,
        event_type <> 'error' AS broadcast_enabled, event_type <> 'view' AS timeout_enabled,
        CASE WHEN event_type <> 'signup' THEN 'https://hooks.example/t' END AS timeout_webhook,
        CASE WHEN extract(DAY FROM CAST(ts AS DATE)) % 6 = 0 THEN CAST(CAST(ts AS DATE) AS NTZ) + INTERVAL 2 DAY END AS timeout_processed_at
        FROM events GROUP BY event_type, CAST(ts AS DATE)""",
    "rules": """SELECT concat('rule-', event_type) AS id, concat('Rule ', event_type) AS name,
        concat('ds-', CAST(length(event_type) % 5 AS STRING)) AS dataset_id, event_type <> 'view' AS enabled, CAST(NULL AS NTZ) AS deleted_at,
        CASE WHEN event_type = 'error' THEN 'sql' END AS validation_method, '{"datasource_id":"SRC-7"}' AS sql_validation_config
        FROM (SELECT DISTINCT event_type FROM events) t
        UNION ALL
        SELECT concat('rule-', n_name), concat('Rule ', n_name), concat('ds-', CAST(n_regionkey AS STRING)), n_nationkey % 2 = 0,
        CASE WHEN n_nationkey % 6 = 0 THEN CAST('2024-01-01 00:00:00' AS NTZ) END, CASE WHEN n_nationkey % 4 = 1 THEN 'sql' END,
        concat('{"datasource_id":"SRC-', CAST(n_nationkey AS STRING), '"}') FROM nation""",
    "datasets": """SELECT concat('ds-', CAST(r_regionkey AS STRING)) AS id, r_name AS name, concat('data of ', lower(r_name)) AS description,
        concat('src-', CAST(r_regionkey * 3 AS STRING)) AS datasource_id, 1000 * (r_regionkey + 1) AS row_count,
        CASE WHEN r_regionkey % 2 = 0 THEN CAST('2024-01-16 09:00:00' AS NTZ) ELSE CAST('2024-01-10 09:00:00' AS NTZ) END AS updated_at FROM region""",
    "sources": """SELECT concat('SRC-', CAST(s_suppkey AS STRING)) AS id, s_name AS name,
        CASE WHEN s_acctbal > 1000 THEN 'online' ELSE 'offline' END AS status FROM supplier""",
}

_BASE = ("events", "nation", "region", "supplier")


def sql(name: str) -> str:
    """The derived table as a parenthesised subquery for comparison SQL."""
    return "(" + TABLES[name].replace("NTZ", "TIMESTAMP") + f") {name}"


def ctes(*names: str) -> str:
    """A ``WITH`` clause of derived tables for comparison SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n].replace('NTZ', 'TIMESTAMP')})" for n in names)


def frame(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The derived table as a DataFrame."""
    text = TABLES[name].replace("NTZ", "TIMESTAMP_NTZ")
    for base in _BASE:
        if base in text:
            view = f"tw_{base}"
            table(spark, sf, base).createOrReplaceTempView(view)
            text = text.replace(f"FROM {base}", f"FROM {view}")
    return spark.sql(text)


def record_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Derived records with every record column the operators expect."""
    base = frame(spark, sf, "records")
    evidence = F.array(
        F.struct(
            F.when(F.col("event_type") == "error", "value").when(F.col("event_type") == "view", "user_id").otherwise("event_type").alias("field"),
            F.lit("gt").alias("operator"),
        )
    )
    empty = F.lit(None).cast("string")
    names = EVIDENCE[len("array<struct<"):-2].split(",")
    parts = []
    for pair in names:
        name, kind = pair.split(":")
        if name in ("field", "operator"):
            continue
        parts.append((name, kind))
    full = F.transform(
        evidence,
        lambda c: F.struct(
            c["field"].alias("field"), c["operator"].alias("operator"),
            *[(F.lit(True) if n == "matched" else empty.cast(k)).alias(n) for n, k in parts],
        ),
    )
    never = F.lit(None).cast("timestamp_ntz")
    return base.withColumns(
        {
            "matched_conditions": full,
            "hit_count": F.col("hit_count").cast("int"),
            "deadline_seconds_snapshot": F.col("deadline_seconds_snapshot").cast("int"),
            "validation_result_version": F.col("validation_result_version").cast("int"),
            "resolved_at": F.when(F.col("status") == "resolved", F.col("last_seen_at")),
            "first_delivered_at": never,
            "timed_out_at": never,
            "resolution_source": empty,
            "resolved_by_user_id": empty,
            "last_sql_validation_result": empty,
            "assignee": empty,
        }
    )
