"""Status transitions, deadlines, submissions and one-off data rewrites."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import clean_text, plus_seconds
from tidewatch.operators.anomalies import EXPIRED_TEXT, OPEN, events, moment
from tidewatch.operators.skew import attach, lookup

# Statuses each target may be reached from.
ALLOWED_SOURCES = {
    "pending": ["processing"],
    "processing": ["pending"],
    "timed_out": ["pending", "processing"],
    "resolved": ["pending", "processing", "timed_out"],
}

# Texts of events, the last two around a user id.
CHANGED_TEXT = "状态更新为 "
BY_SQL_TEXT = ("处理人 ", " 通过 SQL 校验并解决异常")
BY_WORD_TEXT = ("验证人 ", " 提交说明并解决异常")


def apply_updates(table: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """The table with the updates' columns written over matching rows.

    ``updates`` has the key plus ``set_<column>`` columns and at most one row per
    key; a null ``set_`` value writes a null.
    """
    assigned = [c for c in updates.columns if c.startswith("set_")]
    marked = updates.select(F.col(key).alias("__key"), *assigned, F.lit(True).alias("__hit"))
    joined = table.join(marked, F.col(key) == F.col("__key"), "left")
    columns = []
    for c in table.columns:
        value = F.col(f"`{c}`")
        if f"set_{c}" in assigned:
            value = F.when(F.col("__hit"), F.col(f"set_{c}")).otherwise(value).cast(table.schema[c].dataType).alias(c)
        columns.append(value)
    return joined.select(*columns)


def decide_transitions(records: DataFrame, wishes: DataFrame, allow_timeout: bool = False) -> DataFrame:
    """Outcome of each wish (``id``, ``target_status``, ``source``, ``user_id``).

    ``outcome`` is ``changed``, ``noop`` or ``rejected`` with a ``reason``.
    """
    current = records.select("id", F.col("status").alias("current_status"))
    joined = wishes.join(current, "id", "left")
    target, now_status = F.col("target_status"), F.col("current_status")
    user = clean_text(F.col("user_id"))
    allowed = F.lit(False)
    for name, sources in ALLOWED_SOURCES.items():
        allowed = allowed | ((target == name) & now_status.isin(*sources))
    reason = (
        F.when(now_status.isNull(), "missing_record")
        .when(~F.coalesce(target.isin(*ALLOWED_SOURCES), F.lit(False)), "unknown_status")
        .when((target == "timed_out") & F.lit(not allow_timeout), "system_only")
        .when(
            (target == "resolved") & (F.coalesce(F.col("source") != "manual", F.lit(True)) | user.isNull()),
            "needs_known_user",
        )
        .when(allowed | (now_status == target), F.lit(None).cast("string"))
        .when(now_status == "resolved", "already_resolved")
        .when((now_status == "timed_out") & target.isin("pending", "processing"), "timed_out_needs_resolution")
        .otherwise("status_changed_meanwhile")
    )
    decided = joined.withColumn("reason", reason)
    outcome = (
        F.when(F.col("reason").isNotNull(), "rejected").when(now_status == target, "noop").otherwise("changed")
    )
    return decided.withColumn("outcome", outcome).withColumn("user_id", user)


def apply_transitions(records: DataFrame, decisions: DataFrame, now) -> DataFrame:
    """Records after the changed decisions."""
    changed = decisions.filter(F.col("outcome") == "changed").select(
        F.col("id").alias("__key"), "target_status", F.col("user_id").alias("__user")
    )
    at = moment(now)
    joined = records.join(changed, F.col("id") == F.col("__key"), "left")
    target = F.col("target_status")
    resolves = F.coalesce(target == "resolved", F.lit(False))
    values = {
        "status": F.coalesce(target, F.col("status")),
        "resolved_at": F.when(resolves, at).otherwise(F.col("resolved_at")),
        "active_fingerprint": F.when(~resolves, F.col("active_fingerprint")),
        "resolution_source": F.when(resolves, "manual").otherwise(F.col("resolution_source")),
        "resolved_by_user_id": F.when(resolves, F.col("__user")).otherwise(F.col("resolved_by_user_id")),
        "timed_out_at": F.when(F.coalesce(target == "timed_out", F.lit(False)), at).otherwise(F.col("timed_out_at")),
    }
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in records.columns])


def status_events(decisions: DataFrame, now) -> DataFrame:
    changed = decisions.filter(F.col("outcome") == "changed")
    return events(changed, "status_changed", F.concat(F.lit(CHANGED_TEXT), F.col("target_status")), now)


class MissingRecords(LookupError):
    """Ids without a record; ``offenders`` has all of them (id)."""

    def __init__(self, offenders: DataFrame, count: int):
        super().__init__(f"{count} records do not exist")
        self.offenders = offenders


class RefusedTransitions(ValueError):
    """Moves that may not be made; ``offenders`` has all of them (id, reason)."""

    def __init__(self, offenders: DataFrame, count: int):
        super().__init__(f"{count} records may not change")
        self.offenders = offenders


def bulk_transition(records: DataFrame, ids: DataFrame, target_status: str, user_id: str, now) -> tuple[DataFrame, DataFrame]:
    """Move all ids or none: returns the new records and the decisions.

    Repeated ids count once. Unknown ids or any rejected move raise before anything
    changes; the error names every offender in a DataFrame.
    """
    wishes = ids.select("id").distinct().select(
        "id",
        F.lit(target_status).alias("target_status"),
        F.lit("manual" if target_status == "resolved" else None).cast("string").alias("source"),
        F.lit(user_id).alias("user_id"),
    )
    decisions = decide_transitions(records, wishes)
    missing = F.col("reason") == "missing_record"
    refused = F.col("outcome") == "rejected"
    counts = decisions.agg(F.count_if(missing).alias("missing"), F.count_if(refused).alias("refused")).first()
    if counts.missing:
        raise MissingRecords(decisions.filter(missing).select("id"), counts.missing)
    if counts.refused:
        raise RefusedTransitions(decisions.filter(refused).select("id", "reason"), counts.refused)
    return apply_transitions(records, decisions, now), decisions


def start_deadlines(records: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Start the clock at the first confirmed delivery (``anomaly_id``, ``delivered_at``).

    Only open records that have a snapshotted time span and no deadline yet.
    """
    first = deliveries.filter(F.col("delivered_at").isNotNull()).groupBy(F.col("anomaly_id").alias("__key")).agg(
        F.min("delivered_at").alias("__first")
    )
    joined = records.join(first, F.col("id") == F.col("__key"), "left")
    starts = (
        F.col("__first").isNotNull()
        & F.col("deadline_seconds_snapshot").isNotNull()
        & F.col("first_delivered_at").isNull()
        & F.col("validation_deadline").isNull()
        & F.col("status").isin("pending", "processing")
    )
    values = {
        "first_delivered_at": F.when(starts, F.col("__first")).otherwise(F.col("first_delivered_at")),
        "validation_deadline": F.when(
            starts, plus_seconds(F.col("__first"), F.col("deadline_seconds_snapshot"))
        ).otherwise(F.col("validation_deadline")),
        "validation_result_version": F.when(starts, F.col("validation_result_version") + 1).otherwise(
            F.col("validation_result_version")
        ),
    }
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in records.columns])


def due_records(records: DataFrame, now, limit: int | None = None) -> DataFrame:
    """Open records past their deadline, earliest first; ``limit`` is the batch size."""
    due = records.filter(
        F.col("status").isin("pending", "processing") & (F.col("validation_deadline") <= moment(now))
    )
    return due if limit is None else due.orderBy("validation_deadline", "id").limit(limit)


def expire(records: DataFrame, now, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with the due ones timed out, and one event per expired record."""
    due = due_records(records, now, limit).select("id")
    updates = due.select("id", F.lit("timed_out").alias("set_status"), moment(now).alias("set_timed_out_at"))
    return (
        apply_updates(records, updates),
        events(due, "validation_timed_out", EXPIRED_TEXT, now),
    )


def judge_submissions(records: DataFrame, requests: DataFrame, existing: DataFrame, submissions: DataFrame) -> DataFrame:
    """Outcome of each submission (``submission_id``, ``anomaly_id``, ``user_id``, ``text``, ``submitted_at``).

    The first valid one of an open record is ``accepted``; later ones are
    ``duplicate`` from the same user and ``already_resolved`` from others. Texts
    need 1 to 1000 characters after trimming; only asked users may submit.
    Winners are found by a mergeable minimum, so a record with very many
    submissions is never gathered in one place.
    """
    text = F.regexp_replace(F.col("text"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    asked = requests.select("anomaly_id", F.col("recipient_user_id").alias("user_id"), F.lit(True).alias("is_recipient")).distinct()
    pairs = submissions.groupBy("anomaly_id", "user_id").agg(F.count(F.lit(1)).alias("__n")).join(
        asked, ["anomaly_id", "user_id"], "left"
    )
    per_user = attach(submissions.withColumn("text", text), pairs, ["anomaly_id", "user_id"], "__n", ["is_recipient"], ["submission_id"])
    size = F.length("text")
    checked = per_user.withColumn(
        "problem",
        F.when(F.coalesce((size < 1) | (size > 1000), F.lit(True)), "invalid_text").when(
            F.col("is_recipient").isNull(), "not_recipient"
        ),
    )
    order = F.struct("submitted_at", "submission_id")
    winners = checked.groupBy("anomaly_id").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(F.when(F.col("problem").isNull(), F.struct("submitted_at", "submission_id", "user_id"))).alias("__win"),
    )
    state = (
        winners.join(records.select(F.col("id").alias("anomaly_id"), "status"), "anomaly_id", "left")
        .join(existing.select("anomaly_id", F.col("submitted_by_user_id").alias("__holder")), "anomaly_id", "left")
        .withColumn("__open", F.coalesce(F.col("status").isin(*OPEN), F.lit(False)))
        .withColumn("__holder", F.coalesce("__holder", F.when(F.col("__open"), F.col("__win.user_id"))))
        .withColumn("__taken", F.col("__win.submission_id"))
        .withColumn("__known", F.col("status").isNotNull())
    )
    existing_ids = existing.select("anomaly_id", F.lit(True).alias("__had")).distinct()
    state = state.join(existing_ids, "anomaly_id", "left")
    joined = attach(checked, state, ["anomaly_id"], "__n", ["__known", "__open", "__had", "__holder", "__taken"], ["submission_id"])
    outcome = (
        F.when(F.col("problem") == "invalid_text", "invalid_text")
        .when(~F.coalesce("__known", F.lit(False)), "unknown_record")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("__had").isNull() & F.col("__open") & (F.col("__taken") == F.col("submission_id")), "accepted")
        .when(F.col("__holder") == F.col("user_id"), "duplicate")
        .otherwise("already_resolved")
    )
    return joined.select("submission_id", "anomaly_id", "user_id", "text", "submitted_at", outcome.alias("outcome"))


def accepted_submissions(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("outcome") == "accepted").select(
        "anomaly_id",
        F.col("user_id").alias("submitted_by_user_id"),
        F.col("text").alias("submitted_text"),
        F.lit("pseudo").alias("validator_type"),
        F.lit("passed").alias("result"),
        "submitted_at",
    )


def resolve_submitted(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """Records with the accepted submissions' anomalies resolved."""
    updates = accepted.select(
        F.col("anomaly_id").alias("id"),
        F.lit("resolved").alias("set_status"),
        F.col("submitted_at").alias("set_resolved_at"),
        F.lit(None).cast("string").alias("set_active_fingerprint"),
        F.lit("validation").alias("set_resolution_source"),
        F.col("submitted_by_user_id").alias("set_resolved_by_user_id"),
    )
    return apply_updates(records, updates)


def resolution_events(accepted: DataFrame) -> DataFrame:
    by_text = F.when(
        F.col("validator_type") == "sql",
        F.concat(F.lit(BY_SQL_TEXT[0]), F.col("submitted_by_user_id"), F.lit(BY_SQL_TEXT[1])),
    ).otherwise(F.concat(F.lit(BY_WORD_TEXT[0]), F.col("submitted_by_user_id"), F.lit(BY_WORD_TEXT[1])))
    return accepted.select(
        "anomaly_id",
        F.lit("validation_resolved").alias("event_type"),
        by_text.alias("description"),
        F.col("submitted_at").alias("created_at"),
    )


def merge_severities(df: DataFrame) -> DataFrame:
    """The former ``critical`` severity counts as ``high``."""
    return df.withColumn("severity", F.when(F.col("severity") == "critical", "high").otherwise(F.col("severity")))


def minutes_to_seconds(df: DataFrame, minutes: str, seconds: str) -> DataFrame:
    return df.withColumn(seconds, F.col(minutes) * 60)


def fill_notified_at(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of already processed groups take the group's processing time."""
    done = groups.filter(F.col("timeout_processed_at").isNotNull()).select("rule_id", "detected_at", "timeout_processed_at")
    found = lookup(members, done, ["rule_id", "detected_at"], ["timeout_processed_at"], ["anomaly_id"])
    filled = F.coalesce("timeout_processed_at", "timeout_notified_at")
    return found.withColumn("timeout_notified_at", filled).select(*members.columns)


def fill_method(records: DataFrame) -> DataFrame:
    """Records with a deadline from before methods existed count as ``pseudo``."""
    missing = F.col("validation_deadline").isNotNull() & F.col("validation_method_snapshot").isNull()
    return records.withColumn(
        "validation_method_snapshot", F.when(missing, "pseudo").otherwise(F.col("validation_method_snapshot"))
    )


def literal_json(value: dict) -> Column:
    return F.lit(json.dumps(value, ensure_ascii=False, sort_keys=True))
