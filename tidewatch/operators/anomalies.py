"""Matches to anomaly records: folding, merging, recipients and requests.

All tables are keyed; a run is one join between the run's folded matches and the
active records. Ids are derived from run and position, so recomputing a lost
partition gives the same ids again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import clean_text, derived_id, fingerprint
from tidewatch.operators.rules import Rule, Target

OPEN = ("pending", "processing", "timed_out")

EVIDENCE = (
    "array<struct<field:string,operator:string,value:string,upper_value:string,value_source:string,"
    "value_field:string,upper_value_source:string,upper_value_field:string,baseline:string,"
    "resolved_value:string,resolved_upper_value:string,actual:string,baseline_value:double,matched:boolean>>"
)

RECORD_SCHEMA = (
    "id string, rule_id string, rule_name string, dataset_name string, severity string, status string, "
    "description string, fingerprint string, active_fingerprint string, business_key string, row_details string, "
    f"matched_conditions {EVIDENCE}, hit_count int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, "
    "resolved_at timestamp_ntz, validation_deadline timestamp_ntz, deadline_seconds_snapshot int, "
    "first_delivered_at timestamp_ntz, timed_out_at timestamp_ntz, resolution_source string, "
    "resolved_by_user_id string, validation_method_snapshot string, last_sql_validation_result string, "
    "validation_result_version int, validation_config_snapshot string, assignee string"
)


def record_columns(spark) -> list[str]:
    return empty_records(spark).columns

# Texts of events, the last around a number.
DETECTED_TEXT, EXPIRED_TEXT = "规则首次检出异常", "异常已超过截止时间，仍可继续处理"
REQUESTED_TEXT = ("已创建 ", " 位验证人的实时验证请求，待发送")


def empty_records(spark) -> DataFrame:
    return spark.createDataFrame([], RECORD_SCHEMA)


def moment(now) -> Column:
    """A literal point in time (UTC, without zone)."""
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")


def occurrence_keys(matches: DataFrame, rule: Rule, run_id: str, now, order_by: list[str]) -> DataFrame:
    """Repeat mode: every match becomes its own occurrence with its own key.

    The occurrence id covers the whole row and its place in the dataset order;
    fully identical rows are told apart by a running number.
    """
    from tidewatch.operators.skew import positions

    if not rule.repeat_push_enabled:
        return matches
    order = list(dict.fromkeys([*order_by, "row_details"]))
    placed = positions(matches, [], order, "__occurrence")
    identity = derived_id(F.lit(run_id), F.lit(rule.rule_id), F.col("__occurrence"))
    stamp = F.concat(F.date_format(moment(now), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    body = F.substring(F.col("business_key"), F.lit(2), F.length("business_key") - 2)
    key = F.concat(
        F.lit('{"__detected_at":"'), stamp, F.lit('","__occurrence_id":"'), identity, F.lit('",'), body, F.lit("}")
    )
    return placed.withColumn("business_key", key).withColumn("fingerprint", fingerprint(key)).drop("__occurrence")


def fold_matches(matches: DataFrame, order_by: list[str]) -> DataFrame:
    """One row per fingerprint: hits, first row's key, last row's details and evidence.

    ``first_pos``/``last_pos`` keep the order tuples, so groups can be numbered
    by first appearance later. Everything is a mergeable aggregate.
    """
    position = F.struct(*[F.col(f"`{c}`") for c in order_by])
    others = [c for c in matches.columns if c not in ("fingerprint", "business_key", "row_details", "matched_conditions")]
    first = F.struct("business_key", *[F.col(f"`{c}`") for c in others])
    last = F.struct("row_details", "matched_conditions")
    folded = matches.groupBy("fingerprint").agg(
        F.count(F.lit(1)).cast("int").alias("run_hits"),
        F.min_by(first, position).alias("first_row"),
        F.max_by(last, position).alias("last_row"),
        F.min(position).alias("first_pos"),
    )
    return folded.select(
        "fingerprint",
        "run_hits",
        F.col("first_row.business_key").alias("business_key"),
        "first_row",
        F.col("last_row.row_details").alias("row_details"),
        F.col("last_row.matched_conditions").alias("matched_conditions"),
        "first_pos",
    )


def _mine(rule: Rule) -> Column:
    return F.coalesce((F.col("rule_id") == rule.rule_id) & F.col("active_fingerprint").isNotNull(), F.lit(False))


def merge_matches(records: DataFrame, folded: DataFrame, rule: Rule, run_id: str, now) -> DataFrame:
    """All records after a run, each with ``is_new`` and ``is_hit``."""
    hit = folded.select(F.col("fingerprint").alias("hit_fp"))
    untouched = records.join(hit, _mine(rule) & (F.col("active_fingerprint") == F.col("hit_fp")), "left_anti").select(
        *records.columns, F.lit(False).alias("is_new"), F.lit(False).alias("is_hit"), F.lit(None).cast("string").alias("hit_fp")
    )
    return touched_records(records, folded, rule, run_id, now).unionByName(untouched)


def after_run(records: DataFrame, touched: DataFrame) -> DataFrame:
    """The records table with a run's touched rows in place of those of the same ids."""
    return records.join(touched.select("id"), "id", "left_anti").select(records.columns).unionByName(touched.select(records.columns))


def touched_records(records: DataFrame, folded: DataFrame, rule: Rule, run_id: str, now) -> DataFrame:
    """Only the records a run makes or hits, each with ``is_new`` and ``is_hit``.

    An active record with the same rule and fingerprint takes the hits, last-seen
    time, details and evidence of the run; other fingerprints become new pending
    records. Resolved records carry no active fingerprint and never join.
    """
    at = moment(now)
    columns = [c for c in records.columns]
    active = records.filter(_mine(rule)).alias("r")
    joined = active.join(folded.alias("m"), F.col("r.active_fingerprint") == F.col("m.fingerprint"), "right")
    fresh = F.col("r.id").isNull()
    new_values = {
        "id": derived_id(F.lit(run_id), F.lit(rule.rule_id), F.col("m.fingerprint")),
        "rule_id": F.lit(rule.rule_id),
        "rule_name": F.lit(rule.name),
        "dataset_name": F.lit(rule.dataset_name),
        "severity": F.lit(rule.severity),
        "status": F.lit("pending"),
        "description": F.lit(rule.description),
        "fingerprint": F.col("m.fingerprint"),
        "active_fingerprint": F.col("m.fingerprint"),
        "business_key": F.col("m.business_key"),
        "first_seen_at": at,
        "deadline_seconds_snapshot": F.lit(rule.deadline_seconds).cast("int"),
        "validation_result_version": F.lit(0),
    }
    hit_values = {
        "row_details": F.col("m.row_details"),
        "matched_conditions": F.col("m.matched_conditions"),
        "last_seen_at": at,
        "hit_count": F.coalesce(F.col("r.hit_count"), F.lit(0)) + F.col("m.run_hits"),
    }
    selected = []
    for c in columns:
        value = F.col(f"r.`{c}`")
        if c in hit_values:
            value = hit_values[c]
        elif c in new_values:
            value = F.when(fresh, new_values[c]).otherwise(value)
        selected.append(value.cast(records.schema[c].dataType).alias(c))
    return joined.select(
        *selected, fresh.alias("is_new"), F.lit(True).alias("is_hit"), F.col("m.fingerprint").alias("hit_fp")
    )


def new_with_rows(merged: DataFrame, folded: DataFrame) -> DataFrame:
    """New records with the struct of the row that created them (``first_row``)."""
    fresh = merged.filter("is_new").select("id", "rule_id", "hit_fp")
    return fresh.join(folded.select(F.col("fingerprint").alias("hit_fp"), "first_row"), "hit_fp")


def events(records: DataFrame, event_type: str, description: str | Column, now) -> DataFrame:
    """Timeline rows for the given records (their ``id`` column)."""
    text = description if isinstance(description, Column) else F.lit(description)
    return records.select(
        F.col("id").alias("anomaly_id"),
        F.lit(event_type).alias("event_type"),
        text.alias("description"),
        moment(now).alias("created_at"),
    )


def detected_events(merged: DataFrame, now) -> DataFrame:
    return events(merged.filter("is_new"), "detected", DETECTED_TEXT, now)


def _target_values(targets: list[Target], source: str, fields: list[str]) -> Column:
    """Distinct non-blank ``(type, value)`` pairs of one row, in target order."""
    items = []
    for target in targets:
        if target.source == "literal":
            value = F.lit(target.value)
        elif target.source == "field":
            value = F.col(f"{source}.`{target.field}`") if target.field in fields else F.lit(None)
        else:
            continue
        items.append(
            F.struct(F.lit(target.receive_id_type).alias("receive_id_type"), clean_text(value).alias("recipient"))
        )
    if not items:
        return F.expr("cast(array() as array<struct<receive_id_type:string,recipient:string>>)")
    return F.array_distinct(F.filter(F.array(*items), lambda item: item["recipient"].isNotNull()))


def notification_targets(rows: DataFrame, targets: list[Target], source: str = "first_row") -> DataFrame:
    """One row per record and resolved recipient, with its place in the list."""
    fields = rows.schema[source].dataType.fieldNames()
    return rows.select(
        F.col("id").alias("anomaly_id"), F.posexplode(_target_values(targets, source, fields)).alias("place", "target")
    ).select("anomaly_id", "place", "target.receive_id_type", "target.recipient")


def validation_targets(rows: DataFrame, targets: list[Target], source: str = "first_row") -> DataFrame:
    """One row per record and user id to ask; the receive type plays no part."""
    plain = [Target(t.source, t.value, t.field, "user_id") for t in targets]
    return notification_targets(rows, plain, source).select("anomaly_id", "place", F.col("recipient").alias("recipient_user_id"))


def new_requests(wanted: DataFrame, existing: DataFrame, now) -> DataFrame:
    """Validation requests for recipients a record does not have yet."""
    missing = wanted.join(
        existing.select("anomaly_id", "recipient_user_id"), ["anomaly_id", "recipient_user_id"], "left_anti"
    )
    return missing.select(
        derived_id(F.lit("request"), F.col("anomaly_id"), F.col("recipient_user_id")).alias("id"),
        "anomaly_id",
        "recipient_user_id",
        F.lit("pending").alias("delivery_status"),
        moment(now).alias("created_at"),
    )


def requested_events(requests: DataFrame, now) -> DataFrame:
    """One timeline row per record that got new requests."""
    per_record = requests.groupBy(F.col("anomaly_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit(REQUESTED_TEXT[0]), F.col("n").cast("string"), F.lit(REQUESTED_TEXT[1]))
    return events(per_record, "validation_requested", text, now)


def new_notifications(targets: DataFrame, asked: DataFrame) -> DataFrame:
    """Plain notifications, without users who are asked to validate instead."""
    users = asked.select("anomaly_id", F.col("recipient_user_id").alias("recipient"), F.lit("user_id").alias("receive_id_type"))
    kept = targets.join(users.distinct(), ["anomaly_id", "receive_id_type", "recipient"], "left_anti")
    return kept.select(
        derived_id(F.lit("delivery"), F.col("anomaly_id"), F.col("receive_id_type"), F.col("recipient")).alias("id"),
        "anomaly_id",
        "receive_id_type",
        "recipient",
        F.lit("pending").alias("status"),
    )


def new_jobs(deliveries: DataFrame, kind: str, generation: int) -> DataFrame:
    """Outbox jobs for freshly created deliveries, requests or broadcasts."""
    owner = F.col("anomaly_id") if "anomaly_id" in deliveries.columns else F.lit(None).cast("string")
    return deliveries.select(
        derived_id(F.lit("job"), F.lit(kind), F.col("id")).alias("id"),
        owner.alias("anomaly_id"),
        F.lit(kind).alias("kind"),
        F.col("id").alias("delivery_id"),
        F.lit(generation).cast("int").alias("generation"),
        F.lit("pending_publish").alias("status"),
    )


def config_snapshot(rule: Rule, field_names: list[str]) -> str:
    """The rule configuration a record keeps from its first sight."""
    config = dict(rule.sql_validation_config)
    if rule.private_message_template:
        config["private_message_template"] = rule.private_message_template
    if rule.validation_method == "sql":
        config.setdefault("datasource_id", rule.dataset_datasource_id)
        config["dataset_fields"] = list(field_names)
    return json.dumps(config, ensure_ascii=False, sort_keys=True)


def snapshot_validation(records: DataFrame, rule: Rule, field_names: list[str], on: Column) -> DataFrame:
    """Copy description, method and configuration onto records that lack them."""
    if not rule.validation_enabled:
        return records
    missing = on & F.col("validation_method_snapshot").isNull()
    return records.withColumns(
        {
            "description": F.when(missing, F.lit(rule.description)).otherwise(F.col("description")),
            "validation_config_snapshot": F.when(
                missing, F.lit(config_snapshot(rule, field_names))
            ).otherwise(F.col("validation_config_snapshot")),
            "validation_method_snapshot": F.when(missing, F.lit(rule.validation_method)).otherwise(
                F.col("validation_method_snapshot")
            ),
        }
    )
