"""Run groups: members, unique times, broadcast messages and timeout rounds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import clean_text, derived_id, ntz_from_micros, ntz_micros
from tidewatch.operators.anomalies import EXPIRED_TEXT, OPEN, events, moment
from tidewatch.operators.messages import (
    link_node,
    mention_node,
    render_group_lines,
    seconds_text,
    status_label,
    text_node,
)
from tidewatch.operators.rules import Rule, Target
from tidewatch.operators.skew import attach, lookup, positions, running
from tidewatch.session import materialise

GROUP_KEY = ["rule_id", "detected_at"]
CHUNK = 20  # Fixed value: records per message.
_TIME_WINDOW = 1000

# Texts of group messages.
HEADINGS = {"situation": "【情况播报】", "timeout": "【超时播报】"}
SUMMARY_TEXT = ("规则：", "\n检测时间：", "\n扫描 ", " 条，命中 ", " 条，新增 ", " 条")
OVERDUE_TEXT = ("已超时未解决：", " 条，请相关处理人尽快处理。")
GROUP_LINK_TEXT, RECORD_LINK_TEXT = "查看异常记录组", "查看明细"
NOTHING_TEXT, ATTENTION_TEXT = "本次未检测到异常", "请关注："
PART_TEXT = ("（", "/", "）")


def unique_time(groups: DataFrame, rule_id: str, detected_at: datetime) -> datetime:
    """First free microsecond at or after the run's time among the rule's groups.

    Looks at a fixed-size stretch of the timeline at once and moves on only when
    that stretch is completely taken.
    """
    start = detected_at
    while True:
        end = start + timedelta(microseconds=_TIME_WINDOW)
        taken = {
            row[0]
            for row in groups.filter(
                (F.col("rule_id") == rule_id) & (F.col("detected_at") >= moment(start)) & (F.col("detected_at") < moment(end))
            )
            .select("detected_at")
            .distinct()
            .collect()
        }
        for step in range(_TIME_WINDOW):
            candidate = start + timedelta(microseconds=step)
            if candidate not in taken:
                return candidate
        start = end


def unique_times(runs: DataFrame) -> DataFrame:
    """The same for a whole batch of runs: later ones move to the next free microsecond.

    Runs of one rule that share a time form a cluster; a cluster starts at its
    own time or right after the clusters before it, which is a running maximum.
    """
    micros = runs.withColumn("__us", ntz_micros(F.col("detected_at")))
    clusters = micros.groupBy("rule_id", "__us").agg(F.count(F.lit(1)).alias("__n"))
    summed = running(clusters, ["rule_id"], ["__us"], {"__upto": ("sum", F.col("__n"))})
    offset = summed.withColumn("__before", F.col("__upto") - F.col("__n")).withColumn(
        "__gap", F.col("__us") - F.col("__before")
    )
    starts = running(offset, ["rule_id"], ["__us"], {"__max": ("max", F.col("__gap"))}).select(
        "rule_id", "__us", "__n", (F.col("__before") + F.col("__max")).alias("__start")
    )
    placed = attach(positions(micros, ["rule_id", "__us"], ["run_id"], "__pos"), starts, ["rule_id", "__us"], "__n", ["__start"], ["run_id"])
    shifted = ntz_from_micros(F.col("__start") + F.col("__pos"))
    return placed.withColumn("detected_at", shifted).select(*runs.columns)


def group_members(merged: DataFrame, folded: DataFrame, rule: Rule, detected_at) -> DataFrame:
    """Records of a run in first-seen order, with the flag of the new ones."""
    fields = folded.schema["first_pos"].dataType.fieldNames()
    order = [f"__o{i}" for i in range(len(fields))]
    first = folded.select(
        F.col("fingerprint").alias("hit_fp"), *[F.col(f"first_pos.`{f}`").alias(o) for f, o in zip(fields, order)]
    )
    hits = merged.filter("is_hit").select("id", "is_new", "hit_fp").join(first, "hit_fp")
    placed = positions(hits, [], order)
    return placed.select(
        F.lit(rule.rule_id).alias("rule_id"),
        moment(detected_at).alias("detected_at"),
        F.col("id").alias("anomaly_id"),
        "position",
        "is_new",
        F.lit(None).cast("timestamp_ntz").alias("timeout_notified_at"),
    )


def group_row(summary: DataFrame, members: DataFrame, records: DataFrame, rule: Rule, detected_at) -> DataFrame:
    """The run's group row; it exists even when nothing matched."""
    deadlines = members.filter("is_new").join(records.select(F.col("id").alias("anomaly_id"), "validation_deadline"), "anomaly_id")
    latest = deadlines.agg(F.max("validation_deadline")).scalar()
    deadline = latest if rule.timeout_broadcast_enabled else F.lit(None)
    return summary.select(
        F.lit(rule.rule_id).alias("rule_id"),
        moment(detected_at).alias("detected_at"),
        "run_id",
        F.lit(rule.name).alias("rule_name"),
        "scanned_rows",
        "matched_rows",
        "new_anomalies",
        F.lit(rule.group_broadcast_enabled).alias("broadcast_enabled"),
        F.lit(rule.timeout_broadcast_enabled).alias("timeout_enabled"),
        F.lit(rule.group_webhook_url if rule.timeout_broadcast_enabled else None).cast("string").alias("timeout_webhook"),
        deadline.cast("timestamp_ntz").alias("timeout_deadline"),
        F.lit(None).cast("timestamp_ntz").alias("timeout_processed_at"),
    )


def group_deadlines(groups: DataFrame, members: DataFrame, records: DataFrame) -> DataFrame:
    """Latest deadline of each group's new members, where timeouts are on."""
    due = (
        members.filter("is_new")
        .join(records.select(F.col("id").alias("anomaly_id"), "validation_deadline"), "anomaly_id")
        .groupBy(*GROUP_KEY)
        .agg(F.max("validation_deadline").alias("timeout_deadline"))
    )
    return (
        groups.drop("timeout_deadline")
        .join(due, GROUP_KEY, "left")
        .withColumn("timeout_deadline", F.when(F.col("timeout_enabled"), F.col("timeout_deadline")))
    )


def row_value(name: str, details: Column) -> Column:
    """A field of a record's row, as text."""
    escaped = name.replace("'", "\\'")
    return F.get_json_object(details, f"$['{escaped}']")


def mentions(rows: DataFrame, targets: list[Target], handlers: DataFrame | None = None) -> DataFrame:
    """Distinct user ids per group with their order.

    ``rows`` has the group key, ``position`` and ``row_details``. Handlers come
    first, by id; then targets in order, field values by position. Rows are
    reduced to one per distinct value before anything is ordered.
    """
    branches = []
    if handlers is not None:
        branches.append(
            handlers.select(
                *GROUP_KEY, F.lit(-1).alias("rank"), F.lit(0).cast("long").alias("place"),
                clean_text(F.col("recipient_user_id")).alias("user_id"),
            )
        )
    for rank, target in enumerate(targets):
        if target.source == "literal":
            found = rows.select(*GROUP_KEY).distinct().select(
                *GROUP_KEY, F.lit(rank).alias("rank"), F.lit(0).cast("long").alias("place"),
                clean_text(F.lit(target.value)).alias("user_id"),
            )
        else:
            found = rows.select(
                *GROUP_KEY, F.lit(rank).alias("rank"), F.col("position").cast("long").alias("place"),
                clean_text(row_value(target.field, F.col("row_details"))).alias("user_id"),
            )
        branches.append(found)
    if not branches:
        empty = rows.select(*GROUP_KEY).limit(0)
        return empty.select(*GROUP_KEY, F.lit("").alias("user_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("place"))
    combined = branches[0]
    for branch in branches[1:]:
        combined = combined.unionByName(branch)
    first = F.struct("rank", "place", "user_id")
    return (
        combined.filter(F.col("user_id").isNotNull())
        .groupBy(*GROUP_KEY, "user_id")
        .agg(F.min(first).alias("__first"))
        .select(*GROUP_KEY, "user_id", F.col("__first.rank").alias("rank"), F.col("__first.place").alias("place"))
    )


def _field(name: str):
    return lambda item: item[name]


def chunked(rows: DataFrame) -> DataFrame:
    """Rows (group key, ``position``) with ``part_index`` of 20 records each."""
    numbered = positions(rows, GROUP_KEY, ["position", "anomaly_id"], "__i")
    return numbered.withColumn("part_index", (F.floor(F.col("__i") / CHUNK) + 1).cast("int")).drop("__i")


def _lines_of(group: dict[str, Column], kind: str, total: Column) -> Column:
    summary = F.concat(
        F.lit(SUMMARY_TEXT[0]), group["rule_name"], F.lit(SUMMARY_TEXT[1]), seconds_text(group["detected_at"]),
        F.lit(SUMMARY_TEXT[2]), group["scanned_rows"].cast("string"),
        F.lit(SUMMARY_TEXT[3]), group["matched_rows"].cast("string"),
        F.lit(SUMMARY_TEXT[4]), group["new_anomalies"].cast("string"), F.lit(SUMMARY_TEXT[5]),
    )
    head = [F.array(text_node(summary)), F.array(link_node(F.lit(GROUP_LINK_TEXT), group["url"]))]
    if kind == "timeout":
        overdue = F.concat(F.lit(OVERDUE_TEXT[0]), total.cast("string"), F.lit(OVERDUE_TEXT[1]))
        head.insert(0, F.array(text_node(overdue)))
    return F.array(*head)


def group_messages(
    groups: DataFrame,
    rows: DataFrame,
    mention_rows: DataFrame,
    base_url: str,
    template: str | None = None,
    field_names: list[str] | None = None,
    kind: str = "situation",
) -> DataFrame:
    """One message per group and chunk: title, JSON payload, part and total.

    ``rows``: group key, ``position``, ``anomaly_id``, ``status``,
    ``business_key``, ``row_details``. A group without rows gets one message.
    """
    base = base_url.rstrip("/")
    parts = chunked(rows)
    record_line = F.array(
        text_node(F.concat(F.lit("["), status_label(F.col("status")), F.lit("] "), F.col("business_key"), F.lit(" "))),
        link_node(F.lit(RECORD_LINK_TEXT), F.concat(F.lit(f"{base}/#records/"), F.col("anomaly_id"))),
    )
    names = field_names or []
    carried = [record_line.alias("line")] if not template else [
        row_value(n, F.col("row_details")).alias(f"v{i}") for i, n in enumerate(names)
    ]
    chunks = parts.groupBy(*GROUP_KEY, "part_index").agg(
        F.array_sort(F.collect_list(F.struct("position", "anomaly_id", *carried))).alias("items")
    )
    sizes = rows.groupBy(*GROUP_KEY).agg(F.count(F.lit(1)).alias("record_count"))
    people = mention_rows.groupBy(*GROUP_KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "place", "user_id"))), lambda m: m["user_id"]).alias("people")
    )
    base_rows = (
        groups.join(sizes, GROUP_KEY, "left")
        .withColumn("record_count", F.coalesce("record_count", F.lit(0)))
        .withColumn("total_parts", F.greatest(F.ceil(F.col("record_count") / CHUNK), F.lit(1)).cast("int"))
        .withColumn("part_index", F.explode(F.sequence(F.lit(1), F.col("total_parts"))))
        .join(chunks, [*GROUP_KEY, "part_index"], "left")
        # only the first part names people, so only that carries them
        .join(people.withColumn("part_index", F.lit(1)), [*GROUP_KEY, "part_index"], "left")
    )
    url = F.concat(F.lit(f"{base}/#anomaly-groups/"), F.col("run_id"))
    group = {c: F.col(c) for c in ("rule_name", "detected_at", "scanned_rows", "matched_rows", "new_anomalies")}
    if template:
        lists = {n: F.transform("items", _field(f"v{i}")) for i, n in enumerate(names)}
        lists = {n: F.coalesce(v, F.array().cast("array<string>")) for n, v in lists.items()}
        lines = render_group_lines(template, lists, url)
    else:
        nothing = F.array(F.array(text_node(F.lit(NOTHING_TEXT))))
        details = F.coalesce(F.transform("items", lambda item: item["line"]), nothing)
        lines = F.concat(_lines_of({**group, "url": url}, kind, F.col("record_count")), details)
    attention = F.array(
        F.concat(F.array(text_node(F.lit(ATTENTION_TEXT))), F.transform("people", lambda u: mention_node(u)))
    )
    lines = F.when(
        F.col("people").isNotNull(), F.concat(lines, attention)
    ).otherwise(lines)
    suffix = F.when(
        F.col("total_parts") > 1,
        F.concat(F.lit(PART_TEXT[0]), F.col("part_index").cast("string"), F.lit(PART_TEXT[1]), F.col("total_parts").cast("string"), F.lit(PART_TEXT[2])),
    ).otherwise("")
    heading = HEADINGS["timeout" if kind == "timeout" else "situation"]
    title = F.concat(F.lit(heading), F.col("rule_name"), suffix)
    post = F.struct(F.struct(title.alias("title"), lines.alias("content")).alias("zh-CN"))
    payload = F.to_json(F.struct(F.lit("post").alias("msg_type"), F.struct(post.alias("post")).alias("content")))
    return base_rows.select(
        *GROUP_KEY, "run_id", "part_index", "total_parts", title.alias("title"), payload.alias("payload")
    )


def broadcast_rows(messages: DataFrame, kind: str, round_index: Column | int, webhook: Column | str) -> DataFrame:
    """Broadcast deliveries for messages, ready for the outbox."""
    number = round_index if isinstance(round_index, Column) else F.lit(round_index)
    target = webhook if isinstance(webhook, Column) else F.lit(webhook)
    return messages.select(
        derived_id(F.lit(kind), F.col("rule_id"), F.col("detected_at"), number, F.col("part_index")).alias("id"),
        *GROUP_KEY,
        "part_index",
        F.lit(kind).alias("broadcast_kind"),
        number.cast("int").alias("round_index"),
        "total_parts",
        target.alias("webhook_url"),
        "payload",
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"),
    )


def member_rows(members: DataFrame, records: DataFrame) -> DataFrame:
    """Members with the record columns a message needs."""
    wanted = records.select(F.col("id").alias("anomaly_id"), "status", "business_key", "row_details")
    return members.join(wanted, "anomaly_id")


def situation_messages(
    groups: DataFrame, members: DataFrame, records: DataFrame, rule: Rule, base_url: str, field_names: list[str]
) -> DataFrame | None:
    """Broadcasts of a run: only when enabled, addressed, and with new records."""
    if not rule.group_broadcast_enabled or not rule.group_webhook_url:
        return None
    rows = member_rows(members.filter("is_new"), records)
    wanted = groups.filter(F.col("new_anomalies") > 0)
    people = mentions(rows, rule.group_mention_targets)
    messages = group_messages(wanted, rows, people, base_url, rule.group_message_template, field_names)
    return broadcast_rows(messages, "situation", 0, rule.group_webhook_url)


@dataclass(frozen=True)
class TimeoutScan:
    """What one timeout scan decided; each table is a plain DataFrame."""

    due: DataFrame
    expired: DataFrame
    expired_events: DataFrame
    rounds: DataFrame
    rows: DataFrame
    mentions: DataFrame
    closed: DataFrame


def timeout_scan(
    groups: DataFrame,
    members: DataFrame,
    records: DataFrame,
    requests: DataFrame,
    broadcasts: DataFrame,
    now,
    limit: int = 50,
    extra_targets: list[Target] | None = None,
    aborting: bool = False,
) -> TimeoutScan:
    """Newly due members of up to ``limit`` groups, each notified exactly once.

    The limit counts groups and is the scan's batch size; a group's due members
    are always taken whole, and the remaining groups follow in the next scan.
    While pushes are being aborted a scan takes nothing.
    """
    at = moment(now)
    state = records.select(
        F.col("id").alias("anomaly_id"), "status", "validation_deadline", "business_key", "row_details"
    )
    open_groups = groups.filter(F.col("timeout_processed_at").isNull()).select(
        *GROUP_KEY, "timeout_enabled", "timeout_webhook", F.lit(True).alias("is_open")
    )
    candidates = members.filter(F.col("is_new") & F.col("timeout_notified_at").isNull() & F.lit(not aborting))
    waiting = (
        lookup(candidates, open_groups, GROUP_KEY, ["timeout_enabled", "timeout_webhook", "is_open"], ["anomaly_id"])
        .filter("is_open")
        .join(state, "anomaly_id")
    )
    is_due = (F.col("validation_deadline") <= at) & F.col("status").isin(*OPEN)
    waiting = waiting.withColumn("is_due", F.coalesce(is_due, F.lit(False)))
    picked = (
        waiting.filter("is_due")
        .groupBy(*GROUP_KEY)
        .agg(F.min("validation_deadline").alias("first_due"))
        .orderBy("first_due", *GROUP_KEY)
        .limit(limit)
    )
    # at most ``limit`` rows, so the broadcast has a fixed size; the cohort is
    # written out once because every result below reads it
    cohort = materialise(waiting.join(F.broadcast(picked.select(*GROUP_KEY)), GROUP_KEY, "left_semi"), "cohort")
    due = cohort.filter("is_due")
    expired = due.filter(F.col("status") != "timed_out").select(F.col("anomaly_id").alias("id"))
    sends = F.col("timeout_enabled") & F.coalesce(F.col("timeout_webhook") != "", F.lit(False))
    notified = due.filter(sends)
    last_round = (
        broadcasts.filter(F.col("broadcast_kind") == "timeout").groupBy(*GROUP_KEY).agg(F.max("round_index").alias("last"))
    )
    rounds = (
        notified.groupBy(*GROUP_KEY)
        .agg(F.count(F.lit(1)).alias("member_count"), F.first("timeout_webhook").alias("webhook_url"))
        .join(last_round, GROUP_KEY, "left")
        .select(*GROUP_KEY, "member_count", "webhook_url", (F.coalesce("last", F.lit(0)) + 1).alias("round_index"))
    )
    handlers = notified.select(*GROUP_KEY, "anomaly_id").join(
        requests.select("anomaly_id", "recipient_user_id"), "anomaly_id"
    )
    handlers = _ordered_handlers(handlers)
    people = mentions(notified, extra_targets or [], handlers)
    # a member stops waiting once notified in this scan or resolved
    remaining = cohort.groupBy(*GROUP_KEY).agg(
        F.count_if((F.col("status") != "resolved") & ~(F.col("is_due") & sends)).alias("remaining"),
        F.bool_or("timeout_enabled").alias("enabled"),
    )
    closed = remaining.filter((F.col("remaining") == 0) | ~F.col("enabled")).select(*GROUP_KEY, at.alias("timeout_processed_at"))
    rows = notified.select(*GROUP_KEY, "position", "anomaly_id", F.lit("timed_out").alias("status"), "business_key", "row_details")
    return TimeoutScan(
        due=due,
        expired=expired,
        expired_events=events(expired, "validation_timed_out", EXPIRED_TEXT, now),
        rounds=rounds,
        rows=rows,
        mentions=people,
        closed=closed,
    )


def _ordered_handlers(handlers: DataFrame) -> DataFrame:
    return handlers.select(*GROUP_KEY, "recipient_user_id").distinct()
