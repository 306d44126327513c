"""Reporting queries over the state tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import formula_safe, severity_rank
from tidewatch.operators.anomalies import OPEN
from tidewatch.operators.groups import GROUP_KEY
from tidewatch.operators.messages import STATUS_LABELS

# Statuses, export columns, trend lengths, page bounds, report zone.
STATUSES = list(STATUS_LABELS)
EXPORT_COLUMNS = [
    "id", "rule_name", "dataset_name", "severity", "status", "business_key", "first_seen_at", "last_seen_at", "hit_count",
]
TREND_DAYS = (14, 30, 90)
MAX_PAGE_SIZE = 100
ZONE = "Asia/Shanghai"


def filter_records(
    records: DataFrame, status: str | None = None, severity: str | None = None, rule_id: str | None = None,
    search: str | None = None, push_status: str | None = None, transit: DataFrame | None = None,
) -> DataFrame:
    """Equality filters plus search: literal text in a name, or an exact condition field.

    ``push_status`` ``in_transit`` keeps the records whose pushes are under way
    (``transit``: the anomaly ids of ``outbox.in_transit``).
    """
    out = records
    if push_status == "in_transit":
        out = out.join(transit.select(F.col("anomaly_id").alias("id")), "id", "left_semi").select(records.columns)
    elif push_status:
        raise ValueError(f"unknown push status: {push_status}")
    for name, value in (("status", status), ("severity", severity), ("rule_id", rule_id)):
        if value:
            out = out.filter(F.col(name) == value)
    if search:
        out = out.filter(
            F.col("rule_name").contains(search)
            | F.col("dataset_name").contains(search)
            | F.exists("matched_conditions", lambda c: c["field"] == search)
        )
    return out


def record_order(sort_key: str = "occurredAt", descending: bool = True) -> list[Column]:
    by = severity_rank(F.col("severity")) if sort_key == "severity" else F.col("first_seen_at")
    return [by.desc() if descending else by.asc(), F.col("id").asc()]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, Column]:
    """One page, and the total as a column to select with it; the size is clamped to 1..100.

    Nothing runs until the page is read.
    """
    rows = min(max(size, 1), MAX_PAGE_SIZE)
    start = max(number - 1, 0) * rows
    return df.orderBy(*order).offset(start).limit(rows), df.agg(F.count(F.lit(1))).scalar()


def delivery_status(records: DataFrame, notifications: DataFrame) -> DataFrame:
    """Each record with the roll-up of its notifications."""
    status = F.col("status")
    rolled = notifications.groupBy("anomaly_id").agg(
        F.bool_or(status == "failed").alias("any_failed"),
        F.bool_or(status == "sent").alias("any_sent"),
        F.bool_and(status.isin("sent", "aborted")).alias("all_settled"),
        F.bool_and(status == "aborted").alias("all_aborted"),
    )
    joined = records.join(rolled, F.col("id") == F.col("anomaly_id"), "left")
    verdict = (
        F.when(F.col("anomaly_id").isNull(), "none")
        .when(F.col("any_failed"), "failed")
        .when(F.col("all_settled") & F.col("any_sent"), "sent")
        .when(F.col("all_aborted"), "aborted")
        .otherwise("pending")
    )
    return joined.select(*[F.col(f"`{c}`") for c in records.columns], verdict.alias("delivery"))


def export_rows(records: DataFrame, ids: DataFrame | None = None, sort_key: str = "occurredAt", descending: bool = True) -> DataFrame:
    """The export's nine columns in global order, text made formula-safe; ``ids`` (``id``) chooses records."""
    chosen = records if ids is None else records.join(ids.select("id"), "id", "left_semi").select(records.columns)
    ordered = chosen.orderBy(*record_order(sort_key, descending))
    cells = [formula_safe(F.col(c), records.schema[c].dataType).alias(c) for c in EXPORT_COLUMNS]
    return ordered.select(*cells)


def write_export(rows: DataFrame, path: str) -> None:
    """One CSV in parts: byte-order mark and header first, then the rows in order.

    The sorted rows stay split over tasks in headerless part files. Joining all
    files of the folder in name order gives the export.
    """
    rows.write.csv(path, header=False, encoding="UTF-8", escape='"', mode="errorifexists")
    spark = rows.sparkSession
    first = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header.csv")
    out = first.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(first, False)
    try:
        out.write(("\ufeff" + ",".join(rows.columns) + "\n").encode())
    finally:
        out.close()


def overview_counters(
    records: DataFrame, rules: DataFrame, sources: DataFrame, datasets: DataFrame, transit: DataFrame
) -> DataFrame:
    """One row of dashboard counters."""
    status = F.col("status")
    tagged = (
        records.select(F.lit("record").alias("kind"), "status", (F.col("severity") == "high").alias("flag"))
        .unionByName(
            rules.filter(F.col("deleted_at").isNull()).select(
                F.lit("rule").alias("kind"), F.lit(None).cast("string").alias("status"), F.col("enabled").alias("flag")
            )
        )
        .unionByName(sources.select(F.lit("source").alias("kind"), "status", F.lit(False).alias("flag")))
        .unionByName(datasets.select(F.lit("dataset").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("flag")))
        .unionByName(transit.select(F.lit("transit").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("flag")))
    )
    kind = F.col("kind")
    is_record = kind == "record"
    return tagged.agg(
        *[F.count_if(is_record & (status == s)).alias(f"{s}_records") for s in STATUSES],
        F.count_if(is_record & F.col("flag") & (status != "resolved")).alias("high_anomalies"),
        F.count_if((kind == "rule") & F.col("flag")).alias("active_rules"),
        F.count_if(kind == "rule").alias("total_rules"),
        F.count_if((kind == "source") & (status == "online")).alias("online_datasources"),
        F.count_if(kind == "source").alias("total_datasources"),
        F.count_if(kind == "dataset").alias("total_datasets"),
        F.count_if(kind == "transit").alias("push_in_transit_anomalies"),
    )


def recent(records: DataFrame, limit: int = 5) -> DataFrame:
    return records.orderBy(F.col("last_seen_at").desc(), F.col("id").asc()).limit(limit)


def rule_counts(rules: DataFrame, datasets: DataFrame, records: DataFrame) -> DataFrame:
    """Live rules with their dataset name and anomaly count (zero included)."""
    counts = records.groupBy("rule_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    live = rules.filter(F.col("deleted_at").isNull())
    names = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return (
        live.join(names, "dataset_id")
        .join(counts, live["id"] == counts["rule_id"], "left")
        .select(live["id"], live["name"], "dataset_name", "enabled", F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"))
    )


def top_rules(counted: DataFrame, limit: int = 4) -> DataFrame:
    return counted.orderBy(F.col("anomaly_count").desc(), F.col("id").asc()).limit(limit)


def local_day(moment: Column, zone: str = ZONE) -> Column:
    """Calendar day in ``zone`` of a UTC time, whatever the session zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), moment))


def daily_trend(records: DataFrame, today: date, days: int = 14, zone: str = ZONE) -> DataFrame:
    """New records per local day for the last 14, 30 or 90 days, zeros included."""
    if days not in TREND_DAYS:
        raise ValueError(f"trend days must be one of {TREND_DAYS}")
    start = today - timedelta(days=days - 1)
    spark = records.sparkSession
    calendar = spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(today))).alias("day")
    )
    day = local_day(F.col("first_seen_at"), zone)
    # plain bounds on the stored column (a day of slack each side) reach the scan
    low, high = start - timedelta(days=2), today + timedelta(days=2)
    seen = F.col("first_seen_at")
    counts = (
        records.filter((seen >= F.lit(low).cast("timestamp_ntz")) & (seen < F.lit(high).cast("timestamp_ntz")))
        .groupBy(day.alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("anomaly_count"))


def list_groups(groups: DataFrame, search: str | None = None, rule_id: str | None = None) -> tuple[DataFrame, list[Column]]:
    out = groups
    if search:
        out = out.filter(F.col("rule_name").contains(search))
    if rule_id:
        out = out.filter(F.col("rule_id") == rule_id)
    return out, [F.col("detected_at").desc(), F.col("run_id").asc()]


def group_status_counts(groups: DataFrame, members: DataFrame, records: DataFrame) -> DataFrame:
    """Members per status and group, all four statuses present."""
    state = records.select(F.col("id").alias("anomaly_id"), "status")
    counts = members.join(state, "anomaly_id").groupBy(*GROUP_KEY).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    )
    keys = groups.select(*GROUP_KEY, "run_id")
    return keys.join(counts, GROUP_KEY, "left").fillna(0, subset=STATUSES)


def broadcast_rollup(kind_rows: DataFrame) -> DataFrame:
    """One status per group from its broadcasts of one kind, by ordered rules."""
    status = F.col("status")
    sums = kind_rows.groupBy(*GROUP_KEY).agg(
        F.bool_or(status == "uncertain").alias("uncertain"),
        F.bool_and(status == "pending").alias("all_pending"),
        F.bool_or(status.isin("sending", "pending")).alias("moving"),
        F.bool_and(status == "sent").alias("all_sent"),
        F.bool_and(status == "aborted").alias("all_aborted"),
        F.bool_or(status == "sent").alias("sent"),
        F.bool_or(status == "failed").alias("failed"),
        F.bool_or(status == "aborted").alias("aborted"),
    )
    rolled = (
        F.when(F.col("uncertain"), "uncertain")
        .when(F.col("all_pending"), "pending")
        .when(F.col("moving"), "in_transit")
        .when(F.col("all_sent"), "sent")
        .when(F.col("all_aborted"), "aborted")
        .when(F.col("sent") & (F.col("failed") | F.col("aborted")), "partial_failed")
        .when(F.col("failed"), "failed")
        .when(F.col("aborted"), "aborted")
        .otherwise("in_transit")
    )
    return sums.select(*GROUP_KEY, rolled.alias("rolled"))


def group_broadcast_status(groups: DataFrame, broadcasts: DataFrame) -> DataFrame:
    """Situation status per group: disabled, skipped, failed or the roll-up."""
    rolled = broadcast_rollup(broadcasts.filter(F.col("broadcast_kind") == "situation"))
    status = (
        F.when(F.col("broadcast_enabled") & (F.col("new_anomalies") == 0) & F.col("rolled").isNull(), "skipped")
        .when(~F.col("broadcast_enabled"), "disabled")
        .otherwise(F.coalesce("rolled", F.lit("failed")))
    )
    return groups.join(rolled, GROUP_KEY, "left").select(*GROUP_KEY, "run_id", status.alias("situation_status"))


def group_timeout_status(groups: DataFrame, members: DataFrame, records: DataFrame, broadcasts: DataFrame) -> DataFrame:
    """Timeout status per group with the members still waiting."""
    rolled = broadcast_rollup(broadcasts.filter(F.col("broadcast_kind") == "timeout"))
    state = records.select(F.col("id").alias("anomaly_id"), "status", "validation_deadline")
    waiting = (
        members.filter(F.col("is_new") & F.col("timeout_notified_at").isNull())
        .join(state.filter(F.col("status") != "resolved"), "anomaly_id")
        .groupBy(*GROUP_KEY)
        .agg(F.count(F.lit(1)).alias("waiting"), F.count_if(F.col("validation_deadline").isNull()).alias("unsent"))
    )
    live = F.col("timeout_enabled") & F.col("timeout_processed_at").isNull()
    joined = groups.join(rolled, GROUP_KEY, "left").join(waiting, GROUP_KEY, "left")
    joined = joined.withColumn("waiting", F.when(live, F.coalesce("waiting", F.lit(0))).otherwise(0)).withColumn(
        "unsent", F.when(live, F.coalesce("unsent", F.lit(0))).otherwise(0)
    )
    status = (
        F.when(~F.col("timeout_enabled"), "disabled")
        .when(F.col("rolled").isNotNull(), F.col("rolled"))
        .when(F.col("waiting") == 0, "skipped")
        .when(F.col("waiting") == F.col("unsent"), "waiting_delivery")
        .otherwise("waiting")
    )
    return joined.select(*GROUP_KEY, "run_id", status.alias("timeout_status"), "waiting", "unsent")


def group_member_records(members: DataFrame, records: DataFrame, rule_id: str, detected_at) -> DataFrame:
    chosen = members.filter((F.col("rule_id") == rule_id) & (F.col("detected_at") == detected_at))
    return chosen.select("anomaly_id", "position", "is_new").join(records, F.col("anomaly_id") == F.col("id"))


def record_details(
    anomaly_id: str, events: DataFrame, notifications: DataFrame, requests: DataFrame, jobs: DataFrame,
    members: DataFrame, broadcasts: DataFrame, submissions: DataFrame, records: DataFrame,
) -> DataFrame:
    """One record with everything attached to it: its own children and its groups' jobs.

    One row for the record, with all its columns, and one per child: ``section``, ``sort_at``, ``sort_id`` and a JSON ``body``.
    Children stay rows rather than nested lists, so a record with very many of
    them is still spread over tasks.
    """
    mine = F.col("anomaly_id") == anomaly_id

    def section(name: str, rows: DataFrame, at: str | None, sort_id: str, columns: list[str]) -> DataFrame:
        when = F.col(at) if at else F.lit(None)
        columns = [c for c in columns if c in rows.columns]
        return rows.select(
            F.lit(name).alias("section"), when.cast("timestamp_ntz").alias("sort_at"),
            F.col(sort_id).cast("string").alias("sort_id"), F.to_json(F.struct(*columns)).alias("body"),
        )

    groups = members.filter(mine).select(*GROUP_KEY).distinct()
    shared = broadcasts.join(groups, GROUP_KEY, "left_semi").select(F.col("id").alias("delivery_id"))
    group_jobs = jobs.filter(F.col("kind") == "group_broadcast").join(shared, "delivery_id", "left_semi")
    job_columns = ["id", "kind", "status", "publish_attempts", "dispatch_attempts", "next_attempt_at", "last_error", "updated_at"]
    job_columns = [c for c in job_columns if c in jobs.columns]
    kept = ["created_at", *job_columns]
    all_jobs = jobs.filter(mine).select(*kept).unionByName(group_jobs.select(*kept)).distinct()
    return (
        section("record", records.filter(F.col("id") == anomaly_id), "first_seen_at", "id", records.columns)
        .unionByName(section("timeline", events.filter(mine), "created_at", "event_type", ["event_type", "description"]))
        .unionByName(
            section("delivery", notifications.filter(mine), None, "id", ["receive_id_type", "recipient", "status", "attempts", "message_id", "last_error"])
        )
        .unionByName(
            section("request", requests.filter(mine), None, "id", ["recipient_user_id", "delivery_status", "delivery_attempts", "message_id", "last_error", "delivered_at"])
        )
        .unionByName(section("job", all_jobs, "created_at", "id", job_columns))
        .unionByName(
            section(
                "submission", submissions.filter(mine), "submitted_at", "submitted_by_user_id",
                ["submitted_by_user_id", "submitted_text", "validator_type", "result", "result_detail"],
            )
        )
    )


def sources_in_use(sources: DataFrame, datasets: DataFrame, rules: DataFrame, records: DataFrame) -> DataFrame:
    """Sources a dataset, a live check rule or an open check record refers to."""
    def named(rows: DataFrame, config: str) -> DataFrame:
        return rows.select(F.lower(F.get_json_object(config, "$.datasource_id")).alias("ref"))

    live = rules.filter(F.col("deleted_at").isNull())
    by_rule = named(live.filter(F.col("validation_method") == "sql"), "sql_validation_config")
    open_records = records.filter(F.col("status").isin(*OPEN) & (F.col("validation_method_snapshot") == "sql"))
    # distinct (rule, source) pairs first: a rule with very many records joins as few rows
    pairs = open_records.select("rule_id", "validation_config_snapshot").distinct()
    by_record = named(pairs.join(live.select(F.col("id").alias("rule_id")), "rule_id", "left_semi"), "validation_config_snapshot")
    by_dataset = datasets.select(F.lower("datasource_id").alias("ref"))
    used = by_dataset.unionByName(by_rule).unionByName(by_record).filter(F.col("ref").isNotNull()).distinct()
    return sources.join(used, F.lower(F.col("id")) == F.col("ref"), "left_semi")


def filter_rules(counted: DataFrame, search: str | None = None, state: str = "all") -> DataFrame:
    """Rule list: case-insensitive text, and enabled / disabled / triggered."""
    out = counted
    if search:
        text = search.lower()
        out = out.filter(
            F.lower("name").contains(text) | F.lower(F.coalesce("dataset_name", F.lit(""))).contains(text)
        )
    if state == "enabled":
        out = out.filter(F.col("enabled"))
    elif state == "disabled":
        out = out.filter(~F.col("enabled"))
    elif state == "triggered":
        out = out.filter(F.col("anomaly_count") > 0)
    return out


def rule_totals(counted: DataFrame) -> DataFrame:
    return counted.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if("enabled").alias("active_rules"),
        F.coalesce(F.sum("anomaly_count"), F.lit(0)).alias("total_anomalies"),
        F.count_if(F.col("anomaly_count") > 0).alias("triggered_rules"),
    )


def filter_datasets(datasets: DataFrame, search: str | None = None, datasource_id: str | None = None) -> DataFrame:
    out = datasets
    if search:
        text = search.lower()
        out = out.filter(
            F.lower("name").contains(text) | F.lower(F.coalesce("description", F.lit(""))).contains(text)
        )
    return out if datasource_id is None else out.filter(F.col("datasource_id") == datasource_id)


def dataset_totals(datasets: DataFrame, today: date) -> DataFrame:
    return datasets.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.countDistinct("datasource_id").alias("source_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.count_if(F.to_date("updated_at") == F.lit(today)).alias("updated_today"),
    )
