"""Registered queries: lists, exports, counters and trends."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from tidewatch.functions.values import formula_safe
from tidewatch.operators import outbox as O
from tidewatch.operators import reports as R
from tidewatch.operators.listing import PagedList, SearchList
from tidewatch.plans.derived import GENERATION, ctes, frame, record_frame
from tidewatch.plans.outbox_queries import BASE, IN_TRANSIT, states
from tidewatch.plans.registry import query
from tidewatch.session import scratch_dir, table

TODAY = date(2024, 1, 30)
FIELD_SQL = "CASE WHEN event_type = 'error' THEN 'value' WHEN event_type = 'view' THEN 'user_id' ELSE event_type END"
RANK_SQL = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query("r1_record_filter", ctes("records") + " SELECT id, status, severity FROM records WHERE status = 'pending' AND severity = 'high' AND rule_id = 'rule-error'")
def r1(spark, sf):
    return R.filter_records(record_frame(spark, sf), "pending", "high", "rule-error").select("id", "status", "severity")


@query("r1_records_in_transit", f"{BASE} SELECT id, status, severity FROM records WHERE severity = 'high' AND id IN ({IN_TRANSIT})")
def r1_in_transit(spark, sf):
    transit = O.in_transit(frame(spark, sf, "jobs"), states(spark, sf), GENERATION)
    return R.filter_records(record_frame(spark, sf), severity="high", push_status="in_transit", transit=transit).select("id", "status", "severity")


R2_SQL = ctes("records") + " SELECT id, dataset_name FROM records WHERE contains(dataset_name, 't_3') OR contains(rule_name, 't_3')"


@query("r2_literal_search", R2_SQL)
def r2(spark, sf):
    return R.filter_records(record_frame(spark, sf), search="t_3").select("id", "dataset_name")


def search_list(spark, sf):
    """The records in ranges of their names, with postings of these and of the condition fields."""
    fields = F.transform("matched_conditions", lambda c: c["field"])
    out = SearchList(spark, f"{scratch_dir(spark)}/names-{uuid.uuid4().hex}", ["rule_name", "dataset_name"], fields, rows_per_range=2_000)
    out.build(record_frame(spark, sf))
    return out


@query("r2_literal_search_indexed", R2_SQL)
def r2_indexed(spark, sf):
    return search_list(spark, sf).search("t_3").select("id", "dataset_name")


@query("r3_condition_field_search_indexed", ctes("records") + f" SELECT id FROM records WHERE {FIELD_SQL} = 'user_id'")
def r3_indexed(spark, sf):
    return search_list(spark, sf).search("user_id").select("id")


@query("r3_condition_field_search", ctes("records") + f" SELECT id FROM records WHERE {FIELD_SQL} = 'user_id'")
def r3(spark, sf):
    return R.filter_records(record_frame(spark, sf), search="user_id").select("id")


@query("r4_ranked_sort", ctes("records") + f" SELECT id, severity FROM records ORDER BY {RANK_SQL} DESC, id ASC")
def r4(spark, sf):
    return record_frame(spark, sf).orderBy(*R.record_order("severity")).select("id", "severity")


@query(
    "r5_page_with_total",
    ctes("records") + " SELECT id, (SELECT count(*) FROM records) AS total FROM (SELECT id FROM records ORDER BY first_seen_at DESC, id LIMIT 100 OFFSET 200)",
)
def r5(spark, sf):
    rows, total = R.page(record_frame(spark, sf), R.record_order(), 3, 500)
    return rows.select("id", total.alias("total"))


@query(
    "r5_page_from_ranges",
    ctes("records")
    + """, placed AS (SELECT id, row_number() OVER (ORDER BY first_seen_at DESC, id) - 1 AS place, count(*) OVER () AS total FROM records)
        SELECT id, total FROM placed WHERE place // 20 = total // 40""",
)
def r5_ranges(spark, sf):
    """The page in the middle of the list, from the stored ranges it falls into."""
    pages = PagedList(spark, f"{scratch_dir(spark)}/pages-{uuid.uuid4().hex}", R.record_order(), rows_per_range=2_000)
    pages.build(record_frame(spark, sf))
    _, total = pages.page()
    rows, total = pages.page(total // 40 + 1, 20)
    return rows.select("id", F.lit(total).cast("bigint").alias("total"))


@query(
    "r6_delivery_rollup",
    ctes("records", "notifications")
    + """ SELECT r.id, CASE WHEN count(n.id) = 0 THEN 'none' WHEN bool_or(n.status = 'failed') THEN 'failed'
          WHEN bool_and(n.status IN ('sent', 'aborted')) AND bool_or(n.status = 'sent') THEN 'sent' WHEN bool_and(n.status = 'aborted') THEN 'aborted' ELSE 'pending' END AS delivery
        FROM records r LEFT JOIN (SELECT id, anomaly_id, status FROM notifications UNION ALL SELECT id || 'x', concat('a', CAST(substr(anomaly_id, 2) AS BIGINT) // 2), status FROM notifications) n
          ON n.anomaly_id = r.id GROUP BY r.id""",
)
def r6(spark, sf):
    sent = frame(spark, sf, "notifications").select("id", "anomaly_id", "status")
    number = F.floor(F.substring("anomaly_id", 2, 20).cast("bigint") / 2).cast("string")
    more = sent.select(F.concat("id", F.lit("x")).alias("id"), F.concat(F.lit("a"), number).alias("anomaly_id"), "status")
    return R.delivery_status(record_frame(spark, sf), sent.unionByName(more)).select("id", "delivery")


@query(
    "r7_export_rows",
    ctes("records")
    + """ SELECT id, rule_name, dataset_name, severity, status, business_key, CAST(first_seen_at AS VARCHAR) AS first_seen_at, CAST(last_seen_at AS VARCHAR) AS last_seen_at, hit_count
        FROM records WHERE severity = 'high'""",
)
def r7(spark, sf):
    rows = R.export_rows(R.filter_records(record_frame(spark, sf), severity="high"))
    return rows.withColumns({c: F.col(c).cast("string") for c in ("first_seen_at", "last_seen_at")})


@query(
    "r7_export_chosen_in_transit",
    f"""{BASE} SELECT id, rule_name, status, CAST(first_seen_at AS VARCHAR) AS first_seen_at FROM records
        WHERE id IN ({IN_TRANSIT}) AND id IN (SELECT concat('a', event_id) FROM events WHERE user_id % 2 = 0)""",
)
def r7_chosen(spark, sf):
    transit = O.in_transit(frame(spark, sf, "jobs"), states(spark, sf), GENERATION)
    ids = table(spark, sf, "events").filter("user_id % 2 = 0").select(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("id"))
    rows = R.export_rows(R.filter_records(record_frame(spark, sf), push_status="in_transit", transit=transit), ids)
    return rows.select("id", "rule_name", "status", F.col("first_seen_at").cast("string").alias("first_seen_at"))


@query(
    "r8_formula_safe_cells",
    r"""SELECT o_orderkey, CASE WHEN regexp_matches(cell, '^[\s\x00-\x1f]*[=+\-@]') THEN '''' || cell ELSE cell END AS cell FROM (
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '=' || o_custkey WHEN 'O' THEN ' ' || chr(9) || '-' || o_orderpriority ELSE o_orderpriority END AS cell FROM orders)""",
)
def r8(spark, sf):
    df = table(spark, sf, "orders")
    cell = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("="), F.col("o_custkey").cast("string")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit(" \t-"), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    )
    cells = df.select("o_orderkey", cell.alias("cell"))
    return cells.select("o_orderkey", formula_safe(F.col("cell"), cells.schema["cell"].dataType).alias("cell"))


@query(
    "r9_overview_counters",
    f"""{BASE}, rules AS ({ctes('rules').split('rules AS (', 1)[1]}, datasets AS ({ctes('datasets').split('datasets AS (', 1)[1]}, sources AS ({ctes('sources').split('sources AS (', 1)[1]}
        SELECT count(*) FILTER (WHERE status = 'pending') AS pending_records, count(*) FILTER (WHERE status = 'processing') AS processing_records,
        count(*) FILTER (WHERE status = 'timed_out') AS timed_out_records, count(*) FILTER (WHERE status = 'resolved') AS resolved_records,
        count(*) FILTER (WHERE severity = 'high' AND status <> 'resolved') AS high_anomalies,
        (SELECT count(*) FROM rules WHERE deleted_at IS NULL AND enabled) AS active_rules, (SELECT count(*) FROM rules WHERE deleted_at IS NULL) AS total_rules,
        (SELECT count(*) FROM sources WHERE status = 'online') AS online_datasources, (SELECT count(*) FROM sources) AS total_datasources,
        (SELECT count(*) FROM datasets) AS total_datasets, (SELECT count(*) FROM ({IN_TRANSIT})) AS push_in_transit_anomalies FROM records""",
)
def r9(spark, sf):
    transit = O.in_transit(frame(spark, sf, "jobs"), states(spark, sf), GENERATION)
    return R.overview_counters(
        record_frame(spark, sf), frame(spark, sf, "rules"), frame(spark, sf, "sources"), frame(spark, sf, "datasets"), transit
    )


@query("r10_recent", ctes("records") + " SELECT id, CAST(last_seen_at AS VARCHAR) AS last_seen_at FROM records ORDER BY records.last_seen_at DESC, id LIMIT 5")
def r10(spark, sf):
    return R.recent(record_frame(spark, sf)).select("id", F.col("last_seen_at").cast("string").alias("last_seen_at"))


COUNTED = ctes("records", "rules", "datasets") + """, counted AS (SELECT r.id, r.name, d.name AS dataset_name, r.enabled, coalesce(c.n, 0) AS anomaly_count
  FROM rules r JOIN datasets d ON d.id = r.dataset_id LEFT JOIN (SELECT rule_id, count(*) AS n FROM records GROUP BY rule_id) c ON c.rule_id = r.id WHERE r.deleted_at IS NULL)"""


def counted(spark, sf):
    return R.rule_counts(frame(spark, sf, "rules"), frame(spark, sf, "datasets"), record_frame(spark, sf))


@query("r11_rule_counts", COUNTED + " SELECT * FROM counted")
def r11(spark, sf):
    return counted(spark, sf)


@query("r11_top_rules", COUNTED + " SELECT id, name, dataset_name, anomaly_count FROM counted ORDER BY anomaly_count DESC, id LIMIT 4")
def r11_top(spark, sf):
    return R.top_rules(counted(spark, sf)).drop("enabled")


def _trend(days: int) -> None:
    @query(
        f"r12_daily_trend_{days}",
        ctes("records")
        + f""" SELECT CAST(d.day AS VARCHAR) AS day, count(r.id) AS anomaly_count
            FROM (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - INTERVAL {days - 1} DAY, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day) d
            LEFT JOIN records r ON CAST(r.first_seen_at + INTERVAL 8 HOUR AS DATE) = d.day GROUP BY d.day""",
    )
    def trend(spark, sf):
        out = R.daily_trend(record_frame(spark, sf), TODAY, days)
        return out.select(F.col("day").cast("string").alias("day"), "anomaly_count")


for _days in R.TREND_DAYS:
    _trend(_days)


@query("r13_group_list", ctes("groups") + " SELECT run_id, matched_rows FROM groups WHERE contains(rule_name, 'e c') ORDER BY detected_at DESC, run_id LIMIT 20")
def r13(spark, sf):
    found, order = R.list_groups(frame(spark, sf, "groups"), search="e c")
    return R.page(found, order)[0].select("run_id", "matched_rows")


@query(
    "r14_group_status_counts",
    ctes("records", "members", "groups")
    + """ SELECT g.run_id, count(*) FILTER (WHERE r.status = 'pending') AS pending, count(*) FILTER (WHERE r.status = 'processing') AS processing,
          count(*) FILTER (WHERE r.status = 'timed_out') AS timed_out, count(*) FILTER (WHERE r.status = 'resolved') AS resolved
        FROM groups g LEFT JOIN members m ON m.rule_id = g.rule_id AND m.detected_at = g.detected_at LEFT JOIN records r ON r.id = m.anomaly_id GROUP BY g.run_id""",
)
def r14(spark, sf):
    out = R.group_status_counts(frame(spark, sf, "groups"), frame(spark, sf, "members"), record_frame(spark, sf))
    return out.drop("rule_id", "detected_at")


ROLL = """CASE WHEN bool_or(status = 'uncertain') THEN 'uncertain' WHEN bool_and(status = 'pending') THEN 'pending'
  WHEN bool_or(status IN ('sending', 'pending')) THEN 'in_transit' WHEN bool_and(status = 'sent') THEN 'sent' WHEN bool_and(status = 'aborted') THEN 'aborted'
  WHEN bool_or(status = 'sent') AND bool_or(status IN ('failed', 'aborted')) THEN 'partial_failed' WHEN bool_or(status = 'failed') THEN 'failed'
  WHEN bool_or(status = 'aborted') THEN 'aborted' ELSE 'in_transit' END"""
HOURLY = """hourly AS (SELECT rule_id, date_trunc('hour', updated_at) AS detected_at, id, status, broadcast_kind FROM broadcasts)"""


def hourly_groups(spark, sf):
    """Broadcasts grouped per hour, so that groups hold few and varied statuses."""
    hour = F.make_timestamp_ntz(
        F.year("updated_at"), F.month("updated_at"), F.day("updated_at"), F.hour("updated_at"), F.lit(0), F.lit(0)
    )
    broadcasts = frame(spark, sf, "broadcasts").withColumn("detected_at", hour)
    groups = broadcasts.groupBy("rule_id", "detected_at").agg(F.count("*").alias("n")).select(
        "rule_id", "detected_at", F.col("detected_at").cast("string").alias("run_id"), (F.hour("detected_at") != 3).alias("broadcast_enabled"),
        (F.hour("detected_at") % 4).alias("new_anomalies"),
    )
    return groups, broadcasts


@query(
    "r15_broadcast_status",
    ctes("broadcasts")
    + f""", {HOURLY}, g AS (SELECT rule_id, detected_at, hour(detected_at) AS h FROM hourly GROUP BY 1, 2), s AS (SELECT rule_id, detected_at, {ROLL} AS rolled FROM hourly WHERE broadcast_kind = 'situation' GROUP BY 1, 2)
        SELECT CAST(g.detected_at AS VARCHAR) AS run_id, CASE WHEN h <> 3 AND h % 4 = 0 AND rolled IS NULL THEN 'skipped' WHEN h = 3 THEN 'disabled' ELSE coalesce(rolled, 'failed') END AS situation_status
        FROM g LEFT JOIN s USING (rule_id, detected_at)""",
)
def r15(spark, sf):
    groups, broadcasts = hourly_groups(spark, sf)
    return R.group_broadcast_status(groups, broadcasts).select("run_id", "situation_status")


@query(
    "r16_timeout_status",
    ctes("records", "members", "groups", "broadcasts")
    + f""", s AS (SELECT rule_id, detected_at, {ROLL} AS rolled FROM broadcasts WHERE broadcast_kind = 'timeout' GROUP BY 1, 2),
        w AS (SELECT m.rule_id, m.detected_at, count(*) AS waiting, count(*) FILTER (WHERE r.validation_deadline IS NULL) AS unsent FROM members m JOIN records r ON r.id = m.anomaly_id
              WHERE m.is_new AND m.timeout_notified_at IS NULL AND r.status <> 'resolved' GROUP BY 1, 2),
        x AS (SELECT g.run_id, g.timeout_enabled, s.rolled, CASE WHEN g.timeout_enabled AND g.timeout_processed_at IS NULL THEN coalesce(waiting, 0) ELSE 0 END AS waiting,
              CASE WHEN g.timeout_enabled AND g.timeout_processed_at IS NULL THEN coalesce(unsent, 0) ELSE 0 END AS unsent FROM groups g LEFT JOIN s USING (rule_id, detected_at) LEFT JOIN w USING (rule_id, detected_at))
        SELECT run_id, waiting, unsent, CASE WHEN NOT timeout_enabled THEN 'disabled' WHEN rolled IS NOT NULL THEN rolled WHEN waiting = 0 THEN 'skipped' WHEN waiting = unsent THEN 'waiting_delivery' ELSE 'waiting' END AS timeout_status FROM x""",
)
def r16(spark, sf):
    out = R.group_timeout_status(frame(spark, sf, "groups"), frame(spark, sf, "members"), record_frame(spark, sf), frame(spark, sf, "broadcasts"))
    return out.select("run_id", "waiting", "unsent", "timeout_status")


@query(
    "r17_group_member_page",
    ctes("records", "members")
    + """ SELECT m.position, r.id, r.status FROM members m JOIN records r ON r.id = m.anomaly_id WHERE m.rule_id = 'rule-error' AND m.detected_at = TIMESTAMP '2024-01-05'
        ORDER BY m.position LIMIT 20 OFFSET 20""",
)
def r17(spark, sf):
    at = F.lit(datetime(2024, 1, 5)).cast("timestamp_ntz")
    rows = R.group_member_records(frame(spark, sf, "members"), record_frame(spark, sf), "rule-error", at)
    return R.page(rows, [F.col("position")], 2)[0].select("position", "id", "status")


@query(
    "r18_record_detail",
    ctes("records", "jobs", "members", "notifications", "requests", "broadcasts")
    + """, grp AS (SELECT DISTINCT rule_id, detected_at FROM members WHERE anomaly_id = 'a2'), shared AS (SELECT id FROM broadcasts JOIN grp USING (rule_id, detected_at))
        SELECT 'record' AS section, id AS sort_id, CAST(first_seen_at AS VARCHAR) AS sort_at FROM records WHERE id = 'a2'
        UNION ALL SELECT 'timeline', 'detected', CAST(first_seen_at AS VARCHAR) FROM records WHERE id = 'a2'
        UNION ALL SELECT 'delivery', id, NULL FROM notifications WHERE anomaly_id = 'a2' UNION ALL SELECT 'request', id, NULL FROM requests WHERE anomaly_id = 'a2'
        UNION ALL SELECT 'job', id, CAST(created_at AS VARCHAR) FROM jobs WHERE anomaly_id = 'a2' OR (kind = 'group_broadcast' AND delivery_id IN (SELECT id FROM shared))
        UNION ALL SELECT 'submission', 'u1', CAST(last_seen_at AS VARCHAR) FROM records WHERE id = 'a2'""",
)
def r18(spark, sf):
    records = record_frame(spark, sf)
    log = records.select(
        F.col("id").alias("anomaly_id"), F.lit("detected").alias("event_type"), F.lit("x").alias("description"), F.col("first_seen_at").alias("created_at")
    )
    texts = records.select(
        F.col("id").alias("anomaly_id"), F.lit("u1").alias("submitted_by_user_id"), F.lit("ok").alias("submitted_text"), F.lit("passed").alias("result"),
        F.col("last_seen_at").alias("submitted_at"),
    )
    out = R.record_details(
        "a2", log, frame(spark, sf, "notifications"), frame(spark, sf, "requests"), frame(spark, sf, "jobs"), frame(spark, sf, "members"),
        frame(spark, sf, "broadcasts"), texts, records,
    )
    return out.select("section", "sort_id", F.col("sort_at").cast("string").alias("sort_at"))


@query(
    "r19_sources_in_use",
    ctes("records", "rules", "datasets", "sources")
    + """, u AS (SELECT lower(datasource_id) AS ref FROM datasets
          UNION SELECT lower(json_extract_string(sql_validation_config, '$.datasource_id')) FROM rules WHERE deleted_at IS NULL AND validation_method = 'sql'
          UNION SELECT lower(json_extract_string(validation_config_snapshot, '$.datasource_id')) FROM records WHERE status <> 'resolved' AND validation_method_snapshot = 'sql'
            AND rule_id IN (SELECT id FROM rules WHERE deleted_at IS NULL))
        SELECT id, name FROM sources WHERE lower(id) IN (SELECT ref FROM u)""",
)
def r19(spark, sf):
    out = R.sources_in_use(frame(spark, sf, "sources"), frame(spark, sf, "datasets"), frame(spark, sf, "rules"), record_frame(spark, sf))
    return out.select("id", "name")


@query("r20_rule_list", COUNTED + " SELECT id, anomaly_count FROM counted WHERE (contains(lower(name), 'nation_1') OR contains(lower(dataset_name), 'asia')) AND enabled")
def r20(spark, sf):
    return R.filter_rules(R.filter_rules(counted(spark, sf), "Nation_1") .unionByName(R.filter_rules(counted(spark, sf), "ASIA")).distinct(), state="enabled").select("id", "anomaly_count")


@query(
    "r20_rule_totals",
    COUNTED + " SELECT count(*) AS total_rules, count(*) FILTER (WHERE enabled) AS active_rules, sum(anomaly_count) AS total_anomalies, count(*) FILTER (WHERE anomaly_count > 0) AS triggered_rules FROM counted",
)
def r20_totals(spark, sf):
    return R.rule_totals(counted(spark, sf))


@query("r21_dataset_list", ctes("datasets") + " SELECT id, name FROM datasets WHERE contains(lower(name), 'a') OR contains(lower(description), 'a')")
def r21(spark, sf):
    return R.filter_datasets(frame(spark, sf, "datasets"), "A").select("id", "name")


@query(
    "r21_dataset_totals",
    ctes("datasets")
    + """ SELECT count(*) AS total_datasets, count(DISTINCT datasource_id) AS source_count, CAST(sum(row_count) AS BIGINT) AS total_rows,
        count(*) FILTER (WHERE CAST(updated_at AS DATE) = DATE '2024-01-16') AS updated_today FROM datasets""",
)
def r21_totals(spark, sf):
    return R.dataset_totals(frame(spark, sf, "datasets"), date(2024, 1, 16))
