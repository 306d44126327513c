"""Registered queries that run Structured Streaming to completion.

Each run uses a folder of its own below the shared folder: the derived topic is
staged there as files, streamed with all available data, and the committed
batches are read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.values import ntz_micros
from tidewatch.operators import outbox as O
from tidewatch.plans import topic
from tidewatch.plans.derived import GENERATION, frame
from tidewatch.plans.outbox_queries import BASE, DONE, MESSAGES, messages, states
from tidewatch.plans.registry import query
from tidewatch.plans.warehouse_queries import SPOILT_SQL, STEPS, _rounded_average, current_sql, spoilt
from tidewatch.session import scratch_dir, table
from tidewatch.sources.changelog import RAW_SCHEMA, parse_changes, raw_file_stream
from tidewatch.streaming import jobs as J
from tidewatch.streaming import warehouse as W
from tidewatch.streaming import windows as N
from tidewatch.streaming.keyed import PACKS, checked_changes, keyed_state, zero_filled_windows
from tidewatch.streaming.tables import BatchTable, KeyedTable


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder among this application's intermediate tables, which ``clear_scratch`` removes."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged_topic(spark: SparkSession, sf: str, root: str) -> DataFrame:
    """The derived topic as files, opened as a stream."""
    topic.raw(spark, sf, spread=True).write.parquet(f"{root}/topic")
    return raw_file_stream(spark, f"{root}/topic", fmt="parquet")


def finish(*queries) -> None:
    for running in queries:
        running.awaitTermination()


@query(
    "s8_raw_changelog_stream",
    f"""WITH {STEPS} SELECT CAST(user_id % 3 AS INTEGER) AS topic_partition, CASE step WHEN 0 THEN 'c' WHEN 3 THEN 'd' ELSE 'u' END AS op, count(*) AS n, min(event_id * 4 + step) AS first_offset,
        max(event_id * 4 + step) AS last_offset FROM steps GROUP BY 1, 2""",
)
def s8(spark, sf):
    root = run_folder(spark, "raw")
    out = BatchTable(spark, f"{root}/ods")
    finish(J.run_stream(W.ods_rows(staged_topic(spark, sf, root)), f"{root}/checkpoint", out.write))
    return out.read().groupBy("topic_partition", "op").agg(
        F.count("*").alias("n"), F.min("topic_offset").alias("first_offset"), F.max("topic_offset").alias("last_offset")
    )


@query("w3_store_metrics_streamed", _rounded_average("run_id, store_id"))
def w3_stream(spark, sf):
    """Repeats dropped by keyed state; every batch adds its totals."""
    root = run_folder(spark, "totals")
    out = BatchTable(spark, f"{root}/totals")

    def add(batch, batch_id):
        out.write(W.delta_totals(W.signed_deltas(parse_changes(batch)), J.STORE_KEYS), batch_id)

    with keyed_state(spark):
        running = J.run_stream(checked_changes(staged_topic(spark, sf, root), "id", with_rows=False, packs=PACKS), f"{root}/checkpoint", add)
    finish(running)
    metrics = W.live_metrics(W.merge_totals(out.read(), J.STORE_KEYS), J.STORE_KEYS)
    return metrics.withColumns({c: F.col(c).cast("double") for c in ("revenue", "average_ticket")})


@query("w3_running_totals_streamed", _rounded_average("run_id, store_id"))
def w3_running(spark, sf):
    """Totals kept in streaming state, over a log without repeats."""
    root = run_folder(spark, "running")
    W.drop_repeats(topic.changes(spark, sf), "id").write.parquet(f"{root}/changes")
    stream = spark.readStream.schema(topic.changes(spark, sf).schema).parquet(f"{root}/changes")
    out = BatchTable(spark, f"{root}/totals")
    finish(J.start_totals(W.signed_deltas(stream), out, J.STORE_KEYS, f"{root}/checkpoint"))
    metrics = W.live_metrics(J.newest_totals(out, J.STORE_KEYS), J.STORE_KEYS)
    return metrics.withColumns({c: F.col(c).cast("double") for c in ("revenue", "average_ticket")})


@query(
    "w6_five_tables_in_one_job",
    f"""WITH {topic.FINAL_SQL}, {STEPS}, live AS (SELECT * FROM final WHERE status <> 'CANCELLED')
        SELECT 'ods' AS target, count(*) AS "rows", CAST(0 AS DOUBLE) AS total FROM steps
        UNION ALL SELECT 'dwd', count(*), CAST(sum(amount) AS DOUBLE) FROM final
        UNION ALL SELECT 'dws_store', count(DISTINCT (run_id, store_id)), CAST(sum(amount) AS DOUBLE) FROM live
        UNION ALL SELECT 'dws_minute', count(DISTINCT (run_id, date_trunc('minute', ts))), CAST(sum(amount) AS DOUBLE) FROM live
        UNION ALL SELECT 'ads_run', count(DISTINCT run_id), CAST(sum(amount) AS DOUBLE) FROM live""",
)
def w6(spark, sf):
    root = run_folder(spark, "warehouse")
    warehouse = J.Warehouse(spark, f"{root}/tables")
    finish(*J.start_warehouse(staged_topic(spark, sf, root), warehouse, f"{root}/checkpoints"))

    def line(name, df, column):
        total = F.sum(column).cast("double") if column else F.lit(0.0)
        return df.agg(F.lit(name).alias("target"), F.count("*").alias("rows"), total.alias("total"))

    return (
        line("ods", warehouse.ods(), None)
        .unionByName(line("dwd", warehouse.current(), "amount"))
        .unionByName(line("dws_store", warehouse.store_metrics(), "revenue"))
        .unionByName(line("dws_minute", warehouse.minute_metrics(), "revenue"))
        .unionByName(line("ads_run", warehouse.run_metrics(), "revenue"))
    )


@query(
    "w7_drop_repeats_streamed",
    f"WITH {STEPS} SELECT CASE step WHEN 0 THEN 'c' WHEN 3 THEN 'd' ELSE 'u' END AS op, count(*) AS n FROM steps WHERE step <> 2 GROUP BY 1",
)
def w7_stream(spark, sf):
    """State holds the last position of each key."""
    root = run_folder(spark, "repeats")
    out = BatchTable(spark, f"{root}/changes")
    with keyed_state(spark):
        changes = parse_changes(checked_changes(staged_topic(spark, sf, root), "id", with_rows=False, packs=PACKS))
        running = J.run_stream(changes.select("op"), f"{root}/checkpoint", out.write)
    finish(running)
    return out.read().groupBy("op").agg(F.count("*").alias("n"))


@query("w9_before_image_check_streamed", SPOILT_SQL)
def w9_stream(spark, sf):
    """The check as a stream: an order's changes come in several runs, and wrong ones go to a quarantine table."""
    root = run_folder(spark, "images")
    out = BatchTable(spark, f"{root}/quarantine")
    body = F.to_json(F.struct("op", "ts_ms", "before", "after", "source"), {"ignoreNullFields": "false"})
    step = F.least(F.col("offset") % 4, F.lit(2)).alias("part")
    spoilt(spark, sf, spread=True).select(body.alias("value"), "partition", "offset", "timestamp", step).write.partitionBy("part").parquet(f"{root}/log")
    for part in range(3):
        spark.read.schema(RAW_SCHEMA).parquet(f"{root}/log/part={part}").write.mode("append").parquet(f"{root}/topic")
        with keyed_state(spark):
            changes = checked_changes(raw_file_stream(spark, f"{root}/topic", fmt="parquet"), "id", packs=PACKS)
            running = J.run_stream(changes.filter("problem is not null"), f"{root}/checkpoint", out.write)
        finish(running)
    wrong = parse_changes(out.read())
    return wrong.select(F.coalesce("after.id", "before.id").alias("id"), "offset", "op")


@query("w2_current_state_merged", current_sql())
def w2_merged(spark, sf):
    """Current orders from a table in key buckets, into which three parts of the log were merged one after the other."""
    orders = KeyedTable(spark, f"{run_folder(spark, 'orders')}/dwd", ["key"], J.live_rows, buckets=8)
    changes = topic.changes(spark, sf)
    for batch_id in range(3):
        part = changes.filter(F.least(F.col("offset") % 4, F.lit(2)) == batch_id)
        orders.merge(W.current_rows(part, "id", ["partition", "offset"], with_marks=True), batch_id)
    out = W.dwd_rows(orders.read().select("row.*"))
    return out.select(
        "order_id", "run_id", "store_id", "channel", F.col("amount").cast("double").alias("amount"), "status",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
    )


WINDOWS_SQL = """e AS (SELECT concat('S00', 1 + user_id % 4) AS shop_id, epoch_us(ts) // 1000 AS ms, CAST(value AS DECIMAL(12,2)) AS amount, event_type FROM events),
  p AS (SELECT *, unnest(range(ms // 5000 * 5000 - 295000, ms // 5000 * 5000 + 1, 5000)) + 300000 AS window_end_ms FROM e),
  m AS (SELECT max(ms) - 5000 AS w2, max(ms) FILTER (WHERE event_type <> 'error') - 5000 AS w1 FROM e)"""


def sales(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("S00"), (1 + F.col("user_id") % 4).cast("string")).alias("shop_id"), F.lit(1).alias("sign"),
        F.col("value").cast("decimal(12,2)").alias("amount"), F.timestamp_micros(ntz_micros(F.col("ts"))).alias("event_time"),
    )


def window_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("shop_id").agg(
        F.count("*").alias("windows"), F.sum("order_count").alias("orders"), F.sum("total_amount").cast("double").alias("amount"),
        F.max("window_end_ms").alias("last_end"),
    )


SUMMARY_SQL = """SELECT shop_id, count(*) AS windows, CAST(sum(c) AS BIGINT) AS orders, CAST(sum(a) AS DOUBLE) AS amount, CAST(max(window_end_ms) AS BIGINT) AS last_end FROM w GROUP BY shop_id"""


@query(
    "w11_sliding_windows_streamed",
    f"WITH {WINDOWS_SQL}, w AS (SELECT shop_id, window_end_ms, count(*) AS c, sum(amount) AS a FROM p, m WHERE window_end_ms <= w2 GROUP BY 1, 2) {SUMMARY_SQL}",
)
def w11_stream(spark, sf):
    root = run_folder(spark, "windows")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = BatchTable(spark, f"{root}/windows")
    finish(J.start_windows(sales(stream), out, f"{root}/checkpoint"))
    return window_summary(out.read())


@query(
    "w13_late_events_miss_closed_windows",
    f"""WITH {WINDOWS_SQL}, w AS (SELECT shop_id, window_end_ms, count(*) AS c, sum(amount) AS a FROM p, m
          WHERE window_end_ms <= w2 AND (event_type <> 'error' OR window_end_ms > w1) GROUP BY 1, 2) {SUMMARY_SQL}""",
)
def w13(spark, sf):
    root = run_folder(spark, "late")
    events = table(spark, sf, "events")
    out = BatchTable(spark, f"{root}/windows")
    for late in (False, True):
        part = events.filter((F.col("event_type") == "error") == F.lit(late))
        part.write.mode("append").parquet(f"{root}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/events")
        finish(J.run_stream(J.streaming_windows(sales(stream)), f"{root}/checkpoint", out.write))
    return window_summary(out.read())


@query(
    "w14_latest_window_zero_filled_streamed",
    f"""WITH {WINDOWS_SQL}, c AS (SELECT (max(ms) - 5000) // 5000 * 5000 AS window_end_ms FROM e),
        hit AS (SELECT shop_id, count(*) AS c, sum(amount) AS a FROM e JOIN c ON ms >= window_end_ms - 300000 AND ms < window_end_ms GROUP BY shop_id)
        SELECT s.store_id AS shop_id, CAST(window_end_ms - 300000 AS BIGINT) AS window_start_ms, CAST(window_end_ms AS BIGINT) AS window_end_ms,
          coalesce(hit.c, 0) AS order_count, CAST(coalesce(hit.a, 0) AS DOUBLE) AS total_amount
        FROM {topic.SHOPS_SQL} s JOIN c ON true LEFT JOIN hit ON hit.shop_id = s.store_id""",
)
def w14_stream(spark, sf):
    """Every shop has a timer at each window's end; one of the shops never has an order."""
    root = run_folder(spark, "zeros")
    events = table(spark, sf, "events")
    shops = topic.shops(spark, sf).withColumnRenamed("store_id", "shop_id")
    newest = events.agg(F.max(F.floor(ntz_micros(F.col("ts")) / 1000))).first()[0]
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = BatchTable(spark, f"{root}/windows")
    with keyed_state(spark):
        # windows of the last day
        windows = zero_filled_windows(sales(stream), shops, (newest or 0) - 86_400_000)
        running = J.run_stream(windows, f"{root}/checkpoint", out.write)
    finish(running)
    latest = N.latest_per_shop(out.read())
    return latest.withColumn("total_amount", F.col("total_amount").cast("double"))


@query("w22_repeated_batches_count_once", 'SELECT user_id % 3 AS batch, count(*) AS "rows", count(DISTINCT event_id) AS ids FROM events GROUP BY 1')
def w22(spark, sf):
    out = BatchTable(spark, f"{run_folder(spark, 'batches')}/events")
    events = table(spark, sf, "events").select("event_id", "user_id")
    for batch_id in (0, 1, 1, 2, 0):
        out.write(events.filter(F.col("user_id") % 3 == batch_id), batch_id)
    return out.read().groupBy(F.col("batch_id").alias("batch")).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"))


@query(
    "d7_consume_stream",
    f"""{BASE}, {MESSAGES} SELECT CASE WHEN m.version <> 1 OR j.id IS NULL THEN 'invalid'
        WHEN j.generation <> m.generation OR j.cancel_requested OR j.status IN ('ds_scheduled', 'executing', 'sending', 'sent', 'failed', 'aborted') OR j.generation <> 2 THEN 'duplicate'
        WHEN j.status IN ('publishing', 'dispatching') THEN 'in_progress' WHEN j.status <> 'kafka_queued' THEN 'duplicate'
        WHEN {DONE} IS NOT NULL THEN 'reconciled' ELSE 'dispatch' END AS verdict, count(*) AS n FROM m LEFT JOIN j ON j.id = m.job_id GROUP BY 1""",
)
def d7_stream(spark, sf):
    root = run_folder(spark, "messages")
    messages(spark, sf).write.json(f"{root}/topic")
    stream = spark.readStream.schema("message bigint, value string").json(f"{root}/topic")
    out = BatchTable(spark, f"{root}/verdicts")
    jobs, known = frame(spark, sf, "jobs"), states(spark, sf)

    def judge(batch, batch_id):
        out.write(O.classify_messages(batch, jobs, known, GENERATION, bounded=True).select("message", "verdict"), batch_id)

    finish(J.run_stream(stream, f"{root}/checkpoint", judge))
    return out.read().groupBy("verdict").agg(F.count("*").alias("n"))
