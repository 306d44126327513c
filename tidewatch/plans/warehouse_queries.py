"""Registered queries: change events, warehouse metrics and windows, batch form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.functions import encoding as E
from tidewatch.plans import topic
from tidewatch.plans.registry import query
from tidewatch.session import table
from tidewatch.streaming import warehouse as W
from tidewatch.streaming import windows as N

NOW_MS = 1706659200000  # 2024-01-31 00:00:00 UTC
STEPS = """steps AS (SELECT *, unnest(CASE WHEN event_type = 'click' THEN [0, 1, 2] WHEN event_type = 'view' AND user_id % 2 = 0 THEN [0, 1, 3] ELSE [0, 1] END) AS step FROM events)"""


@query(
    "w1_ods_append",
    f"""WITH {STEPS} SELECT CAST(CAST(date_trunc('second', ts) + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS event_date, CAST(user_id % 3 AS INTEGER) AS topic_partition, event_id * 4 + step AS topic_offset,
        CASE step WHEN 0 THEN 'c' WHEN 3 THEN 'd' ELSE 'u' END AS op, concat('o', event_id) AS order_id, concat('run-', user_id % 3) AS run_id,
        (epoch_us(ts) // 1000) + step AS source_ts, greatest(0, {NOW_MS} - (epoch_us(ts) // 1000) - step) AS latency_ms FROM steps""",
)
def w1(spark, sf):
    now = F.timestamp_millis(F.lit(NOW_MS))
    out = W.ods_rows(topic.raw(spark, sf), now)
    return out.select(
        F.col("event_date").cast("string").alias("event_date"), "topic_partition", "topic_offset", "op", "order_id", "run_id", "source_ts", "latency_ms"
    )


def parsed(spark, sf, spread=False):
    """Change events; the raw payload path is compared in s9 and by the streams."""
    return topic.changes(spark, sf, spread)


def current(spark, sf):
    return W.current_rows(parsed(spark, sf), "id", ["partition", "offset"])


def deltas(spark, sf):
    return W.signed_deltas(W.drop_repeats(parsed(spark, sf), "id"))


def current_sql() -> str:
    """Comparison SQL of the current orders."""
    return f"""WITH {topic.FINAL_SQL} SELECT id AS order_id, run_id, store_id, coalesce(channel, '未知') AS channel, CAST(amount AS DOUBLE) AS amount, status,
        strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS event_time FROM final"""


@query("w2_current_state", current_sql())
def w2(spark, sf):
    out = W.dwd_rows(current(spark, sf))
    return out.select(
        "order_id", "run_id", "store_id", "channel", F.col("amount").cast("double").alias("amount"), "status",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
    )


def _plain(df):
    money = {c: F.col(c).cast("double") for c in ("revenue", "average_ticket") if c in df.columns}
    return df.withColumns(money)


def _rounded_average(keys: str) -> str:
    return (
        f"WITH {topic.FINAL_SQL} SELECT {keys}, count(*) AS order_count, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue, "
        f"CAST((2 * CAST(sum(amount) * 100 AS HUGEINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS average_ticket FROM final WHERE status <> 'CANCELLED' GROUP BY ALL"
    )


@query("w3_store_metrics_from_current", _rounded_average("run_id, store_id"))
def w3_current(spark, sf):
    return _plain(W.group_metrics(current(spark, sf), ["run_id", "store_id"]))


@query("w3_store_metrics_from_deltas", _rounded_average("run_id, store_id"))
def w3_deltas(spark, sf):
    keys = ["run_id", "store_id"]
    return _plain(W.live_metrics(W.delta_totals(deltas(spark, sf), keys), keys))


@query(
    "w4_minute_metrics",
    f"""WITH {topic.FINAL_SQL} SELECT run_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:00') AS metric_minute, count(*) AS order_count, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue
        FROM final WHERE status <> 'CANCELLED' GROUP BY ALL""",
)
def w4(spark, sf):
    keys = ["run_id", "metric_minute"]
    minute = deltas(spark, sf).withColumn("metric_minute", W.metric_minute(F.col("event_time")))
    return _plain(W.live_metrics(W.delta_totals(minute, keys), keys, average=False))


@query("w5_run_metrics", _rounded_average("run_id"))
def w5(spark, sf):
    return _plain(W.live_metrics(W.delta_totals(deltas(spark, sf), ["run_id"]), ["run_id"]))


@query(
    "w7_drop_repeats",
    f"WITH {STEPS} SELECT CASE step WHEN 0 THEN 'c' WHEN 3 THEN 'd' ELSE 'u' END AS op, count(*) AS n FROM steps WHERE step <> 2 GROUP BY 1",
)
def w7(spark, sf):
    return W.drop_repeats(parsed(spark, sf), "id").groupBy("op").agg(F.count("*").alias("n"))


@query(
    "w8_signed_deltas",
    """WITH d AS (SELECT event_id, event_type, user_id, unnest(CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN [1, -1, 1, -1] ELSE [1, -1, 1] END) AS sign FROM events)
       SELECT concat('o', event_id) AS id, CAST(sum(sign) AS BIGINT) AS live, count(*) AS deltas FROM d GROUP BY event_id""",
)
def w8(spark, sf):
    return deltas(spark, sf).groupBy("id").agg(F.sum("sign").alias("live"), F.count("*").alias("deltas"))


SPOILT_SQL = f"""WITH {STEPS} SELECT concat('o', event_id) AS id, event_id * 4 + step AS "offset", CASE step WHEN 0 THEN 'c' WHEN 3 THEN 'd' ELSE 'u' END AS op FROM steps
        WHERE step <> 2 AND step > 0 AND event_type IN ('signup', 'purchase') AND user_id % 8 <> 7"""


def spoilt(spark, sf, clean=None, spread=False):
    """The changes, repeats included unless ``clean`` is given, with wrong before images for some orders."""
    changes = parsed(spark, sf, spread) if clean is None else clean
    spoilt_image = F.col("before").withField("amount", F.lit("-1.00"))
    wrong = (F.col("op") == "u") & (F.col("after.status").isin("PAID", "COMPLETED")) & F.col("before.amount").isNotNull()
    kind = table(spark, sf, "events").filter("event_type IN ('signup', 'purchase')").select(F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("spoil_id"))
    marked = changes.join(kind, F.coalesce(F.col("after.id"), F.col("before.id")) == F.col("spoil_id"), "left")
    return marked.withColumn("before", F.when(wrong & F.col("spoil_id").isNotNull(), spoilt_image).otherwise(F.col("before"))).drop("spoil_id")


@query("w9_before_image_check", SPOILT_SQL)
def w9(spark, sf):
    broken = spoilt(spark, sf, W.drop_repeats(parsed(spark, sf), "id"))
    checked = W.before_image_check(broken, "id", ["offset"])
    return checked.filter(F.col("problem").isNotNull()).select(F.coalesce("after.id", "before.id").alias("id"), "offset", "op")


@query(
    "w10_cumulative_revenue",
    f"""WITH {topic.FINAL_SQL} SELECT s.store_id, CAST(coalesce(sum(f.amount), 0) AS DOUBLE) AS total_revenue FROM {topic.SHOPS_SQL} s LEFT JOIN final f ON f.store_id = s.store_id GROUP BY s.store_id""",
)
def w10(spark, sf):
    out = W.cumulative(deltas(spark, sf), topic.shops(spark, sf), "store_id")
    return out.withColumn("total_revenue", F.col("total_revenue").cast("double"))


# Every change's before and after images as signed rows, in comparison SQL.
SIGNED_SQL = """x AS (SELECT event_id, user_id, event_type, concat('S00', 1 + user_id % 4) AS store_id, (epoch_us(ts) // 1000) AS ms,
    CASE WHEN user_id % 8 = 7 THEN NULL ELSE CAST(value AS DECIMAL(12,2)) END AS a FROM events),
  signed AS (SELECT store_id, ms, 1 AS sign, a AS amount FROM x UNION ALL SELECT store_id, ms, -1, a FROM x UNION ALL SELECT store_id, ms, 1, a + 1 FROM x
    UNION ALL SELECT store_id, ms, -1, a + 1 FROM x WHERE event_type = 'view' AND user_id % 2 = 0),
  panes AS (SELECT store_id, ms // 5000 * 5000 AS pane, CAST(sum(sign) AS BIGINT) AS c, sum(sign * amount) AS a FROM signed GROUP BY 1, 2),
  win AS (SELECT store_id, start AS window_start_ms, start + 300000 AS window_end_ms, CAST(sum(c) AS BIGINT) AS order_count, coalesce(sum(a), 0) AS total_amount
    FROM (SELECT store_id, c, a, unnest(range(pane - 295000, pane + 1, 5000)) AS start FROM panes) GROUP BY 1, 2),
  wm AS (SELECT (max(ms) - 5000) // 5000 * 5000 AS closed FROM signed)"""


def timed(spark, sf):
    return deltas(spark, sf).select("store_id", "sign", "amount", F.col("event_time").alias("event_ms"))


def windows(spark, sf):
    return N.window_totals(timed(spark, sf), "store_id")


@query(
    "w11_sliding_windows",
    f"""WITH {SIGNED_SQL} SELECT store_id, CAST(window_start_ms // 86400000 AS BIGINT) AS day, count(*) AS windows, CAST(sum(order_count) AS BIGINT) AS orders, CAST(sum(total_amount) AS DOUBLE) AS amount,
        max(order_count) AS busiest FROM win GROUP BY 1, 2""",
)
def w11(spark, sf):
    return windows(spark, sf).groupBy("store_id", F.floor(F.col("window_start_ms") / 86400000).alias("day")).agg(
        F.count("*").alias("windows"), F.sum("order_count").alias("orders"),
        F.sum(F.coalesce("total_amount", F.lit(0))).cast("double").alias("amount"), F.max("order_count").alias("busiest"),
    )


@query(
    "w12_closed_windows",
    f"""WITH {SIGNED_SQL} SELECT store_id, count(*) AS closed, CAST(max(window_end_ms) AS BIGINT) AS last_end, (SELECT CAST(closed AS BIGINT) FROM wm) AS watermark_end
        FROM win, wm WHERE window_end_ms <= wm.closed GROUP BY store_id""",
)
def w12(spark, sf):
    rows = timed(spark, sf)
    closed = N.closed_windows(windows(spark, sf), rows)
    end = rows.agg(N.closed_end(F.max("event_ms"))).scalar()
    return closed.groupBy("store_id").agg(F.count("*").alias("closed"), F.max("window_end_ms").alias("last_end")).withColumn("watermark_end", end)


# The newest closed window: its rows, and its end for every shop.
NEWEST_SQL = f"""closed AS (SELECT store_id, window_end_ms, order_count, total_amount FROM win JOIN wm ON win.window_end_ms <= wm.closed {{live}}),
    newest AS (SELECT store_id, window_end_ms, order_count, total_amount FROM (SELECT *, rank() OVER (ORDER BY window_end_ms DESC) AS place FROM closed) WHERE place = 1),
    grid AS (SELECT s.store_id, max(newest.window_end_ms) AS window_end_ms FROM {topic.SHOPS_SQL} s JOIN newest ON true GROUP BY s.store_id)"""


@query(
    "w14_latest_window_zero_filled",
    f"""WITH {SIGNED_SQL}, {NEWEST_SQL.format(live="")}
        SELECT s.store_id, CAST(g.window_end_ms - 300000 AS BIGINT) AS window_start_ms, CAST(g.window_end_ms AS BIGINT) AS window_end_ms, coalesce(n.order_count, 0) AS order_count,
          CAST(coalesce(n.total_amount, 0) AS DOUBLE) AS total_amount
        FROM {topic.SHOPS_SQL} s JOIN grid g ON g.store_id = s.store_id LEFT JOIN newest n ON n.store_id = g.store_id AND n.window_end_ms = g.window_end_ms""",
)
def w14(spark, sf):
    closed = N.closed_windows(windows(spark, sf), timed(spark, sf))
    out = N.latest_window(closed, topic.shops(spark, sf), "store_id")
    return out.withColumn("total_amount", F.col("total_amount").cast("double"))


@query(
    "w14_latest_live_window_zero_filled",
    f"""WITH {SIGNED_SQL}, {NEWEST_SQL.format(live="AND order_count > 0")}
        SELECT s.store_id, CAST(g.window_end_ms AS BIGINT) AS window_end_ms, coalesce(n.order_count, 0) AS order_count, CAST(coalesce(n.total_amount, 0) AS DOUBLE) AS total_amount
        FROM {topic.SHOPS_SQL} s JOIN grid g ON g.store_id = s.store_id LEFT JOIN newest n ON n.store_id = g.store_id AND n.window_end_ms = g.window_end_ms""",
)
def w14_live(spark, sf):
    """The newest closed window in which some shop has live orders."""
    closed = N.closed_windows(windows(spark, sf), timed(spark, sf)).filter("order_count > 0")
    out = N.latest_window(closed, topic.shops(spark, sf), "store_id").drop("window_start_ms")
    return out.withColumn("total_amount", F.col("total_amount").cast("double"))


@query(
    "w15_latest_window_per_shop",
    f"""WITH {SIGNED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY window_end_ms DESC) AS rn FROM win)
        SELECT store_id, CAST(window_start_ms AS BIGINT) AS window_start_ms, CAST(window_end_ms AS BIGINT) AS window_end_ms, order_count, CAST(total_amount AS DOUBLE) AS total_amount FROM r WHERE rn = 1""",
)
def w15(spark, sf):
    out = N.latest_per_shop(windows(spark, sf), "store_id")
    return out.withColumn("total_amount", F.coalesce("total_amount", F.lit(0)).cast("double"))


@query(
    "w16_result_comparison",
    f"""WITH {SIGNED_SQL}, n AS (SELECT count(*) AS shops FROM {topic.SHOPS_SQL} s), live AS (SELECT max(window_end_ms) AS e FROM win, wm WHERE window_end_ms <= closed AND order_count > 0),
          hit AS (SELECT count(*) AS shops FROM win, live WHERE window_end_ms = e AND order_count > 0)
        SELECT 'as computed' AS result, 0 AS missing_rows, 0 AS excess_rows, 1 AS boundaries, true AS passed FROM live WHERE e IS NOT NULL
        UNION ALL SELECT 'one order more', hit.shops, hit.shops, 1, hit.shops = 0 FROM hit
        UNION ALL SELECT 'empty shops left out', n.shops - hit.shops, 0, 1, n.shops = hit.shops FROM n, hit""",
)
def w16(spark, sf):
    """The newest live window against shops and orders, as it is and spoilt in two ways."""
    closed = N.closed_windows(windows(spark, sf), timed(spark, sf)).filter("order_count > 0")
    found = N.latest_window(closed, topic.shops(spark, sf), "store_id")
    orders = current(spark, sf).select("store_id", F.col("event_time").alias("ms"), F.col("amount").cast("decimal(18,2)").alias("amount"))
    newest = timed(spark, sf).agg(N.closed_end(F.max("event_ms"))).scalar()
    # a live order is in the windows that end up to a window's length after it, as far as those are closed
    reach = F.least((F.floor(F.col("ms") / N.SLIDE_MS)) * N.SLIDE_MS + N.LENGTH_MS, newest)
    end = orders.filter(F.col("ms") < newest).agg(F.max(reach)).scalar()
    inside = orders.filter((F.col("ms") >= end - N.LENGTH_MS) & (F.col("ms") < end))
    counts = inside.groupBy("store_id").agg(F.count("*").alias("n"), F.sum("amount").alias("a"))
    expected = topic.shops(spark, sf).join(counts, "store_id", "left").select(
        "store_id", (end - N.LENGTH_MS).alias("window_start_ms"), end.alias("window_end_ms"), F.coalesce("n", F.lit(0)).alias("order_count"),
        F.coalesce("a", F.lit(0)).cast("decimal(18,2)").alias("total_amount"),
    )
    more = found.withColumn("order_count", F.when(F.col("order_count") > 0, F.col("order_count") + 1).otherwise(F.col("order_count")))
    cases = {"as computed": found, "one order more": more, "empty shops left out": found.filter("order_count > 0")}
    rows = [N.check_result(expected, actual).withColumn("result", F.lit(name)) for name, actual in cases.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "w17_upsert_delete_encoding",
    f"""WITH {STEPS}, k AS (SELECT event_id, step, unnest(CASE step WHEN 0 THEN [0] WHEN 3 THEN [1] ELSE [0] END) AS op FROM steps)
        SELECT concat('o', event_id) AS id, op AS "__op", count(*) AS n FROM k GROUP BY 1, 2""",
)
def w17(spark, sf):
    rows = E.encode_operations(E.change_rows(parsed(spark, sf)))
    return rows.groupBy("id", E.OP_COLUMN).agg(F.count("*").alias("n"))


@query(
    "w17_keeping_update_before",
    f"""WITH {STEPS}, k AS (SELECT unnest(CASE step WHEN 0 THEN [0] WHEN 3 THEN [1] ELSE [1, 0] END) AS op FROM steps) SELECT op AS "__op", count(*) AS n FROM k GROUP BY 1""",
)
def w17_before(spark, sf):
    rows = E.encode_operations(E.change_rows(parsed(spark, sf)), ignore_update_before=False)
    return rows.groupBy(E.OP_COLUMN).agg(F.count("*").alias("n"))


@query(
    "w18_primary_key_change",
    """SELECT o_orderkey AS id, 0 AS "__op" FROM orders UNION ALL SELECT o_orderkey + CASE WHEN o_orderstatus = 'P' THEN 1000000 ELSE 0 END, 0 FROM orders
       UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'P'""",
)
def w18(spark, sf):
    df = table(spark, sf, "orders")
    old = F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    moved = F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "P", 1000000).otherwise(0)
    new = F.struct(moved.alias("id"), F.col("o_totalprice").alias("price"))
    none = F.when(F.lit(False), old)
    both = F.array(
        F.struct(F.lit("c").alias("op"), none.alias("before"), old.alias("after")), F.struct(F.lit("u").alias("op"), old.alias("before"), new.alias("after"))
    )
    changes = df.select(F.explode(both).alias("x")).select("x.*")
    return E.encode_operations(E.key_change_rows(changes, "id"), ignore_update_before=False).select("id", E.OP_COLUMN)


SINK_TABLES = ("region", "nation", "customer", "supplier", "orders")
SINK_TYPES = {"bigint": "bigint", "int": "int", "string": "varchar", "double": "double", "timestamp_ntz": "datetime", "timestamp": "datetime", "date": "date"}


@query(
    "w19_sink_schema_check",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS written, '{b}' AS target, CASE WHEN (SELECT count(*) FROM (DESCRIBE {a}) x LEFT JOIN (DESCRIBE {b}) y ON x.column_name = y.column_name AND x.column_type = y.column_type
              WHERE y.column_name IS NULL) > 0 THEN 'refused' ELSE 'aligned' END AS outcome, count(*) AS "rows" FROM {a}"""
        for a in SINK_TABLES for b in SINK_TABLES
    )
    + " UNION ALL SELECT 'nation', 'nation, other order', 'unaligned', count(*) FROM nation UNION ALL SELECT 'nation', 'nation by key', 'unaligned', count(*) FROM nation"
    + " UNION ALL SELECT 'nation', 'nation by another key', 'refused', count(*) FROM nation",
)
def w19(spark, sf):
    """Each table's rows against a target with each table's columns, and variants of one target."""
    tables = {name: table(spark, sf, name) for name in SINK_TABLES}
    targets = {n: [{"name": f.name, "type": SINK_TYPES.get(f.dataType.simpleString(), "json")} for f in df.schema.fields] for n, df in tables.items()}
    nation = targets["nation"]
    keyed = [{**nation[0], "key": True}, *nation[1:]]
    cases = [(a, b, targets[b], None) for a in SINK_TABLES for b in SINK_TABLES]
    cases += [
        ("nation", "nation, other order", nation[::-1], None), ("nation", "nation by key", keyed, [nation[0]["name"]]),
        ("nation", "nation by another key", keyed, [nation[1]["name"]]),
    ]
    out = None
    for written, name, target, key in cases:
        try:
            outcome = "aligned" if E.check_sink_schema(tables[written], target, key) else "unaligned"
        except E.SchemaMismatch:
            outcome = "refused"
        row = tables[written].agg(F.lit(written).alias("written"), F.lit(name).alias("target"), F.lit(outcome).alias("outcome"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "w20_text_lines",
    r"""SELECT event_id || chr(1) || CASE WHEN event_type = 'view' THEN '\N' ELSE event_type END || chr(1) || strftime(ts, '%Y-%m-%d') || chr(1) || '{"u":' || user_id || '}' || chr(1)
        || CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS value FROM events""",
)
def w20(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), F.col("ts").cast("date").alias("day"),
        F.struct(F.col("user_id").alias("u")).alias("nested"), (F.col("user_id") % 2 == 0).alias("even"),
    )
    return E.text_lines(df, "\\x01")


@query(
    "w21_json_lines",
    """SELECT '{"event_id":' || event_id || CASE WHEN event_type = 'view' THEN '' ELSE ',"kind":"' || event_type || '"' END || ',"props":' || replace(props, ' ', '') || ',"tags":["' || event_type || '"],"__op":0}' AS value FROM events""",
)
def w21(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), "props", F.array("event_type").alias("tags"), F.lit(0).alias("__op")
    )
    return E.json_lines(df, ["props"])


@query(
    "w23_empty_groups_disappear",
    """SELECT concat('u', user_id) AS user_key, event_type, count(*) FILTER (WHERE NOT (event_type = 'view' AND user_id % 2 = 0)) AS live FROM events GROUP BY ALL
       HAVING count(*) FILTER (WHERE NOT (event_type = 'view' AND user_id % 2 = 0)) > 0""",
)
def w23(spark, sf):
    df = table(spark, sf, "events")
    gone = (F.col("event_type") == "view") & (F.col("user_id") % 2 == 0)
    signs = F.when(gone, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    rows = df.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_key"), "event_type", F.explode(signs).alias("sign"),
        F.col("value").cast("string").alias("amount"), F.lit("PAID").alias("status"),
    )
    keys = ["user_key", "event_type"]
    return W.live_metrics(W.delta_totals(rows, keys), keys).select(*keys, F.col("order_count").alias("live"))


def store_daily(spark, sf):
    """Daily store figures: one row per customer's day, provinces from nations."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    daily = orders.groupBy(F.col("o_orderdate").cast("date").alias("metric_date"), F.col("o_custkey").alias("store_id")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("gmv"), F.count("*").alias("order_count"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("refund_rate"),
    )
    names = customers.select(F.col("c_custkey").alias("store_id"), F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("province"))
    return daily.join(names, "store_id")


DAILY_SQL = """daily AS (SELECT CAST(o_orderdate AS DATE) AS metric_date, o_custkey AS store_id, any_value('P' || c_nationkey) AS province, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS gmv,
    count(*) AS order_count, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS refund_rate FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query(
    "w24_region_daily",
    f"""WITH {DAILY_SQL} SELECT CAST(metric_date AS VARCHAR) AS metric_date, province, CAST(sum(gmv) AS DOUBLE) AS gmv, CAST(sum(order_count) AS BIGINT) AS order_count, count(*) AS store_count,
        round(avg(refund_rate), 4) AS refund_rate FROM daily GROUP BY 1, 2""",
)
def w24(spark, sf):
    out = W.region_daily(store_daily(spark, sf))
    return out.withColumns({"metric_date": F.col("metric_date").cast("string"), "gmv": F.col("gmv").cast("double")})


@query(
    "w25_brand_daily",
    f"""WITH {DAILY_SQL} SELECT CAST(metric_date AS VARCHAR) AS metric_date, CAST(sum(gmv) AS DOUBLE) AS gmv, CAST(sum(order_count) AS BIGINT) AS order_count, count(*) AS active_store_count,
        CAST((2 * CAST(sum(gmv) * 100 AS HUGEINT) + sum(order_count)) // (2 * sum(order_count)) AS DOUBLE) / 100 AS avg_order_value, round(avg(refund_rate), 4) AS refund_rate FROM daily GROUP BY 1""",
)
def w25(spark, sf):
    out = W.brand_daily(store_daily(spark, sf))
    return out.withColumns({"metric_date": F.col("metric_date").cast("string"), **{c: F.col(c).cast("double") for c in ("gmv", "avg_order_value")}})


AT = datetime(2001, 7, 1)


@query(
    "w26_daily_order_dataset",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS metric_date, o_custkey AS store_id, count(*) AS order_count, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS gmv,
       round(avg(length(o_orderpriority)), 4) AS avg_delivery_minutes FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01' GROUP BY 1, 2""",
)
def w26(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("tw_orders")
    from tidewatch.sources.datasets import scan

    return scan(
        spark,
        f"""SELECT CAST(to_date(o_orderdate) AS STRING) AS metric_date, o_custkey AS store_id, count(*) AS order_count,
              CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS gmv, round(avg(length(o_orderpriority)), 4) AS avg_delivery_minutes
            FROM tw_orders WHERE o_orderdate >= date_sub(DATE '{AT:%Y-%m-%d}', 30) GROUP BY o_orderdate, o_custkey ORDER BY store_id, metric_date""",
    )


@query(
    "w27_daily_store_dataset",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS metric_date, o_custkey AS store_id, o_totalprice AS gmv FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01'""",
)
def w27(spark, sf):
    since = F.date_sub(F.lit(AT.date()), 30)
    rows = table(spark, sf, "orders").filter(F.col("o_orderdate") >= since).orderBy("o_custkey", "o_orderdate")
    return rows.select(F.col("o_orderdate").cast("date").cast("string").alias("metric_date"), F.col("o_custkey").alias("store_id"), F.col("o_totalprice").alias("gmv"))


@query("w28_temperature_dataset", "SELECT event_id, user_id AS license_plate, CAST(value AS DECIMAL(5,2))::DOUBLE AS refrigerated_temperature FROM events")
def w28(spark, sf):
    rows = table(spark, sf, "events").orderBy("ts")
    return rows.select("event_id", F.col("user_id").alias("license_plate"), F.col("value").cast("decimal(5,2)").cast("double").alias("refrigerated_temperature"))


@query(
    "w29_bounded_sql",
    """SELECT 'all' AS what, CAST(count(*) AS DOUBLE) AS n FROM orders UNION ALL SELECT 'none', count(*) FROM orders WHERE o_totalprice < 0
       UNION ALL SELECT 'not equal', count(*) FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F'
       UNION ALL SELECT 'paid sum', sum(CAST(o_totalprice AS DECIMAL(12,2))) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'joined', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       UNION ALL SELECT 'first', 1""",
)
def w29(spark, sf):
    from tidewatch.sources.datasets import register_tables, scan

    register_tables(spark, sf, ["orders", "lineitem"])
    return scan(
        spark,
        """WITH paid AS (SELECT o_orderstatus, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total, count(*) AS n FROM orders GROUP BY o_orderstatus)
           SELECT 'all' AS what, CAST(count(*) AS DOUBLE) AS n FROM orders
           UNION ALL SELECT 'none', count(*) FROM orders WHERE o_totalprice < 0
           UNION ALL SELECT 'not equal', count(*) FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F'
           UNION ALL SELECT 'paid sum', CAST(total AS DOUBLE) FROM paid WHERE o_orderstatus = 'O'
           UNION ALL SELECT 'joined', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           UNION ALL SELECT 'first', count(*) FROM (SELECT o_orderkey FROM orders LIMIT 1)""",
    )
