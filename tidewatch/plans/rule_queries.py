"""Registered queries: conditions, evidence and baselines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import anomalies as A
from tidewatch.operators.baselines import attach_baselines, baseline_name, day_of, split_entity_and_time
from tidewatch.operators.conditions import Condition
from tidewatch.operators.day_partials import DayPartials
from tidewatch.operators.rules import Rule, evaluate, run_summary
from tidewatch.plans.registry import query
from tidewatch.session import materialise, scratch_dir, table

C = Condition


def matching(df: DataFrame, keys: list[str], conditions: list[Condition], logic: str = "AND") -> DataFrame:
    return evaluate(df, Rule("rule", conditions, keys, logic=logic), keys)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def gappy_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with nulls: no price in status F, no priority text in status O."""
    return orders(spark, sf).select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("priority"),
    )


GAPPY = """(SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS priority FROM orders) g"""


def _single(name: str, condition: Condition, where: str) -> None:
    @query(name, f"SELECT o_orderkey, price, priority FROM {GAPPY} WHERE {where}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return matching(gappy_orders(spark, sf), ["o_orderkey"], [condition]).select("o_orderkey", "price", "priority")


_single("p1_gt", C("price", "gt", 400000), "price > 400000")
_single("p2_gte", C("price", "gte", 400000.5), "price >= 400000.5")
_single("p3_lt", C("price", "lt", 50000), "price < 50000")
_single("p4_lte", C("price", "lte", 50000), "price <= 50000")
_single("p5_eq", C("priority", "eq", "1-URGENT"), "priority = '1-URGENT'")
_single("p6_neq_null_is_false", C("priority", "neq", "1-URGENT"), "priority IS NOT NULL AND priority <> '1-URGENT'")
_single("p7_between", C("price", "between", 100000, 200000), "price BETWEEN 100000 AND 200000")
_single("p8_is_null", C("price", "is_null"), "price IS NULL")
_single("p9_is_not_null", C("price", "is_not_null"), "price IS NOT NULL")
_single("p12_text_literal_as_number", C("price", "lt", "3.5e4"), "price < 35000.0")


@query(
    "p10_two_valued_or",
    f"SELECT o_orderkey FROM {GAPPY} WHERE coalesce(price > 300000, false) OR coalesce(priority <> '5-LOW', false)",
)
def two_valued_or(spark, sf):
    conditions = [C("price", "gt", 300000), C("priority", "neq", "5-LOW")]
    return matching(gappy_orders(spark, sf), ["o_orderkey"], conditions, "OR").select("o_orderkey")


@query(
    "p11_field_operands",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_discount FROM lineitem
       WHERE l_tax > l_discount AND l_quantity BETWEEN l_linenumber AND 10""",
)
def field_operands(spark, sf):
    conditions = [
        C("l_tax", "gt", value_source="field", value_field="l_discount"),
        C("l_quantity", "between", value_source="field", value_field="l_linenumber", upper_value=10),
    ]
    keys = ["l_orderkey", "l_linenumber"]
    return matching(lineitem(spark, sf), keys, conditions).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_discount"
    )


@query(
    "p12_text_field_as_number",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
       WHERE l_quantity >= CAST(CAST(l_linenumber * 7 AS VARCHAR) AS DOUBLE)""",
)
def text_field(spark, sf):
    df = lineitem(spark, sf).withColumn("floor_text", (F.col("l_linenumber") * 7).cast("string"))
    out = matching(df, ["l_orderkey", "l_linenumber"], [C("l_quantity", "gte", value_source="field", value_field="floor_text")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "p13_decimal_as_double",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) > CAST(o_orderkey AS DOUBLE) * 20.5""",
)
def decimal_as_double(spark, sf):
    df = orders(spark, sf).select(
        "o_orderkey", "o_totalprice", F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        (F.col("o_orderkey") * 20.5).alias("bound"),
    )
    out = matching(df, ["o_orderkey"], [C("price", "gt", value_source="field", value_field="bound")])
    return out.select("o_orderkey", "o_totalprice")


@query(
    "p14_compatible_types",
    """SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderstatus = 'O'
       AND o_custkey = o_orderkey % 1000""",
)
def compatible_types(spark, sf):
    from datetime import datetime

    df = orders(spark, sf).withColumn("slot", (F.col("o_orderkey") % 1000).cast("int"))
    conditions = [
        C("o_orderdate", "gte", datetime(1998, 1, 1)),
        C("o_orderstatus", "eq", "O"),
        C("o_custkey", "eq", value_source="field", value_field="slot"),
    ]
    return matching(df, ["o_orderkey"], conditions).select("o_orderkey")


@query(
    "p15_missing_field_is_refused",
    """SELECT c.condition_field, CASE WHEN t.column_name IS NULL THEN 'refused' ELSE 'accepted' END AS outcome,
         CASE WHEN t.column_name IS NULL THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_totalprice > 0) END AS matched
       FROM (VALUES ('o_totalprice'), ('o_price')) c(condition_field)
       LEFT JOIN (SELECT column_name FROM (DESCRIBE orders)) t ON t.column_name = c.condition_field""",
)
def missing_field(spark, sf):
    df = orders(spark, sf)
    rows = None
    for name in ("o_totalprice", "o_price"):
        try:
            found = matching(df, ["o_orderkey"], [C(name, "gt", 0)])
            row = found.agg(F.lit(name).alias("condition_field"), F.lit("accepted").alias("outcome"), F.count("*").alias("matched"))
        except ValueError:
            none = F.count_if(F.col("o_totalprice") < F.col("o_totalprice"))
            row = df.agg(F.lit(name).alias("condition_field"), F.lit("refused").alias("outcome"), none.alias("matched"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    "p16_and_combination",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.02 AND l_returnflag = 'R'",
)
def and_combination(spark, sf):
    conditions = [C("l_quantity", "gte", 45), C("l_discount", "lt", 0.02), C("l_returnflag", "eq", "R")]
    return matching(lineitem(spark, sf), ["l_orderkey", "l_linenumber"], conditions).select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "p16_or_combination",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 49 OR l_extendedprice < 2000",
)
def or_combination(spark, sf):
    conditions = [C("l_quantity", "gte", 49), C("l_extendedprice", "lt", 2000)]
    return matching(lineitem(spark, sf), ["l_orderkey", "l_linenumber"], conditions, "OR").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "p17_evidence",
    """SELECT l_orderkey, l_linenumber, l_partkey, field, operator, resolved_value, actual_number, evidence_rows FROM (
         SELECT l.*, 'l_tax' AS field, 'gt' AS operator, l_discount AS resolved_value, l_tax AS actual_number,
           (CASE WHEN l_tax > l_discount THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS evidence_rows
         FROM lineitem l WHERE l_tax > l_discount
         UNION ALL
         SELECT l.*, 'l_quantity', 'gte', 45.0, l_quantity,
           (CASE WHEN l_tax > l_discount THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END)
         FROM lineitem l WHERE l_quantity >= 45)""",
)
def evidence(spark, sf):
    conditions = [C("l_tax", "gt", value_source="field", value_field="l_discount"), C("l_quantity", "gte", 45)]
    out = matching(lineitem(spark, sf), ["l_orderkey", "l_linenumber"], conditions, "OR")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.size("matched_conditions").alias("evidence_rows"),
        F.explode("matched_conditions").alias("e"),
    ).select(
        "l_orderkey", "l_linenumber", "l_partkey", "e.field", "e.operator", F.col("e.resolved_value").cast("double").alias("resolved_value"),
        F.col("e.actual").cast("double").alias("actual_number"), "evidence_rows",
    )


@query(
    "p18_business_key",
    """SELECT '{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_returnflag":"' || l_returnflag || '"}' AS business_key,
       l_partkey FROM lineitem WHERE l_quantity >= 48""",
)
def business_key(spark, sf):
    out = matching(lineitem(spark, sf), ["l_orderkey", "l_linenumber", "l_returnflag"], [C("l_quantity", "gte", 48)])
    return out.select("business_key", "l_partkey")


@query(
    "p19_rule_evaluation",
    """SELECT count(*) AS matched, count(DISTINCT l_orderkey * 10 + l_linenumber) AS keys, min(l_partkey) AS first_part,
         sum(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS by_quantity
       FROM lineitem WHERE l_quantity >= 45 OR l_discount = 0""",
)
def rule_evaluation(spark, sf):
    out = matching(lineitem(spark, sf), ["l_orderkey", "l_linenumber"], [C("l_quantity", "gte", 45), C("l_discount", "eq", 0)], "OR")
    return out.agg(
        F.count("*").alias("matched"), F.count_distinct("business_key").alias("keys"), F.min("l_partkey").alias("first_part"),
        F.count_if(F.exists("matched_conditions", lambda c: c["field"] == "l_quantity")).alias("by_quantity"),
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """First run of a rule over line items: one anomaly record per business key."""
    rule = Rule(
        "bulk-without-discount",
        [C("l_quantity", "gte", 45), C("l_discount", "lt", 0.02)],
        ["l_orderkey", "l_linenumber"],
        name="Bulk without discount",
        dataset_name="lineitem",
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    matches = evaluate(lineitem(spark, sf), rule, order)
    folded = A.fold_matches(matches, order)
    merged = A.merge_matches(A.empty_records(spark), folded, rule, "run-1", "2024-01-01 00:00:00")
    return merged.filter("is_new").select(
        "business_key", "fingerprint", "hit_count", "status", "severity", F.size("matched_conditions").alias("evidence_rows")
    )


query(
    "flagship_rule_to_records",
    """SELECT k AS business_key, sha256(k) AS fingerprint, count(*) AS hit_count, 'pending' AS status, 'medium' AS severity, 2 AS evidence_rows
       FROM (SELECT '{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || '}' AS k FROM lineitem
             WHERE l_quantity >= 45 AND l_discount < 0.02) GROUP BY k""",
)(flagship)


@query(
    "a6_run_summary",
    """SELECT 'run-1' AS run_id, 'success' AS status, (SELECT count(*) FROM lineitem) AS scanned_rows,
         count(*) AS matched_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS new_anomalies
       FROM lineitem WHERE l_quantity >= 45""",
)
def summary(spark, sf):
    df = lineitem(spark, sf)
    rule = Rule("bulk", [C("l_quantity", "gte", 45)], ["l_orderkey", "l_linenumber"])
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    folded = materialise(A.fold_matches(evaluate(df, rule, order), order), "folded")
    merged = A.merge_matches(A.empty_records(spark), folded, rule, "run-1", "2024-01-01 00:00:00")
    return run_summary(df, folded, merged.filter("is_new"), rule, "run-1").select(
        "run_id", "status", "scanned_rows", "matched_rows", "new_anomalies"
    )


# --- baselines -------------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose value is unknown when it ends on a whole amount."""
    return events(spark, sf).withColumn("value", F.when(F.col("value") != F.floor("value"), F.col("value")))


def _trailing(days: int, entity: str, time: str, value: str, source: str) -> str:
    """SQL with the trailing mean over rows and the number of distinct days."""
    part = f"PARTITION BY {entity} " if entity else ""
    keys = f"{entity}, " if entity else ""
    join = f"h.{entity} IS NOT DISTINCT FROM s.{entity} AND " if entity else ""
    return f"""WITH s AS (SELECT *, CAST({time} AS DATE) AS day FROM {source}),
      d AS (SELECT {keys}day, sum({value}) AS s, count({value}) AS n FROM s WHERE day IS NOT NULL GROUP BY {keys}day),
      h AS (SELECT {keys}day, sum(s) OVER w / sum(n) OVER w AS base, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER w AS days
            FROM d WINDOW w AS ({part}ORDER BY day RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
      b AS (SELECT s.*, CASE WHEN h.days >= {days} THEN h.base END AS baseline FROM s LEFT JOIN h ON {join}h.day = s.day)"""


GAPPY_EVENTS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN value <> floor(value) THEN value END AS value FROM events)"


def _ratio(df, entity_and_time, field, operator, ratio, baseline, order):
    rule = Rule("ratio", [C(field, operator, ratio, baseline=baseline)], entity_and_time)
    out = evaluate(df, rule, order)
    return out.withColumn("baseline", F.round(F.col("matched_conditions")[0]["baseline_value"], 6))


@query(
    "b1_entity_and_time_split",
    _trailing(7, "event_type", "ts", "value", "events")
    + " SELECT event_type, count(*) AS with_baseline, min(day) AS first_day FROM b WHERE baseline IS NOT NULL GROUP BY event_type",
)
def entity_split(spark, sf):
    df = attach_baselines(events(spark, sf), [("value", "7d_avg")], ["event_type"], "ts", ["ts", "event_id"])
    day = F.col("ts").cast("date")
    return df.filter(F.col(baseline_name("value", "7d_avg")).isNotNull()).groupBy("event_type").agg(
        F.count("*").alias("with_baseline"), F.min(day).alias("first_day")
    )


@query(
    "b2_day_extraction",
    """SELECT CAST(t AS VARCHAR) AS day, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS t FROM events) GROUP BY 1""",
)
def day_extraction(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    mixed = F.when(F.col("event_type") == "error", F.lit("2024-1-1")).when(
        F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd")
    ).otherwise(text)
    df = events(spark, sf).select(mixed.alias("t"))
    day = day_of(F.col("t"), df.schema["t"].dataType)
    return df.groupBy(day.cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(
    "b3_previous_period",
    f"""WITH s AS (SELECT *, CAST(ts AS DATE) AS day FROM {GAPPY_EVENTS}),
      l AS (SELECT user_id, day, value AS last_value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS rn FROM s) WHERE rn = 1),
      h AS (SELECT user_id, day, lag(last_value) OVER (PARTITION BY user_id ORDER BY day) AS base FROM l)
      SELECT s.event_id, s.value, round(h.base, 6) AS baseline FROM s JOIN h ON s.user_id = h.user_id AND s.day = h.day
      WHERE h.base IS NOT NULL AND s.value > h.base * 5""",
)
def previous_period(spark, sf):
    out = _ratio(with_gaps(spark, sf), ["user_id", "ts"], "value", "gt_threshold_ratio", 5, "prev_period", ["ts", "event_id"])
    return out.select("event_id", "value", "baseline")


@query(
    "b4_seven_day_average",
    _trailing(7, "event_type", "ts", "value", GAPPY_EVENTS)
    + " SELECT event_id, value, round(baseline, 6) AS baseline FROM b WHERE baseline IS NOT NULL AND value > baseline * 3",
)
def seven_day(spark, sf):
    out = _ratio(with_gaps(spark, sf), ["event_type", "ts"], "value", "gt_threshold_ratio", 3, "7d_avg", ["ts", "event_id"])
    return out.select("event_id", "value", "baseline")


@query(
    "b5_thirty_day_average",
    _trailing(30, "", "o_orderdate", "o_totalprice", "orders")
    + " SELECT o_orderkey, o_totalprice, round(baseline, 4) AS baseline FROM b WHERE baseline IS NOT NULL AND o_totalprice > baseline * 1.9",
)
def thirty_day(spark, sf):
    out = _ratio(orders(spark, sf), ["o_orderdate"], "o_totalprice", "gt_threshold_ratio", 1.9, "30d_avg", ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", "o_totalprice", F.round(F.col("matched_conditions")[0]["baseline_value"], 4).alias("baseline"))


def _stored(spark, df, rule, fields, late, order, days):
    """The rule over the newest rows, with days stored in three batches, rows for old days in the last."""
    entity, time = split_entity_and_time(df.schema, rule.key_fields)
    partials = DayPartials(spark, f"{scratch_dir(spark)}/days-{uuid.uuid4().hex}", entity, time, fields, order, buckets=1, days=days)
    cut = df.agg(F.min(time) + (F.max(time) - F.min(time)) / 2).scalar()
    early = F.col(time) < cut
    for batch_id, part in enumerate((df.filter(early & ~late), df.filter(~early & ~late), df.filter(late))):
        partials.add(part, batch_id)
    return evaluate(df, rule, order, partials)


@query(
    "b4_seven_day_average_stored",
    _trailing(7, "event_type", "ts", "value", GAPPY_EVENTS)
    + " SELECT event_id, value, round(baseline, 6) AS baseline FROM b WHERE baseline IS NOT NULL AND value > baseline * 3",
)
def seven_day_stored(spark, sf):
    rule = Rule("ratio", [C("value", "gt_threshold_ratio", 3, baseline="7d_avg")], ["event_type", "ts"])
    out = _stored(spark, with_gaps(spark, sf), rule, ["value"], F.col("event_id") % 7 == 0, ["ts", "event_id"], 1)
    return out.select("event_id", "value", F.round(F.col("matched_conditions")[0]["baseline_value"], 6).alias("baseline"))


@query(
    "b5_thirty_day_average_stored",
    _trailing(30, "", "o_orderdate", "o_totalprice", "orders")
    + " SELECT o_orderkey, o_totalprice, round(baseline, 4) AS baseline FROM b WHERE baseline IS NOT NULL AND o_totalprice > baseline * 1.9",
)
def thirty_day_stored(spark, sf):
    rule = Rule("ratio", [C("o_totalprice", "gt_threshold_ratio", 1.9, baseline="30d_avg")], ["o_orderdate"])
    out = _stored(spark, orders(spark, sf), rule, ["o_totalprice"], F.col("o_orderkey") % 7 == 0, ["o_orderdate", "o_orderkey"], 30)
    return out.select("o_orderkey", "o_totalprice", F.round(F.col("matched_conditions")[0]["baseline_value"], 4).alias("baseline"))


@query(
    "b6_gt_threshold_ratio_daily",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS metric_date, round(sum(value), 2) AS total FROM events GROUP BY 1, 2),
      h AS (SELECT *, avg(total) OVER w AS base, count(*) OVER w AS days FROM d
        WINDOW w AS (PARTITION BY event_type ORDER BY metric_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
      SELECT event_type, CAST(metric_date AS VARCHAR) AS metric_date, total, round(base, 4) AS baseline FROM h WHERE days >= 7 AND total > base * 1.1""",
)
def gt_ratio_daily(spark, sf):
    daily = events(spark, sf).groupBy("event_type", F.col("ts").cast("date").alias("metric_date")).agg(F.round(F.sum("value"), 2).alias("total"))
    out = _ratio(daily, ["event_type", "metric_date"], "total", "gt_threshold_ratio", 1.1, "7d_avg", ["metric_date"])
    return out.select("event_type", F.col("metric_date").cast("string").alias("metric_date"), "total", F.round("baseline", 4).alias("baseline"))


@query(
    "b7_lt_threshold_ratio",
    _trailing(7, "event_type", "ts", "value", "events")
    + " SELECT event_id, value, round(baseline, 6) AS baseline FROM b WHERE baseline IS NOT NULL AND value < baseline * 0.05",
)
def lt_ratio(spark, sf):
    out = _ratio(events(spark, sf), ["event_type", "ts"], "value", "lt_threshold_ratio", 0.05, "7d_avg", ["ts", "event_id"])
    return out.select("event_id", "value", "baseline")


@query(
    "b8_ratio_from_row",
    _trailing(7, "event_type", "ts", "value", "(SELECT *, 1 + user_id % 4 AS factor FROM events)")
    + " SELECT event_id, value, factor FROM b WHERE baseline IS NOT NULL AND value > baseline * factor",
)
def ratio_from_row(spark, sf):
    df = events(spark, sf).withColumn("factor", 1 + F.col("user_id") % 4)
    condition = C("value", "gt_threshold_ratio", value_source="field", value_field="factor", baseline="7d_avg")
    return evaluate(df, Rule("ratio", [condition], ["event_type", "ts"]), ["ts", "event_id"]).select("event_id", "value", "factor")


@query(
    "b9_null_entity_is_a_group",
    _trailing(7, "kind", "ts", "value", "(SELECT *, nullif(event_type, 'view') AS kind FROM events)")
    + " SELECT event_id, kind, value FROM b WHERE baseline IS NOT NULL AND value > baseline * 4",
)
def null_entity(spark, sf):
    df = events(spark, sf).withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type")))
    out = evaluate(df, Rule("ratio", [C("value", "gt_threshold_ratio", 4, baseline="7d_avg")], ["kind", "ts"]), ["ts", "event_id"])
    return out.select("event_id", "kind", "value")


def _has_operator(operator: str):
    return lambda c: c["operator"] == operator


@query(
    "b10_missing_baseline_under_or",
    _trailing(7, "event_type", "ts", "value", "events")
    + """ SELECT event_id, CASE WHEN baseline IS NOT NULL AND value > baseline * 4 THEN 1 ELSE 0 END AS by_ratio,
          CASE WHEN value > 250 THEN 1 ELSE 0 END AS by_value FROM b
          WHERE (baseline IS NOT NULL AND value > baseline * 4) OR value > 250""",
)
def missing_baseline(spark, sf):
    conditions = [C("value", "gt_threshold_ratio", 4, baseline="7d_avg"), C("value", "gt", 250)]
    out = evaluate(events(spark, sf), Rule("either", conditions, ["event_type", "ts"], logic="OR"), ["ts", "event_id"])
    by = {name: F.exists("matched_conditions", _has_operator(op)).cast("int").alias(name)
          for name, op in (("by_ratio", "gt_threshold_ratio"), ("by_value", "gt"))}
    return out.select("event_id", by["by_ratio"], by["by_value"])


