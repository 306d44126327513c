"""A change topic derived from ``events``: every event is an order's life.

An order is created, then updated (one more in amount, new status); a repeat of
the update arrives for clicks, and some viewed orders are deleted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.values import ntz_micros
from tidewatch.session import table

SHOPS_SQL = "(SELECT concat('S00', r_regionkey + 1) AS store_id FROM region)"

# The orders as they stand after all changes, in comparison SQL.
FINAL_SQL = """final AS (SELECT concat('o', event_id) AS id, concat('run-', user_id % 3) AS run_id, concat('S00', 1 + user_id % 4) AS store_id,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'web' END AS channel, props AS items,
    CASE WHEN user_id % 8 = 7 THEN NULL ELSE CAST(value AS DECIMAL(12,2)) + 1 END AS amount,
    CASE event_type WHEN 'error' THEN 'CANCELLED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'PAID' END AS status,
    ts, (epoch_us(ts) // 1000) AS event_time FROM events WHERE NOT (event_type = 'view' AND user_id % 2 = 0))"""


def order_row(status, bump: int):
    amount = F.when(F.col("user_id") % 8 != 7, (F.col("value").cast("decimal(12,2)") + F.lit(bump).cast("decimal(12,2)")).cast("decimal(12,2)"))
    null = F.lit(None).cast("string")
    return F.struct(
        F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("run-"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("SEED-"), F.col("event_id").cast("string")).alias("order_no"),
        F.concat(F.lit("S00"), (1 + F.col("user_id") % 4).cast("string")).alias("store_id"),
        F.when(F.col("user_id") % 5 != 0, "web").alias("channel"),
        F.col("props").alias("items"),
        amount.cast("string").alias("amount"),
        status.alias("status"),
        F.floor(ntz_micros(F.col("ts")) / 1000).alias("event_time"),
        null.alias("created_at"),
        null.alias("updated_at"),
    )


def changes(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    """Parsed change events in topic order.

    Events are small as files and large as messages: ``spread`` deals them out to as many tasks as the cores can
    run several times over, whatever number of files they come in.
    """
    repeats, deletes = F.col("event_type") == "click", (F.col("event_type") == "view") & (F.col("user_id") % 2 == 0)
    numbers = F.when(repeats, F.array(*map(F.lit, (0, 1, 2)))).when(deletes, F.array(*map(F.lit, (0, 1, 3)))).otherwise(
        F.array(*map(F.lit, (0, 1)))
    )
    events = table(spark, sf, "events")
    if spread:
        events = events.repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    df = events.withColumn("step", F.explode(numbers))
    step = F.col("step")
    created = order_row(F.lit("CREATED"), 0)
    status = F.when(F.col("event_type") == "error", "CANCELLED").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("PAID")
    updated = order_row(status, 1)
    micros, offset = ntz_micros(F.col("ts")), F.col("event_id") * 4
    position = offset + F.when(step == 2, 1).otherwise(step)
    return df.select(
        F.when(step == 0, "c").when(step == 3, "d").otherwise("u").alias("op"),
        (F.floor(micros / 1000) + step).alias("ts_ms"),
        F.when(step.isin(1, 2), created).when(step == 3, updated).alias("before"),
        F.when(step == 0, created).when(step.isin(1, 2), updated).alias("after"),
        F.struct(F.lit(1).alias("server_id"), F.lit("log.000001").alias("file"), position.alias("pos"), F.lit(0).alias("row")).alias("source"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
        (offset + step).alias("offset"),
        F.timestamp_micros(micros).alias("timestamp"),
    )


def raw(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    """The same as raw topic records with a text payload."""
    body = F.to_json(F.struct("op", "ts_ms", "before", "after", "source"), {"ignoreNullFields": "false"})
    return changes(spark, sf, spread).select(body.alias("value"), "partition", "offset", "timestamp")


def shops(spark: SparkSession, sf: str) -> DataFrame:
    """Known shops, one of them without any order."""
    return table(spark, sf, "region").select(F.concat(F.lit("S00"), (F.col("r_regionkey") + 1).cast("string")).alias("store_id"))
