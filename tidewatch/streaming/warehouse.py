"""Warehouse operators on change events; the same code serves batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.skew import previous

# Label of a missing channel, cancelled status, warehouse zone.
UNKNOWN_CHANNEL = "未知"
CANCELLED = "CANCELLED"
ZONE = "Asia/Shanghai"
MONEY = "decimal(18,2)"
OPS = ("c", "u", "d", "r")


def _scalar(text: Column) -> Column:
    """A scalar JSON value as text; objects and arrays count as missing."""
    nested = text.startswith("{") | text.startswith("[")
    return F.when(~F.coalesce(nested, F.lit(False)), text)


def local_time(millis: Column, zone: str = ZONE) -> Column:
    """Wall-clock time of an epoch-millisecond instant in ``zone``, whatever the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (millis.cast("decimal(18,0)") / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,6)")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), epoch + F.make_dt_interval(secs=seconds))


def ods_rows(raw: DataFrame, now: Column | None = None, zone: str = ZONE) -> DataFrame:
    """The event log: one row per raw record of a known operation."""
    at = now if now is not None else F.current_timestamp()
    keys = "struct<id:string,run_id:string>"
    event = F.from_json("value", f"op string, ts_ms string, before {keys}, after {keys}")
    # one-element explode: the filter stays above it, so a payload is parsed once
    parsed = raw.select("*", F.explode(F.array(event)).alias("event"))
    source_ts = _scalar(F.col("event.ts_ms")).cast("bigint")

    def either(name: str) -> Column:
        return F.coalesce(_scalar(F.col(f"event.after.{name}")), _scalar(F.col(f"event.before.{name}")))

    return parsed.filter(F.col("event.op").isin(*OPS)).select(
        local_time(F.floor(source_ts / 1000) * 1000, zone).cast("date").alias("event_date"),
        F.col("partition").alias("topic_partition"),
        F.col("offset").alias("topic_offset"),
        F.col("event.op").alias("op"),
        either("id").alias("order_id"),
        either("run_id").alias("run_id"),
        source_ts.alias("source_ts"),
        F.col("timestamp").alias("kafka_ts"),
        at.alias("processed_at"),
        F.greatest(F.lit(0).cast("bigint"), F.unix_timestamp(at) * 1000 - source_ts).alias("latency_ms"),
        F.col("value").alias("payload"),
    )


def drop_repeats(changes: DataFrame, key: str) -> DataFrame:
    """Drop repeated deliveries: same key and same log position."""
    key_value = F.coalesce(F.col(f"after.{key}"), F.col(f"before.{key}"))
    marked = changes.withColumns(
        {
            "__key": key_value.cast("string"),
            "__server": F.col("source.server_id"),
            "__file": F.col("source.file"),
            "__pos": F.col("source.pos"),
            "__row": F.col("source.row"),
        }
    )
    marks = ["__key", "__server", "__file", "__pos", "__row"]
    return marked.dropDuplicates(marks).drop(*marks)


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Each change as rows to add (+1) or take away (-1)."""
    both = changes.select("op", "before", "after", F.explode(F.array(F.lit(-1), F.lit(1))).alias("sign"))
    removes = (F.col("sign") == -1) & F.col("op").isin("u", "d")
    adds = (F.col("sign") == 1) & F.col("op").isin("c", "r", "u")
    image = F.when(removes, F.col("before")).when(adds, F.col("after"))
    return both.select("sign", image.alias("row")).filter(F.col("row").isNotNull()).select("sign", "row.*")


def current_rows(changes: DataFrame, key: str, order: list[str], with_marks: bool = False) -> DataFrame:
    """Last image per key; keys whose last change is a delete disappear.

    A mergeable maximum, so neither a hot key nor a long history is gathered.
    ``with_marks`` keeps the deleted keys and the order of the last change.
    """
    key_value = F.coalesce(F.col(f"after.{key}"), F.col(f"before.{key}"))
    position = F.when(F.col("op").isin(*OPS), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]))
    last = changes.groupBy(key_value.alias("__key")).agg(
        F.max_by(F.struct(F.col("op"), F.col("after")), position).alias("__last"), F.max(position).alias("__order")
    ).filter(F.col("__order").isNotNull())
    if with_marks:
        return last.select(
            F.col("__key").alias("key"), (F.col("__last.op") == "d").alias("deleted"),
            F.col("__last.after").alias("row"), F.col("__order").alias("order"),
        )
    return last.filter(F.col("__last.op") != "d").select("__last.after.*")


def dwd_rows(current: DataFrame, now: Column | None = None, zone: str = ZONE) -> DataFrame:
    """Current orders with channel default and local event time."""
    return current.select(
        F.col("id").alias("order_id"), "run_id", "order_no", "store_id",
        F.coalesce("channel", F.lit(UNKNOWN_CHANNEL)).alias("channel"), "items",
        F.col("amount").cast("decimal(12,2)").alias("amount"), "status",
        local_time(F.col("event_time"), zone).alias("event_time"),
        (now if now is not None else F.current_timestamp()).alias("processed_at"),
    )


def metric_minute(event_millis: Column, zone: str = ZONE) -> Column:
    """Minute text of an event time; late events keep their own minute."""
    return F.date_format(local_time(event_millis, zone), "yyyy-MM-dd HH:mm:00")


def delta_totals(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable per-group totals of signed rows (cancelled ones left out)."""
    sign = F.col("sign")
    amount = F.col("amount").cast("decimal(12,2)")
    return (
        deltas.filter(F.col("status") != CANCELLED)
        .groupBy(*keys)
        .agg(
            F.sum(sign.cast("bigint")).alias("order_count"),
            F.sum(F.when(amount.isNotNull(), sign.cast("bigint")).otherwise(0)).alias("priced_count"),
            F.sum(sign * amount).alias("amount_sum"),
        )
    )


def merge_totals(totals: DataFrame, keys: list[str]) -> DataFrame:
    return totals.groupBy(*keys).agg(
        F.sum("order_count").alias("order_count"), F.sum("priced_count").alias("priced_count"),
        F.sum("amount_sum").alias("amount_sum"),
    )


def live_metrics(totals: DataFrame, keys: list[str], average: bool = True) -> DataFrame:
    """Finished metrics; groups that fell back to zero rows disappear.

    Revenue is zero when no amount is known, while the average ticket stays
    null; orders without amount still count in the average's divisor.
    """
    known = F.col("priced_count") > 0
    revenue = F.when(known, F.col("amount_sum")).otherwise(F.lit(0)).cast(MONEY)
    ticket = F.when(known, (F.col("amount_sum") / F.col("order_count")).cast(MONEY))
    columns = [*keys, "order_count", revenue.alias("revenue")]
    if average:
        columns.append(ticket.alias("average_ticket"))
    return totals.filter(F.col("order_count") > 0).select(*columns)


def group_metrics(rows: DataFrame, keys: list[str], average: bool = True) -> DataFrame:
    """The same metrics straight from current rows."""
    return live_metrics(delta_totals(rows.withColumn("sign", F.lit(1)), keys), keys, average)


def before_image_check(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each change with ``problem`` when its before image is not the current row."""
    keyed = changes.withColumn("__key", F.coalesce(F.col(f"after.{key}"), F.col(f"before.{key}")))
    state = keyed.withColumn("__state", F.when(F.col("op") != "d", F.col("after")))
    linked = previous(state, ["__key"], order, ["__state"], "__prev_")
    wrong = F.col("op").isin("u", "d") & ~F.col("before").eqNullSafe(F.col("__prev___state"))
    problem = F.when(wrong, F.lit("before image does not match the current row"))
    return linked.withColumn("problem", problem).drop("__key", "__state", "__prev___state", "has_prev")


def cumulative(deltas: DataFrame, shops: DataFrame, shop: str = "shop_id", amount: str = "amount") -> DataFrame:
    """Revenue of the current orders per shop, every known shop present."""
    totals = deltas.groupBy(shop).agg(F.sum(F.col("sign") * F.col(amount).cast(MONEY)).alias("total"))
    return shops.select(shop).join(totals, shop, "left").select(
        shop, F.coalesce("total", F.lit(0)).cast(MONEY).alias("total_revenue")
    )


def region_daily(store_daily: DataFrame) -> DataFrame:
    """Per day and province: sums, stores and the mean refund rate."""
    return store_daily.groupBy("metric_date", "province").agg(
        F.round(F.sum("gmv"), 2).alias("gmv"),
        F.sum("order_count").alias("order_count"),
        F.count(F.lit(1)).alias("store_count"),
        F.round(F.avg("refund_rate"), 4).alias("refund_rate"),
    )


def brand_daily(store_daily: DataFrame) -> DataFrame:
    """Per day: sums, stores, order value and the mean refund rate."""
    return store_daily.groupBy("metric_date").agg(
        F.round(F.sum("gmv"), 2).alias("gmv"),
        F.sum("order_count").alias("order_count"),
        F.count(F.lit(1)).alias("active_store_count"),
        F.round(F.sum("gmv") / F.sum("order_count"), 2).alias("avg_order_value"),
        F.round(F.avg("refund_rate"), 4).alias("refund_rate"),
    )


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only one side has (with multiplicity), tagged by side; empty when equal."""
    columns = left.columns
    right = right.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )
