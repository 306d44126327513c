"""Sliding event-time windows over signed deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.streaming.warehouse import MONEY

# Window length, slide and allowed out-of-orderness in milliseconds.
LENGTH_MS = 300_000
SLIDE_MS = 5_000
LATENESS_MS = 5_000


#: Windows that one block of panes serves: those that start in the same span of time.
BLOCK_MS = 720 * SLIDE_MS


def window_totals(deltas: DataFrame, shop: str = "shop_id", amount: str = "amount", millis: str = "event_ms") -> DataFrame:
    """Count and amount per shop and window, for a bounded set of deltas.

    Deltas are first summed per slide-sized pane. Panes are dealt out by shop and
    block of time, to at most two blocks each, and copied into the windows that
    cover them only there; the sum over windows needs no further exchange.
    """
    pane = F.floor(F.col(millis) / SLIDE_MS) * SLIDE_MS
    panes = deltas.groupBy(F.col(shop), pane.alias("pane")).agg(
        F.sum("sign").alias("order_count"), F.sum(F.col("sign") * F.col(amount).cast(MONEY)).alias("total_amount")
    )
    first = F.col("pane") - LENGTH_MS + SLIDE_MS

    def block(start):
        return F.floor(start / BLOCK_MS)

    dealt = panes.withColumn("block", F.explode(F.array_distinct(F.array(block(first), block(F.col("pane"))))))
    dealt = dealt.repartition(F.col(shop), F.col("block"))
    low = F.greatest(first, F.col("block") * BLOCK_MS)
    high = F.least(F.col("pane"), (F.col("block") + 1) * BLOCK_MS - SLIDE_MS)
    starts = dealt.withColumn("window_start_ms", F.explode(F.sequence(low, high, F.lit(SLIDE_MS).cast("bigint"))))
    return starts.groupBy(shop, "block", "window_start_ms").agg(
        F.sum("order_count").alias("order_count"), F.sum("total_amount").cast(MONEY).alias("total_amount")
    ).drop("block").withColumn("window_end_ms", F.col("window_start_ms") + LENGTH_MS)


def closed_end(max_event_ms):
    """End of the last window the watermark has closed."""
    return F.floor((max_event_ms - LATENESS_MS) / SLIDE_MS) * SLIDE_MS


def closed_windows(windows: DataFrame, deltas: DataFrame, millis: str = "event_ms") -> DataFrame:
    """Windows whose end the watermark of all deltas has passed."""
    newest = deltas.agg(closed_end(F.max(millis))).scalar()
    return windows.filter(F.col("window_end_ms") <= newest)


def latest_window(windows: DataFrame, shops: DataFrame, shop: str = "shop_id") -> DataFrame:
    """The newest window with every shop, zero where a shop has no live orders."""
    end = windows.agg(F.max("window_end_ms")).scalar()
    newest = windows.filter(F.col("window_end_ms") == end)
    filled = shops.select(shop).withColumn("window_end_ms", end).filter(F.col("window_end_ms").isNotNull())
    joined = filled.join(newest.select(shop, "order_count", "total_amount"), shop, "left")
    return joined.select(
        shop,
        (F.col("window_end_ms") - LENGTH_MS).alias("window_start_ms"),
        "window_end_ms",
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
        F.coalesce("total_amount", F.lit(0)).cast(MONEY).alias("total_amount"),
    )


def latest_per_shop(windows: DataFrame, shop: str = "shop_id") -> DataFrame:
    """Each shop's newest window; a later one replaces an earlier one."""
    body = F.struct("window_start_ms", "order_count", "total_amount")
    newest = windows.groupBy(shop).agg(
        F.max_by(body, F.col("window_end_ms")).alias("b"), F.max("window_end_ms").alias("window_end_ms")
    )
    return newest.select(shop, "b.window_start_ms", "window_end_ms", "b.order_count", "b.total_amount")


def streaming_windows(deltas: DataFrame, shop: str = "shop_id", amount: str = "amount", time: str = "event_time") -> DataFrame:
    """The windows over an unbounded stream (append mode).

    The watermark trails the newest event by the allowed lateness; later events
    no longer reach closed windows. Rows are summed to slide-sized panes first; only
    panes are copied into the windows.
    """
    panes = (
        deltas.withWatermark(time, f"{LATENESS_MS} milliseconds")
        .groupBy(F.window(time, f"{SLIDE_MS} milliseconds").alias("pane"), F.col(shop))
        .agg(F.sum("sign").alias("order_count"), F.sum(F.col("sign") * F.col(amount).cast(MONEY)).alias("total_amount"))
    )
    counted = panes.groupBy(F.window(F.window_time("pane"), f"{LENGTH_MS} milliseconds", f"{SLIDE_MS} milliseconds"), F.col(shop)).agg(
        F.sum("order_count").alias("order_count"), F.sum("total_amount").alias("total_amount")
    )
    return counted.select(
        shop,
        F.unix_millis("window.start").alias("window_start_ms"),
        F.unix_millis("window.end").alias("window_end_ms"),
        "order_count",
        F.col("total_amount").cast(MONEY).alias("total_amount"),
    )


def check_result(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: rows missing, rows in excess, distinct window boundaries, and the verdict."""
    columns = expected.columns
    got = actual.select(*columns)
    differing = (
        expected.exceptAll(got).select(F.lit("missing").alias("kind"), F.lit(None).cast("bigint").alias("boundary"))
        .unionAll(got.exceptAll(expected).select(F.lit("excess"), F.lit(None).cast("bigint")))
    )
    bounds = got.select(F.lit("row").alias("kind"), F.col("window_end_ms").cast("bigint").alias("boundary"))
    return differing.unionAll(bounds).agg(
        F.count_if(F.col("kind") == "missing").alias("missing_rows"),
        F.count_if(F.col("kind") == "excess").alias("excess_rows"),
        F.count_distinct("boundary").alias("boundaries"),
    ).withColumn(
        "passed", (F.col("missing_rows") == 0) & (F.col("excess_rows") == 0) & (F.col("boundaries") == 1)
    )
