"""A change topic step by step, in batch and as a stream."""

import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewatch.sources.changelog import SOURCE_ROW, parse_changes, raw_file_stream
from tidewatch.streaming import jobs as J
from tidewatch.streaming import warehouse as W
from tidewatch.streaming import windows as N
from tidewatch.streaming.tables import BatchTable

BASE = datetime(2026, 3, 14, 8, tzinfo=timezone.utc)
BASE_MS = int(BASE.timestamp() * 1000)
ROW = "struct<order_id:int,shop_id:string,amount:string,created_at:string>"
SHOPS = ["N1", "N2", "N3"]


def order(number, shop, amount, second):
    at = BASE + timedelta(seconds=second, milliseconds=250)
    return {"order_id": number, "shop_id": shop, "amount": amount, "created_at": at.strftime("%Y-%m-%dT%H:%M:%S.250Z")}


BREAD, SOUP, TEA = order(21, "N1", "4.20", 2), order(22, "N3", "9.90", 3), order(23, "N2", "15.00", 4)
JAM, RICE = order(25, "N3", "1.10", 400), order(26, "N2", "3.30", 433)

# What a shop's day sends, step by step: operation, row before, row after, times delivered.
STEPS = {
    "morning": [("c", None, BREAD, 1), ("c", None, SOUP, 2), ("r", None, TEA, 1)],
    "changes": [("u", BREAD, order(21, "N2", "4.80", 2), 2), ("d", TEA, None, 1)],
    "clock": [("c", None, order(24, "N1", "2.50", 47), 1)],
    "next": [("c", None, JAM, 1), ("u", JAM, order(25, "N3", "1.40", 400), 1), ("c", None, RICE, 1)],
    "straggler": [("c", None, order(27, "N1", "6.00", 0), 1)],
}

# Worked by hand. Totals: the bread moved to N2 for 4.80 and the tea is gone, so N2 has 4.80 until
# the rice. Windows are 300 s long and close 5 s after their end: at 47.25 s the newest ends at 40,
# without the order of 47 s; at 433.25 s it ends at 425 and starts at 125, so only the jam is in it.
EXPECTED = {
    "clock": (["2.50", "4.80", "9.90"], 40, {"N1": (0, "0.00"), "N2": (1, "4.80"), "N3": (1, "9.90")}),
    "next": (["2.50", "8.10", "11.30"], 425, {"N1": (0, "0.00"), "N2": (0, "0.00"), "N3": (1, "1.40")}),
    "straggler": (["8.50", "8.10", "11.30"], 425, {"N1": (0, "0.00"), "N2": (0, "0.00"), "N3": (1, "1.40")}),
}


def topic_lines():
    """(step, messages) in order; a message delivered again has the same source position."""
    written, delivered = 0, 0
    for step, events in STEPS.items():
        lines = []
        for op, before, after, times in events:
            written += 1
            source = {"server_id": 7, "file": "bin.4", "pos": 1000 * written, "row": 0}
            value = json.dumps({"op": op, "ts_ms": BASE_MS + written, "before": before, "after": after, "source": source})
            for _ in range(times):
                lines.append({"value": value, "partition": 0, "offset": delivered, "timestamp": "2026-03-14T08:00:00Z"})
                delivered += 1
        yield step, lines


def deltas(changes):
    rows = W.signed_deltas(W.drop_repeats(changes, "order_id"))
    return rows.withColumn("event_time", F.col("created_at").cast("timestamp")).withColumn("event_ms", F.unix_millis("event_time"))


def shop_table(spark):
    return spark.createDataFrame([(s,) for s in SHOPS], "shop_id string")


def test_batch_after_each_step(spark):
    lines = []
    for name, more in topic_lines():
        lines += more
        if name not in EXPECTED:
            continue
        totals, end, content = EXPECTED[name]
        raw = spark.createDataFrame([(x["value"], x["partition"], x["offset"], BASE) for x in lines], "value string, partition int, offset bigint, timestamp timestamp")
        signed = deltas(parse_changes(raw, ROW))
        got = {r.shop_id: r.total_revenue for r in W.cumulative(signed, shop_table(spark)).collect()}
        assert [got[s] for s in SHOPS] == [Decimal(t) for t in totals]
        newest = N.latest_window(N.closed_windows(N.window_totals(signed), signed), shop_table(spark))
        for r in newest.collect():
            assert r.window_end_ms == BASE_MS + end * 1000
            assert (r.order_count, r.total_amount) == (content[r.shop_id][0], Decimal(content[r.shop_id][1]))


def test_stream_after_each_step(spark, folder):
    windows, sums = BatchTable(spark, f"{folder}/windows"), BatchTable(spark, f"{folder}/sums")
    for index, (name, lines) in enumerate(topic_lines()):
        text = "\n".join(json.dumps(x) for x in lines)
        spark.sparkContext.parallelize([text], 1).saveAsTextFile(f"{folder}/topic/step={index}")

        def stream():
            raw = raw_file_stream(spark, f"{folder}/topic/*")
            return deltas(parse_changes(raw, ROW))

        J.run_stream(N.streaming_windows(stream()), f"{folder}/ck-windows", windows.write).awaitTermination()
        totals = stream().groupBy("shop_id").agg(F.sum(F.col("sign") * F.col("amount").cast("decimal(18,2)")).alias("total"))
        J.run_stream(totals, f"{folder}/ck-sums", sums.write, mode="update").awaitTermination()
        if name not in EXPECTED:
            continue
        expected, end, content = EXPECTED[name]
        newest = sums.read().groupBy("shop_id").agg(F.max_by("total", "batch_id").alias("total"))
        got = {r.shop_id: r.total for r in newest.collect()}
        assert [got[s] for s in SHOPS] == [Decimal(t) for t in expected], name
        shown = N.latest_window(windows.read(), shop_table(spark)).collect()
        assert {r.window_end_ms for r in shown} == {BASE_MS + end * 1000}, name
        assert {r.shop_id: (r.order_count, r.total_amount) for r in shown} == {s: (c, Decimal(a)) for s, (c, a) in content.items()}, name


def test_repeats_replay_and_guard(spark, folder):
    table = BatchTable(spark, f"{folder}/t")
    assert table.write(spark.range(3), 0) and not table.write(spark.range(5), 0)
    assert table.write(spark.range(4), 1)
    assert table.read().count() == 7 and table.batch_ids() == [0, 1]
    with pytest.raises(ValueError):
        table.refuse_fresh_checkpoint(f"{folder}/new-checkpoint")
    with pytest.raises(LookupError):
        BatchTable(spark, f"{folder}/none").read()


def test_before_image_mismatch_is_found(spark):
    def event(op, before, after, offset):
        return (op, before, after, (1, "f", offset, 0), 0, offset)

    a, b, c = (1, "T01", "1.00", "x"), (1, "T01", "2.00", "x"), (1, "T01", "9.00", "x")
    rows = [event("c", None, a, 1), event("u", a, b, 2), event("u", c, a, 3), event("d", a, None, 4), event("u", a, b, 5), event("c", None, (2, "T01", "1.00", "x"), 6)]
    df = spark.createDataFrame(rows, f"op string, before {ROW}, after {ROW}, source {SOURCE_ROW}, partition int, offset bigint")
    checked = W.before_image_check(df, "order_id", ["offset"])
    assert sorted(r.offset for r in checked.filter("problem is not null").collect()) == [3, 5]
    assert checked.count() == 6


def test_malformed_payload_fails(spark):
    raw = spark.createDataFrame([("{oops", 0, 1, BASE)], "value string, partition int, offset bigint, timestamp timestamp")
    with pytest.raises(Exception):
        parse_changes(raw, ROW).collect()


def test_ods_dates_ignore_the_session_zone(spark):
    late = int(datetime(2026, 9, 5, 17, tzinfo=timezone.utc).timestamp() * 1000)
    raw = spark.createDataFrame(
        [(json.dumps({"op": "d", "ts_ms": late, "before": {"id": "7", "run_id": {"x": 1}}, "after": None}), 0, 1, BASE), ('{"op":"x"}', 0, 2, BASE)],
        "value string, partition int, offset bigint, timestamp timestamp",
    )
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = W.ods_rows(raw, F.timestamp_millis(F.lit(late - 5))).select(F.col("event_date").cast("string").alias("d"), "order_id", "run_id", "latency_ms").collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [tuple(r) for r in rows] == [("2026-09-06", "7", None, 0)]


def test_metrics_with_unknown_amounts(spark):
    rows = [("r", "a", None, "PAID"), ("r", "a", "3.00", "PAID"), ("r", "b", None, "PAID"), ("r", "c", "5.00", "CANCELLED"), ("r", "c", "5.00", None)]
    df = spark.createDataFrame(rows, "run_id string, store_id string, amount string, status string")
    got = {r.store_id: (r.order_count, r.revenue, r.average_ticket) for r in W.group_metrics(df, ["run_id", "store_id"]).collect()}
    assert got == {"a": (2, Decimal("3.00"), Decimal("1.50")), "b": (1, Decimal("0.00"), None)}


def test_folding_keeps_the_tables(spark, folder):
    from tidewatch.plans import topic

    sf = "/root/testdata/sf0.001"
    topic.raw(spark, sf).repartition(3, "offset").write.parquet(f"{folder}/topic")
    house = J.Warehouse(spark, f"{folder}/tables")
    for query in J.start_warehouse(raw_file_stream(spark, f"{folder}/topic", max_files=1, fmt="parquet"), house, f"{folder}/checkpoints"):
        query.awaitTermination()
    assert len(house.table("dwd").batch_ids()) > 1

    def contents():
        tables = [house.current().drop("processed_at"), house.store_metrics(), house.minute_metrics(), house.run_metrics()]
        return [sorted(map(str, t.collect())) for t in tables]

    before = contents()
    house.fold()
    assert contents() == before and all(before)
