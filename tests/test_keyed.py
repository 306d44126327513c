"""Keyed state of change streams: last positions, current rows, and windows without orders."""

import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.plans import topic
from tidewatch.sources.changelog import parse_changes, raw_file_stream
from tidewatch.streaming import jobs as J
from tidewatch.streaming.keyed import MISMATCH, _PackedChanges, _pane_sums, checked_changes, keyed_state, zero_filled_windows
from tidewatch.streaming.tables import BatchTable

BASE = datetime(2026, 3, 14, 8, tzinfo=timezone.utc)
ROW = "struct<id:int,amount:string>"


class Topic:
    """Messages written part by part; every part is one run of the stream, from the same checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        self.out, self.offset, self.parts = BatchTable(spark, f"{folder}/out"), 0, 0

    def send(self, *events):
        lines = []
        for op, before, after, pos, *server in events:
            source = {"server_id": (server or [1])[0], "file": f"bin.{9 + pos // 10}", "pos": pos % 10, "row": 0}
            rows = [None if r is None else {"id": r[0], "amount": r[1]} for r in (before, after)]
            value = json.dumps({"op": op, "ts_ms": 1, "before": rows[0], "after": rows[1], "source": source})
            lines.append((value, 0, self.offset, BASE))
            self.offset += 1
        frame = self.spark.createDataFrame(lines, "value string, partition int, offset bigint, timestamp timestamp")
        frame.write.mode("append").parquet(f"{self.folder}/topic")
        with keyed_state(self.spark):
            stream = checked_changes(raw_file_stream(self.spark, f"{self.folder}/topic", fmt="parquet"), "id", ROW, **self.options)
            running = J.run_stream(stream, f"{self.folder}/ck", self.out.write)
        running.awaitTermination()

    def seen(self):
        """(offset, problem) of what came through."""
        return sorted((r.offset, r.problem) for r in self.out.read().collect())

    def state(self, name):
        return self.spark.read.format("statestore").option("path", f"{self.folder}/ck").option("stateVarName", name).load()


def test_repeats_over_restarts(spark, folder):
    t = Topic(spark, folder)
    a, b, c = (1, "1.00"), (1, "2.00"), (1, "3.00")
    t.send(("c", None, a, 1), ("c", None, a, 1), ("c", None, (2, "9"), 2))
    # the log is delivered again from the start, as after a crash, and goes on; file 10 follows file 9
    t.send(("c", None, a, 1), ("c", None, (2, "9"), 2), ("u", a, b, 3), ("u", b, c, 12), ("u", a, b, 3))
    t.send(("u", b, c, 12), ("d", c, None, 13), ("d", c, None, 13), ("c", None, a, 14))
    assert [o for o, _ in t.seen()] == [0, 2, 5, 6, 9, 11]
    assert {p for _, p in t.seen()} == {None}
    # positions of another server say nothing about those before
    t.send(("u", a, b, 1, 2), ("u", a, b, 1, 2))
    assert [o for o, _ in t.seen()][-1] == 12


def test_state_has_one_entry_per_live_key(spark, folder):
    """However often a key changes; without retention a deleted key leaves its position."""
    t = Topic(spark, folder, with_rows=False)
    rows = [(1, str(i)) for i in range(200)]
    t.send(("c", None, rows[0], 1), *[("u", rows[i], rows[i + 1], i + 2) for i in range(199)], ("c", None, (2, "1"), 500), ("c", None, (3, "1"), 501))
    t.send(("d", (3, "1"), None, 502), ("u", rows[-1], rows[0], 600))
    assert sorted(r.key.key for r in t.state("live").select("key").collect()) == ["1", "2"]
    assert [r.key.key for r in t.state("gone").select("key").collect()] == ["3"]
    assert len(t.seen()) == 204


def test_before_images_over_micro_batches(spark, folder):
    t = Topic(spark, folder)
    a, b, c = (1, "1.00"), (1, "2.00"), (1, "9.00")
    t.send(("c", None, a, 1), ("c", None, (2, None), 2))
    t.send(("u", a, b, 3))                                # fits
    t.send(("u", c, a, 4), ("u", (2, None), (2, "1"), 5))  # wrong, and a null amount that fits
    t.send(("d", a, None, 6), ("u", a, b, 7))              # fits the wrong one's result; a row that is gone
    t.send(("r", None, (3, "1"), 8), ("d", (3, "2"), None, 9))
    assert t.seen() == [(0, None), (1, None), (2, None), (3, MISMATCH), (4, None), (5, None), (6, MISMATCH), (7, None), (8, MISMATCH)]


@pytest.mark.parametrize("packs", [1, 64])
def test_packed_state_tells_the_same(spark, folder, packs):
    """Repeats, wrong images, another server, a deleted key and keys without a name, over several runs."""
    a, b, c = (1, "1.00"), (1, "2.00"), (1, "9.00")
    runs = [
        [("c", None, a, 1), ("c", None, a, 1), ("c", None, (2, None), 2), ("c", None, (None, "5"), 3)],
        [("c", None, a, 1), ("u", a, b, 4), ("u", c, a, 5), ("u", (2, None), (2, "1"), 6), ("u", (None, "5"), (None, "6"), 7)],
        [("d", a, None, 12), ("d", a, None, 12), ("u", a, b, 13), ("c", None, a, 1, 2), ("c", None, a, 1, 2)],
    ]
    told = []
    for name, options in (("plain", {}), ("packed", {"packs": packs})):
        t = Topic(spark, f"{folder}/{name}", **options)
        for events in runs:
            t.send(*events)
        told.append(t.seen())
    assert told[0] == told[1]
    assert told[1] == [(0, None), (2, None), (3, None), (5, None), (6, MISMATCH), (7, None), (8, None), (9, None), (11, MISMATCH), (12, None)]
    held = {key: gone for row in t.state("packs").collect() for key, _, _, _, gone in json.loads(row.user_map_value.entries)}
    assert held == {"1": None, "2": None, None: None}


def test_packs_forget_deleted_keys_after_their_retention():
    """Without Spark: what is left of a pack at a time, and the timer for the rest."""
    class Held:
        def __init__(self):
            self.at, self.timers = {}, []

        def getMapState(self, *schema):
            return self

        def containsKey(self, key):
            return key in self.at

        def getValue(self, key):
            return self.at[key]

        def updateValue(self, key, value):
            self.at[key] = value

        def removeKey(self, key):
            self.at.pop(key, None)

        def iterator(self):
            return iter(list(self.at.items()))

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class At:
        def __init__(self, now):
            self.now = now

        def getCurrentProcessingTimeInMs(self):
            return self.now

        getExpiryTimeInMs = getCurrentProcessingTimeInMs

    def send(now, *events):
        rows = [(pack, key, op, "1", at, None, "x", "v", 0, int(at), 0) for pack, key, op, at in events]
        names = ["pack", "key", "op", "server", "position", "before", "after", "value", "partition", "offset", "micros"]
        return len(next(iter(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=names)]), At(now)))))

    held, processor = Held(), _PackedChanges(100, True)
    processor.init(held)
    assert send(0, (1, "a", "c", "01"), (1, "b", "c", "02"), (2, "c", "c", "03")) == 3 and held.timers == []
    assert send(10, (1, "a", "d", "04"), (2, "c", "d", "05")) == 2 and held.timers == [110]
    assert send(50, (1, "a", "d", "04"), (1, "b", "d", "06")) == 1 and held.timers == [110]  # a repeat is still known
    assert len(list(processor.handleExpiredTimer((0,), At(110), At(110)))[0]) == 0
    assert held.timers == [150] and {k[0]: [e[0] for e in json.loads(v[0])] for k, v in held.at.items()} == {1: ["b"]}
    assert send(120, (2, "c", "d", "05")) == 1  # forgotten


def test_a_shuffled_batch_is_put_in_order(spark, folder):
    rows = [("c", None, (1, "0"), 1)] + [("u", (1, str(i)), (1, str(i + 1)), i + 2) for i in range(30)]
    t = Topic(spark, folder)
    t.send(*rows)
    assert all(p is None for _, p in t.seen()) and len(t.seen()) == 31


def test_malformed_payloads_stop_the_stream(spark, folder):
    spark.createDataFrame([("{oops", 0, 1, BASE)], "value string, partition int, offset bigint, timestamp timestamp").write.parquet(f"{folder}/topic")
    with keyed_state(spark):
        running = J.run_stream(checked_changes(raw_file_stream(spark, f"{folder}/topic", fmt="parquet"), "id", ROW), f"{folder}/ck", lambda b, i: b.count())
    with pytest.raises(Exception):
        running.awaitTermination()


def test_the_warehouse_quarantines_wrong_changes_and_folds(spark, folder):
    sf = "/root/testdata/sf0.001"
    log = topic.raw(spark, sf)
    spoilt = F.regexp_replace("value", '"before":\\{"id":"o7",', '"before":{"id":"o7","order_no":"other",')
    parts = log.withColumn("value", F.regexp_replace(spoilt, '"order_no":"SEED-7",(?=.*"after")', ""))
    house = J.Warehouse(spark, f"{folder}/tables", buckets=4)
    for step in range(2):
        parts.filter(F.least(F.col("offset") % 4, F.lit(1)) == step).write.mode("append").parquet(f"{folder}/topic")
        for query in J.start_warehouse(raw_file_stream(spark, f"{folder}/topic", fmt="parquet"), house, f"{folder}/checkpoints"):
            query.awaitTermination()

    def contents():
        tables = [house.current().drop("processed_at"), house.store_metrics(), house.minute_metrics(), house.run_metrics(), house.ods().drop("processed_at", "latency_ms")]
        return [sorted(map(str, t.collect())) for t in tables]

    wrong = parse_changes(house.quarantine()).select("after.id").distinct().collect()
    assert [r.id for r in wrong] == ["o7"]
    before = contents()
    house.fold()
    assert contents() == before and all(before)
    assert house.table("dwd").batch_ids() == [] and house.orders().holds_rows()
    house.vacuum(grace_ms=0)
    assert contents() == before


def test_every_shop_has_every_window(spark, folder):
    """Windows of 20 s every 10 s, closed 5 s late. Worked by hand."""
    shops = spark.createDataFrame([("A",), ("B",), ("N",)], "shop_id string")
    base = int(BASE.timestamp() * 1000)
    out = BatchTable(spark, f"{folder}/out")
    schema = "shop_id string, sign int, amount decimal(12,2), event_time timestamp"

    def send(*rows):
        data = [(s, sign, Decimal(a) if a else None, BASE + timedelta(seconds=at)) for s, sign, a, at in rows]
        spark.createDataFrame(data, schema).write.mode("append").parquet(f"{folder}/deltas")
        with keyed_state(spark):
            stream = zero_filled_windows(
                spark.readStream.schema(schema).parquet(f"{folder}/deltas"), shops, base, length_ms=20_000, slide_ms=10_000, lateness_ms=5_000
            )
            running = J.run_stream(stream, f"{folder}/ck", out.write)
        running.awaitTermination()
        got = out.read().collect()
        assert all(r.window_end_ms - r.window_start_ms == 20_000 for r in got)
        told = {(r.shop_id, (r.window_end_ms - base) // 1000): (r.order_count, str(r.total_amount)) for r in got}
        assert len(told) == len(got)  # each once
        return told

    # the watermark is at 13: only the windows that end at 10 are closed
    first = send(("A", 1, "1.50", 2), ("A", 1, "2.00", 18), ("B", 1, None, 3))
    assert first == {("A", 10): (1, "1.50"), ("B", 10): (1, "0.00"), ("N", 10): (0, "0.00")}
    # an order of 4 is late for the window to 10, not for the one to 20; one is taken back; C is new; watermark 42
    second = send(("A", 1, "4.00", 4), ("A", -1, "2.00", 18), ("C", 1, "7.25", 33), ("B", 1, "0.10", 47))
    more = {k: v for k, v in second.items() if k not in first}
    assert more == {
        ("A", 20): (2, "5.50"), ("A", 30): (0, "0.00"), ("A", 40): (0, "0.00"),
        ("B", 20): (1, "0.00"), ("B", 30): (0, "0.00"), ("B", 40): (0, "0.00"),
        ("N", 20): (0, "0.00"), ("N", 30): (0, "0.00"), ("N", 40): (0, "0.00"),
        ("C", 40): (1, "7.25"),
    }
    assert {k: second[k] for k in first} == first


def test_a_shop_gets_a_row_per_pane(monkeypatch):
    """Whatever the number of rows, and however often a task sums what it holds; no shop is a shop."""
    monkeypatch.setattr("tidewatch.streaming.keyed.FOLD_ROWS", 5)
    frames = [
        pd.DataFrame({"shop_id": ["A", "A", None, "B"], "millis": [10_001 + i, 14_999, 10_000, 20_000], "until_us": [i, 7, 3, 4], "sign": [1, -1, 1, 1], "cents": [100, -30, 5, 1]})
        for i in range(10)
    ]
    out = pd.concat(_pane_sums("shop_id", 5_000)(iter(frames)))
    told = {(r.shop_id if isinstance(r.shop_id, str) else None, r.pane): (r.until_us, r.sign, r.cents) for r in out.itertuples()}
    assert len(out) == 3 and told == {("A", 10_000): (9, 0, 700), (None, 10_000): (3, 10, 50), ("B", 20_000): (4, 10, 10)}
