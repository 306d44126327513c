import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import anomalies as A
from tidewatch.operators import groups as G
from tidewatch.operators import lifecycle as L
from tidewatch.operators.rules import Rule, Target
from tidewatch.plans.rule_run import GROUP_SCHEMA, REQUEST_SCHEMA

T = datetime(2026, 8, 9, 1)
BROADCASTS = "rule_id string, detected_at timestamp_ntz, broadcast_kind string, round_index int"


def records(spark, rows):
    """rows: (id, status, deadline, owner)"""
    columns = A.empty_records(spark).columns
    data = []
    for rid, status, deadline, owner in rows:
        values = dict(
            id=rid, rule_id="r", rule_name="R", status=status, business_key=json.dumps({"id": rid}),
            row_details=json.dumps({"owner": owner}), validation_deadline=deadline, hit_count=1, validation_result_version=0,
        )
        data.append(tuple(values.get(c) for c in columns))
    return spark.createDataFrame(data, A.RECORD_SCHEMA)


def members(spark, ids, new=True):
    rows = [("r", T, rid, i, new, None) for i, rid in enumerate(ids)]
    return spark.createDataFrame(
        rows, "rule_id string, detected_at timestamp_ntz, anomaly_id string, position bigint, is_new boolean, timeout_notified_at timestamp_ntz"
    )


def group(spark, n, enabled=True):
    row = ("r", T, "run-1", "R", n, n, n, True, enabled, "https://hook", None, None)
    return spark.createDataFrame([row], GROUP_SCHEMA)


def no_requests(spark):
    return spark.createDataFrame([], REQUEST_SCHEMA)


def mark(state, scan, at):
    """Members, records and broadcasts after a scan."""
    recs, mem, sent = state
    done = scan.due.select("anomaly_id", F.lit(at).cast("timestamp_ntz").alias("set_timeout_notified_at"))
    mem = L.apply_updates(mem, done, "anomaly_id")
    recs = L.apply_updates(recs, scan.expired.select("id", F.lit("timed_out").alias("set_status")))
    rounds = scan.rounds.select("rule_id", "detected_at", F.lit("timeout").alias("broadcast_kind"), "round_index")
    spark = recs.sparkSession
    freeze = [(recs, recs), (mem, mem), (sent.unionByName(rounds), sent)]
    return tuple(spark.createDataFrame(a.collect(), b.schema) for a, b in freeze)


def test_timeout_rounds(spark):
    """A round for every scan that finds newly overdue members; solved ones and those without a deadline are never due."""
    minutes = {"late-1": 4, "late-2": 4, "solved": 6, "later": 50, "open": None}
    rows = [(n, "resolved" if n == "solved" else "processing", None if m is None else T + timedelta(minutes=m), "o") for n, m in minutes.items()]
    state = (records(spark, rows), members(spark, list(minutes)), spark.createDataFrame([], BROADCASTS))
    seen = []
    for minute in (3, 4, 7, 49, 50, 90):
        at = T + timedelta(minutes=minute)
        scan = G.timeout_scan(group(spark, 5), state[1], state[0], no_requests(spark), state[2], at)
        found = sorted(r.round_index for r in scan.rounds.collect())
        seen.append((minute, found, sorted(r.id for r in scan.expired.collect())))
        assert scan.closed.count() == 0
        if found:
            state = mark(state, scan, at)
    assert seen == [(3, [], []), (4, [1], ["late-1", "late-2"]), (7, [], []), (49, [], []), (50, [2], ["later"]), (90, [], [])]
    assert {r.id: r.status for r in state[0].collect()} == {
        "late-1": "timed_out", "late-2": "timed_out", "solved": "resolved", "later": "timed_out", "open": "processing"
    }


def test_twenty_two_members_in_two_parts_with_mentions(spark):
    due = T + timedelta(seconds=5)
    rows = [(f"m{i:02d}", "resolved" if i == 21 else "pending", due, f"owner-{i % 2}") for i in range(22)]
    recs, mem = records(spark, rows), members(spark, [r[0] for r in rows])
    rule = Rule("r", [], [], group_broadcast_enabled=True, group_webhook_url="https://hook")
    first = G.situation_messages(group(spark, 22), mem, recs, rule, "https://w", [])
    assert sorted((r.part_index, r.total_parts) for r in first.collect()) == [(1, 2), (2, 2)]
    assert G.situation_messages(group(spark, 0), members(spark, [r[0] for r in rows], new=False), recs, rule, "https://w", []).count() == 0
    requests = spark.createDataFrame([("q", "m00", "owner-0", "sent", T)], REQUEST_SCHEMA)
    scan = G.timeout_scan(
        group(spark, 22), mem, recs, requests, spark.createDataFrame([], BROADCASTS), due, 50,
        [Target("field", field="owner"), Target("literal", value="supervisor")],
    )
    assert scan.expired.count() == 21
    sent = {r.part_index: json.loads(r.payload) for r in G.group_messages(group(spark, 22), scan.rows, scan.mentions, "https://w", kind="timeout").collect()}
    assert sorted(sent) == [1, 2]
    lines = sent[1]["content"]["post"]["zh-CN"]["content"]
    assert [n["user_id"] for n in lines[-1] if n["tag"] == "at"] == ["owner-0", "owner-1", "supervisor"]
    assert lines[0][0]["text"].startswith("已超时未解决：21 条")
    assert all(n["tag"] != "at" for line in sent[2]["content"]["post"]["zh-CN"]["content"] for n in line)
    assert sent[2]["content"]["post"]["zh-CN"]["title"] == "【超时播报】R（2/2）"


def test_group_without_records_gets_one_message(spark):
    none = G.member_rows(members(spark, []), records(spark, []))
    out = G.group_messages(group(spark, 0), none, G.mentions(none, []), "https://w").collect()
    assert len(out) == 1 and "本次未检测到异常" in out[0].payload


def test_group_time_moves_to_the_next_free_microsecond(spark):
    taken = [T, T + timedelta(microseconds=1), T + timedelta(microseconds=3)]
    rows = [("r", t, f"run-{i}", "R", 0, 0, 0, False, False, None, None, None) for i, t in enumerate(taken)]
    groups = spark.createDataFrame(rows, GROUP_SCHEMA)
    assert G.unique_time(groups, "r", T) == T + timedelta(microseconds=2)
    assert G.unique_time(groups, "other", T) == T
    full = [("r", T + timedelta(microseconds=i), f"x{i}", "R", 0, 0, 0, False, False, None, None, None) for i in range(1500)]
    assert G.unique_time(spark.createDataFrame(full, GROUP_SCHEMA), "r", T) == T + timedelta(microseconds=1500)


def test_batch_of_group_times_never_collides(spark):
    times = [0, 0, 0, 1, 1, 5, 100, 100]
    rows = [("r", f"x{i}", T + timedelta(microseconds=t)) for i, t in enumerate(times)] + [("s", "y", T)]
    runs = spark.createDataFrame(rows, "rule_id string, run_id string, detected_at timestamp_ntz")
    got = {r.run_id: (r.detected_at - T) / timedelta(microseconds=1) for r in G.unique_times(runs).collect()}
    assert [got[f"x{i}"] for i in range(8)] == [0, 1, 2, 3, 4, 5, 100, 101]
    assert got["y"] == 0
