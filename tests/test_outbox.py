from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.values import backoff_seconds, request_backoff_seconds
from tidewatch.operators import outbox as O

T = datetime(2026, 8, 9, 12)
JOBS = (
    "id string, anomaly_id string, kind string, delivery_id string, generation int, status string, cancel_requested boolean, "
    "publish_attempts int, next_attempt_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)
STATES = "kind string, delivery_id string, delivery_status string, attempts int, delivery_next_at timestamp_ntz"


def jobs(spark, *rows):
    """(id, kind, status, more)"""
    data = []
    for jid, kind, status, more in rows:
        v = dict(id=jid, anomaly_id=None if kind == "group_broadcast" else f"a{jid}", kind=kind, delivery_id=f"d{jid}", generation=2, status=status,
                 cancel_requested=False, publish_attempts=0, next_attempt_at=None, created_at=T, updated_at=T)
        v.update(more)
        data.append(tuple(v[c.split()[0]] for c in JOBS.split(", ")))
    return spark.createDataFrame(data, JOBS)


def states(spark, *rows):
    return spark.createDataFrame([(k, d, s, n, None) for k, d, s, n in rows], STATES)


@pytest.mark.parametrize(
    "kind,status,expected",
    [("notification", "sent", "sent"), ("notification", "uncertain", "uncertain"), ("notification", "pending", None), ("validation", "timed_out", "sent"),
     ("validation", "update_failed", "sent"), ("group_broadcast", "uncertain", "uncertain"), ("group_broadcast", "aborted", "aborted"), ("notification", "resolved", None)],
)
def test_reconcile(spark, kind, status, expected):
    out = O.reconcile(jobs(spark, ("1", kind, "executing", {})), states(spark, (kind, "d1", status, 0)), 2).collect()
    assert [r.set_status for r in out] == ([expected] if expected else [])


def test_reconcile_skips_other_generations_and_cancelled(spark):
    table = jobs(spark, ("1", "notification", "executing", {"generation": 1}), ("2", "notification", "executing", {"cancel_requested": True}), ("3", "notification", "sent", {}))
    known = states(spark, *[("notification", f"d{i}", "sent", 0) for i in (1, 2, 3)])
    assert O.reconcile(table, known, 2).count() == 0


def test_publish_takes_the_oldest_of_the_current_generation(spark):
    table = jobs(
        spark, ("1", "notification", "pending_publish", {"created_at": T + timedelta(1)}), ("2", "notification", "pending_publish", {"generation": 1}),
        ("3", "notification", "pending_publish", {"cancel_requested": True}), ("4", "validation", "pending_publish", {}), ("5", "validation", "sent", {}),
    )
    out = O.publishable(table, 2).collect()
    assert sorted(r.key for r in out) == ["1", "4"]
    assert {r.value for r in out if r.key == "4"} == {'{"version":1,"job_id":"4","generation":2,"kind":"validation"}'}
    assert [r.key for r in O.publishable(table, 2, 3).collect()] == ["4"]


def test_published_messages_can_go_to_files(spark, folder):
    table = jobs(spark, ("1", "notification", "pending_publish", {}))
    O.write_messages(O.publishable(table, 2), f"{folder}/out", {}, "json")
    assert spark.read.json(f"{folder}/out").count() == 1


def classify(spark, status="kafka_queued", delivery="pending", message=None, aborting=False, **more):
    import json

    body = {"version": 1, "job_id": "1", "generation": 2, "kind": "notification", **(message or {})}
    inbox = spark.createDataFrame([(json.dumps(body),)], "value string")
    return O.classify_messages(inbox, jobs(spark, ("1", "notification", status, more)), states(spark, ("notification", "d1", delivery, 0)), 2, aborting).first().verdict


def test_consume_order(spark):
    assert classify(spark) == "dispatch"
    assert classify(spark, message={"version": 2}) == "invalid"
    assert classify(spark, message={"job_id": "x"}) == "invalid"
    assert classify(spark, message={"generation": 1}) == "duplicate"
    assert classify(spark, message={"kind": "validation"}) == "duplicate"
    assert classify(spark, cancel_requested=True) == "duplicate"
    assert classify(spark, status="sent") == "duplicate"
    assert classify(spark, aborting=True) == "paused"
    assert classify(spark, status="dispatching") == "in_progress"
    assert classify(spark, status="pending_publish") == "duplicate"
    assert classify(spark, delivery="sent") == "reconciled"
    broken = spark.createDataFrame([("nonsense",)], "value string")
    assert O.classify_messages(broken, jobs(spark), states(spark), 2).first().verdict == "invalid"


def stale(spark, status, kind="notification", delivery="pending", seconds=3600, **more):
    table = jobs(spark, ("1", kind, status, {"updated_at": T - timedelta(seconds=seconds), **more}))
    rows = O.stale_jobs(table, states(spark, (kind, "d1", delivery, 0)), 2, T, 10).collect()
    return [(r.set_status, r.set_delivery_status) for r in rows]


def test_stale_leases(spark):
    assert stale(spark, "publishing") == [("pending_publish", None)]
    assert stale(spark, "publishing", seconds=29) == []
    assert stale(spark, "dispatching") == [("kafka_queued", None)]
    assert stale(spark, "ds_scheduled") == [("pending_publish", None)]
    assert stale(spark, "ds_scheduled", seconds=599) == []
    assert stale(spark, "executing", seconds=31) == []
    assert stale(spark, "executing", seconds=32) == [("pending_publish", None)]
    assert stale(spark, "sending", delivery="sent") == [("sent", None)]
    assert stale(spark, "sending", delivery="sending") == [("uncertain", "uncertain")]
    assert stale(spark, "sending", "validation", "sending") == [("failed", None)]
    assert stale(spark, "publishing", generation=1) == [("aborted", "aborted")]
    assert stale(spark, "sending", delivery="sending", cancel_requested=True) == [("uncertain", "uncertain")]
    assert stale(spark, "sending", delivery="sent", cancel_requested=True) == [("sent", None)]
    assert stale(spark, "publishing", cancel_requested=True) == [("aborted", "aborted")]


def test_abort_generation(spark):
    table = jobs(
        spark, ("1", "notification", "pending_publish", {}), ("2", "validation", "failed", {}), ("3", "group_broadcast", "executing", {}), ("4", "notification", "sending", {}),
        ("5", "notification", "sent", {}), ("6", "notification", "kafka_queued", {"generation": 3}),
    )
    known = states(spark, ("notification", "d1", "pending", 0), ("validation", "d2", "failed", 0), ("group_broadcast", "d3", "sending", 0), ("notification", "d4", "sending", 0))
    touched = O.abort_generation(table, known, 3)
    got = {r.id: (r.set_status, r.set_delivery_status) for r in touched.collect()}
    assert got == {"1": ("aborted", "aborted"), "2": ("aborted", "aborted"), "3": ("aborted", "uncertain"), "4": ("sending", None)}
    assert tuple(O.abort_counts(touched).first()) == (3, 1, 1, 0)
    assert sorted(r.anomaly_id for r in O.abort_events(touched, T).collect()) == ["a1", "a2"]


def test_cancel_includes_group_broadcasts(spark):
    table = jobs(spark, ("1", "notification", "pending_publish", {}), ("2", "group_broadcast", "kafka_queued", {}), ("3", "group_broadcast", "kafka_queued", {}),
                 ("4", "notification", "sending", {"anomaly_id": "a1"}), ("5", "notification", "failed", {"anomaly_id": "a1"}))
    known = states(spark, ("notification", "d1", "pending", 0), ("group_broadcast", "d2", "pending", 0), ("group_broadcast", "d3", "pending", 0),
                   ("notification", "d4", "sending", 0), ("notification", "d5", "sent", 0))
    members = spark.createDataFrame([("r", T, "a1")], "rule_id string, detected_at timestamp_ntz, anomaly_id string")
    broadcasts = spark.createDataFrame([("d2", "r", T), ("d3", "other", T)], "id string, rule_id string, detected_at timestamp_ntz")
    ids = spark.createDataFrame([("a1",), ("a1",)], "anomaly_id string")
    got = {r.id: (r.set_status, r.set_delivery_status) for r in O.cancel_pushes(table, known, members, broadcasts, ids).collect()}
    assert got == {"1": ("aborted", "aborted"), "2": ("aborted", "aborted"), "4": ("sending", None)}


def test_backoffs(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 8, 9, 100)], "n int")
    got = [tuple(r) for r in df.select(backoff_seconds(F.col("n")), request_backoff_seconds(F.col("n"))).collect()]
    assert got == [(2, 300), (2, 300), (4, 600), (256, 3600), (300, 3600), (300, 3600)]


def test_in_transit_is_distinct(spark):
    table = jobs(spark, ("1", "notification", "failed", {"anomaly_id": "x"}), ("2", "validation", "uncertain", {"anomaly_id": "x"}), ("3", "notification", "sent", {}),
                 ("4", "group_broadcast", "failed", {}), ("5", "notification", "failed", {"generation": 1}), ("6", "notification", "failed", {"cancel_requested": True}))
    known = states(spark, *[(k, f"d{i}", "pending", 0) for i, k in ((1, "notification"), (2, "validation"), (3, "notification"), (4, "group_broadcast"), (5, "notification"), (6, "notification"))])
    assert [r.anomaly_id for r in O.in_transit(table, known, 2).collect()] == ["x"]


def test_recover(spark):
    table = jobs(spark, ("1", "notification", "failed", {}), ("2", "notification", "failed", {}), ("3", "validation", "failed", {"next_attempt_at": T + timedelta(1)}),
                 ("4", "group_broadcast", "failed", {}), ("5", "validation", "failed", {}), ("6", "notification", "failed", {"generation": 1}))
    known = states(spark, ("notification", "d1", "failed", 5), ("notification", "d2", "failed", 6), ("validation", "d3", "failed", 0), ("group_broadcast", "d4", "pending", 0),
                   ("validation", "d5", "pending", 0), ("notification", "d6", "failed", 0))
    records = spark.createDataFrame([("a1", "pending"), ("a2", "pending"), ("a3", "pending"), ("a5", "resolved"), ("a6", "pending")], "id string, status string")
    got = O.recover_failed(table, known, records, 2, T)
    assert sorted(r.id for r in got.filter("requeue").collect()) == ["1", "4"]
    assert tuple(O.recover_counts(got).first()) == (2, 1, 0, 1, 4)


NOTES = "id string, anomaly_id string, status string, attempts int, updated_at timestamp_ntz"
REQUESTS = (
    "id string, anomaly_id string, delivery_status string, delivery_attempts int, send_started_at timestamp_ntz, next_attempt_at timestamp_ntz, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
CASTS = "id string, rule_id string, detected_at timestamp_ntz, status string, attempts int, next_attempt_at timestamp_ntz, updated_at timestamp_ntz"


def test_deliveries_without_a_live_job_are_called_off(spark):
    notes = spark.createDataFrame([("d1", "x", "pending", 0, T), ("d2", "x", "failed", 1, T), ("d3", "y", "pending", 0, T), ("d4", "x", "sent", 1, T), ("d5", "x", "sending", 1, T)], NOTES)
    asked = spark.createDataFrame([("d6", "x", "uncertain", 1, T, T, T, T), ("d7", "x", "sent", 1, T, T, T, T)], REQUESTS)
    casts = spark.createDataFrame([("d8", "r", T, "pending", 0, T, T), ("d9", "q", T, "pending", 0, T, T)], CASTS)
    members = spark.createDataFrame([("r", T, "x"), ("q", T, "y")], "rule_id string, detected_at timestamp_ntz, anomaly_id string")
    table = jobs(spark, ("1", "notification", "sent", {"anomaly_id": "x"}), ("5", "notification", "kafka_queued", {"anomaly_id": "x"}))
    ids = spark.createDataFrame([("x",), ("x",)], "anomaly_id string")
    out = {r.delivery_id: (r.set_status, r.set_next_attempt_at) for r in O.cancel_deliveries(table, notes, asked, casts, members, ids).collect()}
    assert out == {"d1": ("aborted", None), "d2": ("aborted", None), "d5": ("uncertain", None), "d6": ("uncertain", None), "d8": ("aborted", None)}
    assert [r.anomaly_id for r in O.cancel_events(ids, T).collect()] == ["x"]


def test_clearing_waits_for_an_abort(spark):
    with pytest.raises(O.PipelinePaused):
        O.clear_in_transit(None, None, None, None, None, 2, "admin", aborting=True)


def test_two_cycles_in_sequence(spark):
    from tidewatch.operators import cycle as C

    records = spark.createDataFrame([("a1", "pending"), ("a2", "processing"), ("a3", "resolved"), ("a4", "pending")], "id string, status string")
    state = C.Outbox(
        jobs=jobs(
            spark, ("4", "validation", "executing", {"anomaly_id": "a4", "updated_at": T - timedelta(hours=1)}),
            ("9", "notification", "executing", {"anomaly_id": "a9", "delivery_id": "d9"}),
        ),
        notifications=spark.createDataFrame([("d1", "a1", "pending", 0, T), ("d3", "a3", "pending", 0, T), ("d9", "a9", "sent", 1, T)], NOTES),
        requests=spark.createDataFrame([("d2", "a2", "pending", 0, None, None, T, T), ("d4", "a4", "sending", 1, T, None, T, T)], REQUESTS),
        broadcasts=spark.createDataFrame([("d8", "r", T, "pending", 0, None, T)], CASTS),
    )
    paused, none = C.run_cycle(state, records, 2, T, aborting=True)
    assert none.count() == 0 and paused.jobs.count() == 2
    state, messages = C.run_cycle(state, records, 2, T)
    # the settled job is closed, the stale validation fails, and each due delivery has a published job
    status = {r.delivery_id: r.status for r in state.jobs.collect()}
    assert status == {"d9": "sent", "d4": "failed", "d1": "kafka_queued", "d2": "kafka_queued", "d8": "kafka_queued"}
    assert messages.count() == 3
    # nothing is published twice; a job whose delivery arrived is closed, and the failed one goes out again
    later = T + timedelta(minutes=5)
    sent = state.notifications.withColumn("status", F.when(F.col("id") == "d1", "sent").otherwise(F.col("status")))
    failed = state.requests.withColumn("delivery_status", F.when(F.col("id") == "d4", "failed").otherwise(F.col("delivery_status")))
    state, messages = C.run_cycle(C.Outbox(state.jobs, sent, failed, state.broadcasts), records, 2, later)
    status = {r.delivery_id: (r.status, r.publish_attempts) for r in state.jobs.collect()}
    assert status == {"d9": ("sent", 0), "d1": ("sent", 1), "d2": ("kafka_queued", 1), "d8": ("kafka_queued", 1), "d4": ("kafka_queued", 1)}
    assert messages.count() == 1
