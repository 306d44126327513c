import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_groups import T, records
from tidewatch.operators import lifecycle as L
from tidewatch.operators.conditions import Condition
from tidewatch.operators.recheck import recheck, store_results
from tidewatch.operators.skew import lookup


def decide(spark, status, target, source=None, user=None, allow=False):
    recs = records(spark, [("a", status, None, "o")])
    wish = spark.createDataFrame([("a", target, source, user)], "id string, target_status string, source string, user_id string")
    row = L.decide_transitions(recs, wish, allow).first()
    return row.outcome, row.reason


def test_transition_table(spark):
    assert decide(spark, "pending", "processing") == ("changed", None)
    assert decide(spark, "processing", "pending") == ("changed", None)
    assert decide(spark, "pending", "pending") == ("noop", None)
    assert decide(spark, "pending", "timed_out")[1] == "system_only"
    assert decide(spark, "pending", "timed_out", allow=True) == ("changed", None)
    assert decide(spark, "timed_out", "processing")[1] == "timed_out_needs_resolution"
    assert decide(spark, "timed_out", "resolved", "manual", "admin") == ("changed", None)
    assert decide(spark, "pending", "resolved", "manual", "  ")[1] == "needs_known_user"
    assert decide(spark, "pending", "resolved", None, "admin")[1] == "needs_known_user"
    assert decide(spark, "resolved", "pending")[1] == "already_resolved"
    assert decide(spark, "resolved", "resolved", "manual", "admin") == ("noop", None)
    assert decide(spark, "pending", "closed")[1] == "unknown_status"


def test_bulk_is_all_or_nothing(spark):
    recs = records(spark, [("a", "pending", None, "o"), ("b", "resolved", None, "o")])

    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "id string")

    with pytest.raises(L.MissingRecords) as missing:
        L.bulk_transition(recs, ids("a", *[f"z{i}" for i in range(30)]), "resolved", "admin", T)
    assert {r.id for r in missing.value.offenders.collect()} == {f"z{i}" for i in range(30)}
    with pytest.raises(L.RefusedTransitions) as refused:
        L.bulk_transition(recs, ids("a", "b"), "processing", "admin", T)
    assert [tuple(r) for r in refused.value.offenders.collect()] == [("b", "already_resolved")]
    after, decisions = L.bulk_transition(recs, ids("a", "a", "b"), "resolved", "admin", T)
    assert decisions.count() == 2
    assert {r.id: (r.status, r.resolved_by_user_id) for r in after.collect()} == {"a": ("resolved", "admin"), "b": ("resolved", None)}


def test_deadline_starts_once_at_the_first_delivery(spark):
    recs = records(spark, [("a", "pending", None, "o"), ("b", "resolved", None, "o"), ("c", "pending", T, "o"), ("d", "pending", None, "o")])
    recs = recs.withColumn("deadline_seconds_snapshot", F.when(F.col("id") != "d", 3600))
    sent = [("a", T + timedelta(minutes=5)), ("a", T + timedelta(minutes=2)), ("b", T), ("c", T), ("d", T), ("a", None)]
    deliveries = spark.createDataFrame(sent, "anomaly_id string, delivered_at timestamp_ntz")
    after = L.start_deadlines(recs, deliveries)
    got = {r.id: (r.first_delivered_at, r.validation_deadline, r.validation_result_version) for r in after.collect()}
    assert got["a"] == (T + timedelta(minutes=2), T + timedelta(minutes=62), 1)
    assert got["b"] == (None, None, 0) and got["c"] == (None, T, 0) and got["d"] == (None, None, 0)


def test_expiry_takes_the_earliest_first(spark):
    recs = records(spark, [("a", "pending", T + timedelta(seconds=2), "o"), ("b", "processing", T, "o"), ("c", "resolved", T, "o"), ("d", "pending", None, "o")])
    after, log = L.expire(recs, T + timedelta(seconds=2), limit=1)
    assert [r.anomaly_id for r in log.collect()] == ["b"]
    assert {r.id: r.status for r in after.collect()} == {"a": "pending", "b": "timed_out", "c": "resolved", "d": "pending"}
    assert L.expire(recs, T + timedelta(seconds=2))[1].count() == 2


def test_submissions(spark):
    recs = records(spark, [("a", "pending", None, "o"), ("b", "resolved", None, "o"), ("c", "timed_out", None, "o")])
    requests = spark.createDataFrame([(r, u) for r in "abc" for u in ("u1", "u2")], "anomaly_id string, recipient_user_id string")
    existing = spark.createDataFrame([("b", "u1")], "anomaly_id string, submitted_by_user_id string")
    rows = [
        (1, "a", "u3", "text", T), (2, "a", "u1", "  ", T), (3, "a", "u1", " ok ", T + timedelta(1)), (4, "a", "u1", "ok", T + timedelta(2)),
        (5, "a", "u2", "ok", T + timedelta(3)), (6, "b", "u1", "ok", T), (7, "b", "u2", "ok", T), (8, "c", "u2", "x" * 1001, T),
        (9, "c", "u2", "x" * 1000, T + timedelta(1)), (10, "zz", "u1", "ok", T),
    ]
    subs = spark.createDataFrame(rows, "submission_id int, anomaly_id string, user_id string, text string, submitted_at timestamp_ntz")
    judged = L.judge_submissions(recs, requests, existing, subs)
    assert {r.submission_id: r.outcome for r in judged.collect()} == {
        1: "not_recipient", 2: "invalid_text", 3: "accepted", 4: "duplicate", 5: "already_resolved", 6: "duplicate", 7: "already_resolved",
        8: "invalid_text", 9: "accepted", 10: "unknown_record",
    }
    accepted = L.accepted_submissions(judged)
    after = L.resolve_submitted(recs, accepted)
    assert {r.id: (r.status, r.resolution_source) for r in after.collect()} == {"a": ("resolved", "validation"), "b": ("resolved", None), "c": ("resolved", "validation")}
    assert L.resolution_events(accepted).count() == 2


CHECK = "target_id string, data_date string, status string, temperature decimal(5,2), floor string"
PARAMETERS = {"target_id": "plate", "data_date": "day"}


def run_check(spark, rows, condition):
    anomalies = spark.createDataFrame([("x", "p1", "2026-08-01")], "id string, plate string, day string")
    check = spark.createDataFrame(rows, CHECK).withColumn("temperature", F.col("temperature"))
    row = recheck(anomalies, check, PARAMETERS, condition).first()
    return row.reason, row.passed


def row(status="normal", temperature=None, floor=None, plate="p1"):
    from decimal import Decimal

    return (plate, "2026-08-01", status, None if temperature is None else Decimal(str(temperature)), floor)


def test_check_needs_exactly_one_row(spark):
    normal = Condition("status", "eq", "normal")
    assert run_check(spark, [row()], normal) == ("condition_passed", True)
    assert run_check(spark, [row(plate="p2")], normal) == ("no_rows", False)
    assert run_check(spark, [row(), row()], normal) == ("multiple_rows", False)
    assert run_check(spark, [row()], Condition("other", "eq", "normal")) == ("missing_field", False)
    assert run_check(spark, [row()], Condition("status", "eq", value_source="field", value_field="other")) == ("missing_field", False)
    assert run_check(spark, [row("late")], normal) == ("condition_failed", False)
    assert run_check(spark, [row()], Condition("status", "gt", 5)) == ("invalid_comparison", False)
    bad = Condition("temperature", "gt", value_source="field", value_field="floor")
    assert run_check(spark, [row(temperature=1, floor="cold")], bad) == ("invalid_comparison", False)
    assert run_check(spark, [row(temperature=1, floor="0.5")], bad) == ("condition_passed", True)


@pytest.mark.parametrize(
    "operator,actual,value,upper",
    [("eq", 2, 2, None), ("neq", 2, 3, None), ("gt", 2.5, 2, None), ("gte", 2, 2, None), ("lt", -18, -12, None), ("lte", -12, -12, None), ("between", 5, 1, 10), ("is_null", None, None, None), ("is_not_null", 1, None, None)],
)
def test_check_operators(spark, operator, actual, value, upper):
    assert run_check(spark, [row(temperature=actual)], Condition("temperature", operator, value, upper)) == ("condition_passed", True)


def test_check_parameters_are_verified(spark):
    anomalies = spark.createDataFrame([("x", "p1")], "id string, plate string")
    check = spark.createDataFrame([row()], CHECK)
    for mapping in ({}, {"target_id": "other"}, {"nope": "plate"}):
        with pytest.raises(ValueError):
            recheck(anomalies, check, mapping, Condition("status", "eq", "normal"))


def test_check_results_are_stored(spark):
    recs = records(spark, [("a", "pending", None, "o"), ("b", "timed_out", None, "o"), ("c", "pending", None, "o")])
    results = spark.createDataFrame([("a", "condition_passed", True, "1"), ("b", "no_rows", False, None)], "id string, reason string, passed boolean, actual string")
    after = {r.id: r for r in store_results(recs, results, Condition("v", "gt", 0), "u1", T).collect()}
    assert (after["a"].status, after["a"].resolution_source, after["a"].validation_result_version) == ("resolved", "validation", 1)
    assert (after["b"].status, after["b"].validation_result_version) == ("timed_out", 1)
    assert json.loads(after["b"].last_sql_validation_result)["outcome"] == "failed"
    assert after["c"].last_sql_validation_result is None


def test_backfills(spark):
    df = spark.createDataFrame([("critical",), ("low",)], "severity string")
    assert [r.severity for r in L.merge_severities(df).collect()] == ["high", "low"]
    groups = spark.createDataFrame([("r", T, T), ("r", T + timedelta(1), None)], "rule_id string, detected_at timestamp_ntz, timeout_processed_at timestamp_ntz")
    members = spark.createDataFrame(
        [("r", T, "a", None), ("r", T + timedelta(1), "b", datetime(2026, 1, 1))], "rule_id string, detected_at timestamp_ntz, anomaly_id string, timeout_notified_at timestamp_ntz"
    )
    got = {r.anomaly_id: r.timeout_notified_at for r in L.fill_notified_at(members, groups).collect()}
    assert got == {"a": T, "b": datetime(2026, 1, 1)}
    assert lookup(members, groups, ["rule_id", "detected_at"], ["timeout_processed_at"], ["anomaly_id"]).count() == 2
