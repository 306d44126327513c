from datetime import date, datetime

from pyspark.sql import functions as F

from tidewatch.operators import anomalies as A
from tidewatch.operators import lifecycle as L
from tidewatch.operators.conditions import Condition
from tidewatch.operators.rules import Rule, Target
from tidewatch.plans.rule_run import State, run_rule

KEYS = ["store_id", "metric_date"]
T1, T2 = datetime(2026, 8, 9, 1), datetime(2026, 8, 10, 1)


def rule(**more):
    base = dict(name="GMV", dataset_name="daily", notification_targets=[Target("literal", value="ou_fixed", receive_id_type="open_id")])
    return Rule("r1", [Condition("gmv", "gt", 100)], KEYS, **{**base, **more})


def dataset(spark, n=1):
    rows = [("S1", "2026-08-09", 500, i) for i in range(n)]
    return spark.createDataFrame(rows, "store_id string, metric_date string, gmv int, line int")


def after(spark, result):
    return State(
        spark.createDataFrame(result.records.collect(), A.RECORD_SCHEMA),
        spark.createDataFrame(result.requests.collect(), result.requests.schema),
        spark.createDataFrame(result.group.collect(), result.group.schema),
    )


def test_same_match_in_two_runs(spark):
    first = run_rule(dataset(spark), rule(), ["line"], State.empty(spark), "run-1", T1)
    assert first.summary.first().new_anomalies == 1
    assert first.notifications.count() == 1
    second = run_rule(dataset(spark), rule(), ["line"], after(spark, first), "run-2", T2)
    assert second.summary.first().new_anomalies == 0
    rows = second.records.collect()
    assert [(r.hit_count, r.first_seen_at, r.last_seen_at) for r in rows] == [(2, T1, T2)]
    assert second.notifications.count() == 0
    assert second.group.count() == 1 and second.members.first().is_new is False


def test_resolved_key_can_match_again(spark):
    first = run_rule(dataset(spark), rule(), ["line"], State.empty(spark), "run-1", T1)
    state = after(spark, first)
    ids = state.records.select("id")
    resolved, _ = L.bulk_transition(state.records, ids, "resolved", "admin", T1)
    second = run_rule(dataset(spark), rule(), ["line"], State(resolved, state.requests, state.groups), "run-2", T2)
    assert second.summary.first().new_anomalies == 1
    assert sorted(r.status for r in second.records.collect()) == ["pending", "resolved"]


def test_repeat_mode_makes_every_match_new(spark):
    repeat = rule(repeat_push_enabled=True)
    first = run_rule(dataset(spark, 2), repeat, ["store_id"], State.empty(spark), "run-1", T1)
    assert first.summary.first().new_anomalies == 2
    second = run_rule(dataset(spark), repeat, ["store_id"], after(spark, first), "run-2", T2)
    assert second.summary.first().new_anomalies == 1
    state = after(spark, second)
    assert state.records.select("fingerprint").distinct().count() == 3
    third = run_rule(dataset(spark), rule(), ["line"], state, "run-3", T2)
    assert third.summary.first().new_anomalies == 1
    fourth = run_rule(dataset(spark), rule(), ["line"], after(spark, third), "run-4", T2)
    assert fourth.summary.first().new_anomalies == 0


def test_duplicates_in_one_run_fold(spark):
    result = run_rule(dataset(spark, 3), rule(), ["line"], State.empty(spark), "run-1", T1)
    record = result.records.first()
    assert record.hit_count == 3
    assert '"line":2' in record.row_details
    summary = result.summary.first()
    assert (summary.scanned_rows, summary.matched_rows, summary.new_anomalies) == (3, 3, 1)


def test_ids_are_repeatable(spark):
    def ids():
        result = run_rule(dataset(spark, 2), rule(repeat_push_enabled=True), ["line"], State.empty(spark), "run-1", T1)
        return sorted(r.id for r in result.records.collect()), sorted(r.id for r in result.jobs.collect())

    assert ids() == ids()


def test_targets_keep_order_and_drop_blanks(spark):
    rows = spark.createDataFrame([("a", ("ou_manager", " ", None))], "id string, first_row struct<manager:string,blank:string,none:string>")
    targets = [
        Target("literal", value="ou_fixed", receive_id_type="open_id"),
        Target("field", field="manager", receive_id_type="open_id"),
        Target("field", field="blank", receive_id_type="open_id"),
        Target("field", field="none", receive_id_type="open_id"),
        Target("literal", value=" ou_fixed ", receive_id_type="open_id"),
    ]
    found = A.notification_targets(rows, targets).orderBy("place").collect()
    assert [(r.receive_id_type, r.recipient) for r in found] == [("open_id", "ou_fixed"), ("open_id", "ou_manager")]


def test_validation_recipients_get_no_plain_message(spark):
    config = rule(
        notification_targets=[Target("literal", value="u1"), Target("literal", value="u2")],
        validation_enabled=True, validation_method="sql", validation_targets=[Target("literal", value="u1")],
        dataset_datasource_id="src", sql_validation_config={"query_template": "q"},
    )
    result = run_rule(dataset(spark), config, ["line"], State.empty(spark), "run-1", T1)
    assert [r.recipient for r in result.notifications.collect()] == ["u2"]
    assert [r.recipient_user_id for r in result.requests.collect()] == ["u1"]
    record = result.records.first()
    assert record.validation_method_snapshot == "sql" and '"datasource_id": "src"' in record.validation_config_snapshot
    assert sorted(r.kind for r in result.jobs.collect()) == ["notification", "validation"]
    assert sorted(r.event_type for r in result.events.collect()) == ["detected", "validation_requested"]


def test_group_exists_without_matches(spark):
    df = dataset(spark).withColumn("gmv", F.lit(1))
    result = run_rule(df, rule(), ["line"], State.empty(spark), "run-1", T1)
    assert result.group.first().matched_rows == 0 and result.members.count() == 0


def test_fingerprint_covers_types_and_null(spark):
    df = spark.createDataFrame([("x", date(2026, 1, 2), None, 1.5)], "b string, a date, c int, d double")
    from tidewatch.functions.values import canonical_json

    assert df.select(canonical_json(df, ["d", "c", "b", "a"])).first()[0] == '{"a":"2026-01-02","b":"x","c":null,"d":1.5}'
