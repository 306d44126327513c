from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException

from tidewatch.operators.conditions import Condition, IncompatibleTypes, MissingField
from tidewatch.operators.rules import Rule, evaluate

C = Condition


def keys(df, rule_conditions, key, logic="AND", order=None):
    rule = Rule("r", rule_conditions, key, logic=logic)
    return sorted(tuple(row) for row in evaluate(df, rule, order or key).select(*key).collect())


def test_and_combination(spark):
    df = spark.createDataFrame([("S1", 120, 0.03), ("S2", 80, 0.08)], "store_id string, gmv int, refund_rate double")
    assert keys(df, [C("gmv", "gte", 100), C("refund_rate", "lt", 0.05)], ["store_id"]) == [("S1",)]


def test_text_literal_is_a_number_for_numeric_fields(spark):
    df = spark.createDataFrame([("S1", 3499.99), ("S2", 3500.0)], "store_id string, gmv double")
    assert keys(df, [C("gmv", "lt", "3500")], ["store_id"]) == [("S1",)]
    with pytest.raises(IncompatibleTypes):
        keys(df, [C("gmv", "lt", "many")], ["store_id"])


def test_between_and_null_test(spark):
    df = spark.createDataFrame([(1, 7, None), (2, 11, "ou_1")], "id int, score int, owner string")
    assert keys(df, [C("score", "between", 5, 10), C("owner", "is_null")], ["id"]) == [(1,)]


def test_field_operands_and_their_evidence(spark):
    df = spark.createDataFrame([(1, 7, 5), (2, 3, 5)], "id int, actual int, minimum int")
    rule = Rule("r", [C("actual", "between", value_source="field", value_field="minimum", upper_value=10)], ["id"])
    rows = evaluate(df, rule, ["id"]).collect()
    assert [r.id for r in rows] == [1]
    seen = rows[0].matched_conditions[0]
    assert (seen.resolved_value, seen.resolved_upper_value, seen.actual, seen.matched) == ("5", "10", "7", True)


@pytest.mark.parametrize("operator", ["gt", "gte", "lt", "lte", "eq", "neq"])
def test_null_operand_never_matches(spark, operator):
    df = spark.createDataFrame([(1, 2, None), (2, None, 2)], "id int, actual int, target int")
    condition = C("actual", operator, value_source="field", value_field="target")
    assert keys(df, [condition], ["id"]) == []


def test_missing_fields_fail_the_run(spark):
    df = spark.createDataFrame([(1, 2)], "id int, actual int")
    with pytest.raises(MissingField):
        keys(df, [C("other", "gt", 1)], ["id"])
    with pytest.raises(MissingField):
        keys(df, [C("actual", "gt", value_source="field", value_field="other")], ["id"])


def test_text_field_that_is_no_number_fails_the_run(spark):
    condition = C("actual", "gt", value_source="field", value_field="target")
    good = spark.createDataFrame([(1, 5, "4.5"), (2, None, "bad")], "id int, actual int, target string")
    assert keys(good, [condition], ["id"]) == [(1,)]
    bad = spark.createDataFrame([(1, 5, "bad")], "id int, actual int, target string")
    with pytest.raises(PySparkException):
        keys(bad, [condition], ["id"])


@pytest.mark.parametrize("operator", ["eq", "neq", "gt"])
def test_mixed_types_are_refused(spark, operator):
    df = spark.createDataFrame(
        [(1, "failed", 1, True, date(2026, 1, 1), datetime(2026, 1, 1))],
        "id int, text string, number int, flag boolean, day date, at timestamp_ntz",
    )
    for left, right in [("text", "number"), ("flag", "number"), ("day", "text"), ("day", "at")]:
        with pytest.raises(IncompatibleTypes):
            keys(df, [C(left, operator, value_source="field", value_field=right)], ["id"])
    with pytest.raises(IncompatibleTypes):
        keys(df, [C("day", operator, "2026-01-01")], ["id"])


def test_nan_is_never_equal_or_ordered(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, nan), (2, 1.0, nan), (3, nan, 1.0), (4, 1.0, 1.0)], "id int, a double, b double")

    def hits(operator):
        return [k for (k,) in keys(df, [C("a", operator, value_source="field", value_field="b")], ["id"])]

    assert hits("gt") == hits("lt") == []
    assert hits("eq") == hits("gte") == hits("lte") == [4]
    assert hits("neq") == [1, 2, 3]


def test_decimal_compares_as_double(spark):
    df = spark.createDataFrame([(1, "0.10"), (2, "0.30")], "id int, t string").selectExpr("id", "cast(t as decimal(5,2)) as d")
    assert keys(df, [C("d", "gte", 0.3)], ["id"]) == [(2,)]
    assert keys(df, [C("d", "eq", 0.1)], ["id"]) == [(1,)]


def test_whole_number_literal_reaches_the_scan(spark, folder):
    spark.range(10).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    found = evaluate(df, Rule("r", [C("id", "gte", 7.0)], ["id"]), ["id"]).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,7)" in plan
    assert sorted(r.id for r in found.collect()) == [7, 8, 9]


def test_rules_are_checked_first(spark):
    df = spark.createDataFrame([(1, 2)], "id int, actual int")
    with pytest.raises(ValueError):
        evaluate(df, Rule("r", [C("actual", "gt", 1)], []), ["id"])
    with pytest.raises(ValueError):
        C("actual", "about", 1)
    with pytest.raises(ValueError):
        C("actual", "gt_threshold_ratio", 2)
    named = df.withColumnRenamed("id", "__occurrence_id")
    with pytest.raises(ValueError):
        evaluate(named, Rule("r", [C("actual", "gt", 1)], ["__occurrence_id"], repeat_push_enabled=True), ["actual"])
