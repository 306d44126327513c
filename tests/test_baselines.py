import random
from datetime import date, timedelta
from statistics import mean

import pytest

from tidewatch.operators.baselines import attach_baselines, baseline_name
from tidewatch.operators.conditions import Condition
from tidewatch.operators.rules import Rule, evaluate

C = Condition


def test_seven_day_average(spark):
    rows = [("S1", date(2026, 8, d), 100) for d in range(1, 8)] + [("S1", date(2026, 8, 8), 250)]
    df = spark.createDataFrame(rows, "store_id string, metric_date date, gmv int")
    rule = Rule("r", [C("gmv", "gt_threshold_ratio", 2, baseline="7d_avg")], ["store_id", "metric_date"])
    found = evaluate(df, rule, ["metric_date"]).collect()
    assert [(r.metric_date, r.matched_conditions[0].baseline_value) for r in found] == [(date(2026, 8, 8), 100.0)]


def test_one_missing_day_means_no_baseline(spark):
    rows = [("S1", date(2026, 8, d), 100) for d in (1, 2, 3, 4, 5, 7)] + [("S1", date(2026, 8, 8), 250)]
    df = spark.createDataFrame(rows, "store_id string, metric_date date, gmv int")
    rule = Rule("r", [C("gmv", "gt_threshold_ratio", 2, baseline="7d_avg")], ["store_id", "metric_date"])
    assert evaluate(df, rule, ["metric_date"]).count() == 0


def test_ratio_from_the_row(spark):
    rows = [(1, date(2026, 8, 1), 10, 2), (1, date(2026, 8, 2), 21, 2)]
    df = spark.createDataFrame(rows, "id int, day date, actual int, ratio int")
    condition = C("actual", "gt_threshold_ratio", value_source="field", value_field="ratio", baseline="prev_period")
    found = evaluate(df, Rule("r", [condition], ["id", "day"]), ["day"]).collect()
    assert [r.actual for r in found] == [21]
    assert found[0].matched_conditions[0].resolved_value == "2"


def test_invalid_baseline_does_not_block_other_conditions(spark):
    # the time key is typed, as in a real dataset; the undated row has no baseline
    df = spark.createDataFrame([(1, None, 100, 0), (2, date(2026, 8, 2), 100, 1)], "id int, day date, actual int, other int")
    conditions = [C("actual", "gt_threshold_ratio", 2, baseline="prev_period"), C("other", "eq", 1)]
    found = evaluate(df, Rule("r", conditions, ["id", "day"], logic="OR"), ["id"]).collect()
    assert [r.id for r in found] == [2]


def test_key_needs_exactly_one_time_field(spark):
    df = spark.createDataFrame([(1, date(2026, 8, 1), date(2026, 8, 2), 5)], "id int, a date, b date, v int")
    condition = C("v", "gt_threshold_ratio", 2, baseline="prev_period")
    for key in (["id"], ["id", "a", "b"]):
        with pytest.raises(ValueError):
            evaluate(df, Rule("r", [condition], key), ["id"])


def brute_force(rows, index, kind):
    """The baseline of one row by looking at every other row."""
    entity, day, _, _ = rows[index]
    if day is None:
        return None
    earlier = [r for r in rows if r[0] == entity and r[1] is not None and r[1] < day]
    if kind == "prev_period":
        if not earlier:
            return None
        return max(earlier, key=lambda r: (r[1], r[3]))[2]
    days = 7 if kind == "7d_avg" else 30
    window = [r for r in earlier if r[1] >= day - timedelta(days=days) and r[2] is not None]
    return mean(r[2] for r in window) if len({r[1] for r in window}) >= days else None


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_with_a_hot_entity(spark, seed):
    rng = random.Random(seed)
    rows = []
    for sequence in range(1200):
        entity = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        day = None if rng.random() < 0.05 else date(2026, 1, 1) + timedelta(days=rng.randrange(45))
        value = None if rng.random() < 0.1 else float(rng.randrange(1, 50))
        rows.append((entity, day, value, sequence))
    df = spark.createDataFrame(rows, "entity string, day date, v double, seq int")
    kinds = ["prev_period", "7d_avg", "30d_avg"]
    out = attach_baselines(df, [("v", k) for k in kinds], ["entity"], "day", ["seq"])
    assert out.count() == len(rows)
    got = {r.seq: r for r in out.collect()}
    for index, row in enumerate(rows):
        for kind in kinds:
            expected = brute_force(rows, index, kind)
            actual = got[row[3]][baseline_name("v", kind)]
            assert (actual is None) == (expected is None), (row, kind)
            if expected is not None:
                assert actual == pytest.approx(expected)


def test_day_text_must_be_iso(spark):
    from tidewatch.operators.baselines import day_of

    texts = ["2026-08-01", "2026-08-01T10:00:00Z", "2026-08-01 10:00", "2026-8-1", "invalid", "2026-02-30", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in df.select("i", day_of(df.t, df.schema["t"].dataType).alias("d")).orderBy("i").collect()]
    assert got == [date(2026, 8, 1)] * 3 + [None] * 4
