"""Stored records and day summaries: what a run reads and what it leaves alone."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.baselines import attach_baselines, baseline_name
from tidewatch.operators.conditions import Condition
from tidewatch.operators.day_partials import DayPartials
from tidewatch.operators.rule_state import RecordStore
from tidewatch.operators.rules import Rule, evaluate

NOW = datetime(2026, 5, 1, 9)


def rows(spark, *values):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(values)], "k string, v double, n long")


def rule(name, at_least):
    return Rule(name, [Condition("v", "gte", at_least)], ["k"], name=name)


def parts_of(store, rule_id):
    """Files of a rule's parts."""
    one = store.spark.createDataFrame([(rule_id,)], "rule_id string")
    digest = one.select(store.table._digest()).first()[0]
    return {p: f for p, f in store.table.files().items() if p.startswith(digest)}


def test_two_rules_share_a_table(spark, folder):
    store = RecordStore(spark, folder, buckets=8)
    assert store.all().count() == 0 and store.of_rule("low").count() == 0
    data = rows(spark, *[(f"k{i}", float(i)) for i in range(20)])
    assert store.run(data, rule("low", 1), ["n"], "run-1", NOW).count() == 19
    low = parts_of(store, "low")
    store.run(data, rule("high", 15), ["n"], "run-1", NOW)
    high = parts_of(store, "high")
    assert parts_of(store, "low") == low and not set(low) & set(high)
    # the second run of a rule hits one record: one part of its own is written
    touched = store.run(rows(spark, ("k3", 9.0), ("k3", 8.0), ("k0", 0.5)), rule("low", 1), ["n"], "run-2", NOW)
    assert [(r.hit_count, r.is_new) for r in touched.collect()] == [(3, False)]
    after = parts_of(store, "low")
    assert parts_of(store, "high") == high and sum(after[p] != low[p] for p in low) == 1 and set(after) == set(low)
    assert store.of_rule("low").count() == 19 and store.of_rule("high").count() == 5 and store.all().count() == 24
    # only files of the rule are read
    assert all("__part=" in f and any(p in f for p in high) for f in store.of_rule("high").inputFiles())
    # the same run again changes nothing
    version = store.table.log.snapshot().version
    store.run(rows(spark, ("k3", 9.0)), rule("low", 1), ["n"], "run-2", NOW)
    assert store.table.log.snapshot().version == version
    assert {r.hit_count for r in store.of_rule("low").filter("hit_count > 1").collect()} == {3}


def days(spark, *values):
    return spark.createDataFrame([(e, date(2026, 1, d) if d else None, v, i) for i, (e, d, v) in enumerate(values)], "e string, day date, v double, n long")


def base(df, name="7d_avg"):
    return sorted(((r["n"], r[baseline_name("v", name)]) for r in df.collect()), key=str)


@pytest.mark.parametrize("span", [1, 5])
def test_averages_from_stored_days(spark, folder, span):
    data = days(
        spark, *[("a", d, float(d)) for d in range(1, 20)], *[("a", d, 100.0) for d in (3, 9)], ("a", 12, None), ("b", 5, 7.0), (None, 8, 1.0), ("a", None, 3.0),
        *[("b", d, 1.0) for d in range(6, 17) if d != 9], *[(None, d, 2.0) for d in range(1, 16)],
    )
    partials = DayPartials(spark, folder, ["e"], "day", ["v"], ["n"], buckets=2, days=span)
    late = F.col("n").isin(4, 19, 35)
    partials.add(data.filter(~late & (F.col("day") < "2026-01-10")), 0)
    partials.add(data.filter(~late & ((F.col("day") >= "2026-01-10") | F.col("day").isNull())), 1)
    before = partials.table.files()
    touched = partials.add(data.filter(late), 2)  # rows for old days
    changed = {p for p, f in partials.table.files().items() if before.get(p) != f}
    assert changed == set(touched) and len(changed) < len(before)
    assert partials.add(data.filter(late), 2) is None
    expected = attach_baselines(data, [("v", "7d_avg")], ["e"], "day", ["n"])
    assert base(partials.attach(data, [("v", "7d_avg")])) == base(expected)
    # a run over the newest day reads that day and the seven before
    newest = data.filter("day = date'2026-01-16'")
    told = partials.attach(newest, [("v", "7d_avg")])
    assert base(told) == [x for x in base(expected) if x[0] in {r.n for r in newest.collect()}]
    needed = newest.select(F.explode(F.sequence(F.date_sub("day", 7), F.col("day"))).alias("__day")).select(partials._span()).distinct()
    stored = partials.table.within(needed)
    assert set(stored.inputFiles()) < set(partials.table.read().inputFiles())
    assert stored.agg(F.min("__day")).first()[0] >= date(2026, 1, 9 if span == 1 else 5)


def test_a_rule_takes_stored_days(spark, folder):
    data = days(spark, *[("a", d, 1.0 if d < 15 else 5.0) for d in range(1, 16)])
    partials = DayPartials(spark, folder, ["e"], "day", ["v"], ["n"])
    partials.add(data, 0)
    jump = Rule("jump", [Condition("v", "gt_threshold_ratio", 2, baseline="7d_avg")], ["e", "day"])
    assert [r.day.day for r in evaluate(data.filter("day = date'2026-01-15'"), jump, ["n"], partials).collect()] == [15]
    with pytest.raises(ValueError):
        partials.attach(data, [("v", "prev_period")])
    with pytest.raises(ValueError):
        evaluate(data, Rule("jump", jump.conditions, ["day"]), ["n"], partials)
