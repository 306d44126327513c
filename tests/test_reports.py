import csv
import glob
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomalies as A
from tidewatch.operators import reports as R

SEVERITIES = ["low", "high", "medium", "high"]


@pytest.fixture(scope="module")
def listed(spark):
    rows = []
    for i in range(12):
        field, operator, actual = "gmv", "gt", "1"
        name, dataset = f"Rule {i}", "Dataset"
        name = {0: "Revenue check", 3: "Rate % check"}.get(i, name)
        dataset = {1: "Finance mart", 4: "under_score"}.get(i, dataset)
        field = {2: "owner_id", 5: "%", 6: "_", 7: "ownerXid"}.get(i, field)
        actual = "owner_id" if i == 8 else actual
        operator = "owner_id" if i == 9 else operator
        at = datetime(2026, 8, 22, 8) + timedelta(minutes=i)
        rows.append((f"record-{i:02d}", name, dataset, SEVERITIES[i % 4], "pending", at, field, operator, actual))
    base = spark.createDataFrame(rows, "id string, rule_name string, dataset_name string, severity string, status string, first_seen_at timestamp_ntz, f string, o string, a string")
    blank = A.empty_records(spark)
    kept = {c: F.col(c) for c in ("id", "rule_name", "dataset_name", "severity", "status", "first_seen_at")}
    kept["last_seen_at"], kept["hit_count"] = F.col("first_seen_at"), F.lit(1)
    fields = blank.schema["matched_conditions"].dataType.elementType.fields
    given = {"field": F.col("f"), "operator": F.col("o"), "actual": F.col("a")}
    kept["matched_conditions"] = F.array(F.struct(*[given.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) for x in fields]))
    return base.select(*[kept.get(c, F.lit(None)).cast(blank.schema[c].dataType).alias(c) for c in blank.columns])


def ids(df):
    return [r.id[-2:] for r in df.collect()]


def test_search_is_literal_and_field_search_is_exact(listed):
    assert ids(R.filter_records(listed, search="owner_id")) == ["02"]
    assert sorted(ids(R.filter_records(listed, search="%"))) == ["03", "05"]
    assert sorted(ids(R.filter_records(listed, search="_"))) == ["04", "06"]


def test_export_order_filters_and_file(spark, listed, folder):
    rows = R.export_rows(R.filter_records(listed, "pending", "high", search="Rule"))
    assert ids(rows) == ["11", "09", "07", "05", "01"]
    R.write_export(rows, f"{folder}/csv")
    files = sorted(glob.glob(f"{folder}/csv/*.csv"))
    text = "".join(open(f, encoding="utf-8").read() for f in files)
    assert text.startswith("\ufeffid,rule_name") and text.count("\ufeff") == 1
    lines = list(csv.reader(text.removeprefix("\ufeff").splitlines()))
    assert lines[0] == R.EXPORT_COLUMNS and [line[0] for line in lines[1:]] == [f"record-{i}" for i in ("11", "09", "07", "05", "01")]
    chosen = spark.createDataFrame([("record-07",), ("record-01",), ("zz",)], "id string")
    assert ids(R.export_rows(listed, chosen)) == ["07", "01"]


def test_push_status(spark, listed):
    transit = spark.createDataFrame([("record-05",), ("record-05",)], "anomaly_id string")
    assert ids(R.filter_records(listed, push_status="in_transit", transit=transit)) == ["05"]


def test_formula_cells(spark):
    from tidewatch.functions.values import formula_safe

    cells = [" \t=SUM(1,1)", "+1", "-1", "@x", "plain", "a=b", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.x for r in df.select("i", formula_safe(df.c, df.schema["c"].dataType).alias("x")).orderBy("i").collect()]
    assert got == ["' \t=SUM(1,1)", "'+1", "'-1", "'@x", "plain", "a=b", "", None]


def test_pages_are_clamped(listed):
    rows, total = R.page(listed, R.record_order(), 2, 5)
    assert ids(rows) == ["06", "05", "04", "03", "02"] and {r.total for r in rows.select(total.alias("total")).collect()} == {12}
    assert len(ids(R.page(listed, R.record_order(), 0, 0)[0])) == 1
    by_rank = ids(listed.orderBy(*R.record_order("severity")))
    assert by_rank[:6] == ["01", "03", "05", "07", "09", "11"]


def test_delivery_rollup(spark, listed):
    rows = [("record-00", "sent"), ("record-01", "sent"), ("record-01", "failed"), ("record-02", "pending"), ("record-03", "aborted"), ("record-04", "sent"), ("record-04", "aborted")]
    sent = spark.createDataFrame(rows, "anomaly_id string, status string")
    got = {r.id[-2:]: r.delivery for r in R.delivery_status(listed, sent).collect()}
    assert [got[f"{i:02d}"] for i in range(6)] == ["sent", "failed", "pending", "aborted", "sent", "none"]


def test_trend_days_are_local(spark):
    rows = [("a", datetime(2026, 8, 20, 18)), ("b", datetime(2026, 8, 22, 18))]
    df = spark.createDataFrame(rows, "id string, first_seen_at timestamp_ntz")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            trend = {r.day: r.anomaly_count for r in R.daily_trend(df, date(2026, 8, 28), 14).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert len(trend) == 14
        assert {d for d, n in trend.items() if n} == {date(2026, 8, 21), date(2026, 8, 23)}
    for days in (14, 30, 90):
        assert R.daily_trend(df, date(2026, 8, 28), days).count() == days
    with pytest.raises(ValueError):
        R.daily_trend(df, date(2026, 8, 28), 15)


@pytest.mark.parametrize(
    "statuses,expected",
    [
        (["pending", "pending"], "pending"), (["sent", "pending"], "in_transit"), (["sending"], "in_transit"), (["sent"], "sent"), (["aborted"], "aborted"),
        (["sent", "failed"], "partial_failed"), (["sent", "aborted"], "partial_failed"), (["failed", "aborted"], "failed"), (["uncertain", "pending"], "uncertain"), ([], "failed"),
    ],
)
def test_broadcast_rollup(spark, statuses, expected):
    at = datetime(2026, 1, 1)
    groups = spark.createDataFrame([("r", at, "x", True, 1)], "rule_id string, detected_at timestamp_ntz, run_id string, broadcast_enabled boolean, new_anomalies int")
    sent = spark.createDataFrame([("r", at, "situation", s) for s in statuses], "rule_id string, detected_at timestamp_ntz, broadcast_kind string, status string")
    assert R.group_broadcast_status(groups, sent).first().situation_status == expected
