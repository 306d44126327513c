"""The index of what is due: entries move, leave, and later spans are not read."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import lifecycle as L
from tidewatch.operators.anomalies import empty_records
from tidewatch.operators.due import DueIndex, claims, deadlines

NOW = datetime(2026, 5, 1, 9, 30)


def at(minutes):
    return NOW + timedelta(minutes=minutes)


def entries(spark, *pairs):
    return spark.createDataFrame([(i, None if m is None else at(m)) for i, m in pairs], "id string, due timestamp_ntz")


def found(index, now=NOW):
    return sorted(r.id for r in index.due(now).collect())


def test_entries_move_and_leave(spark, folder):
    index = DueIndex(spark, folder)
    assert found(index) == []
    index.change(None, entries(spark, ("a", -200), ("b", 0), ("c", 1), ("d", 600), ("e", None), ("f", -10_000_000)), 0)
    assert found(index) == ["a", "b", "f"] and found(index, str(at(1))) == ["a", "b", "c", "f"]
    later = {p: f for p, f in index.table.files().items() if int(p.split("-")[0]) > index_span(index, spark, 60)}
    assert len(later) == 1
    # files of later spans are not read, nor written by a change in earlier ones
    assert not any(f.rsplit("/", 1)[1] in path for f in later.values() for path in index.due(NOW).inputFiles())
    index.change(entries(spark, ("a", -200), ("b", 0)), entries(spark, ("a", 300), ("b", 0)))
    assert found(index) == ["b", "f"] and found(index, at(300)) == ["a", "b", "c", "f"]
    assert all(index.table.files()[p] == f for p, f in later.items())
    # the same batch again; entries put in twice count once; removing what is not there does nothing
    assert index.change(None, entries(spark, ("z", -1)), 0) is None
    index.change(None, entries(spark, ("b", 0), ("b", 0)))
    index.change(entries(spark, ("b", 0), ("q", -5)), None)
    assert found(index) == ["f"]
    index.change(entries(spark, ("f", -10_000_000)), None)
    assert min(int(p.split("-")[0]) for p in index.table.files()) >= index_span(index, spark, 0)


def index_span(index, spark, minutes):
    return entries(spark, ("x", minutes)).select(index._span(F.col("due"))).first()[0]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai"])
def test_same_as_a_scan(spark, folder, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        columns = empty_records(spark).columns
        rows = [{"id": f"r{i}", "status": ["pending", "processing", "normal"][i % 3], "validation_deadline": at(i - 20) if i % 5 else None} for i in range(60)]
        records = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], empty_records(spark).schema)
        index = DueIndex(spark, folder, 600)
        index.change(None, deadlines(records))
        assert found(index) == sorted(r.id for r in L.due_records(records, NOW).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ends_of_claims(spark):
    jobs = spark.createDataFrame([(s, s, NOW) for s in ("executing", "publishing", "ds_scheduled", "sent")], "id string, status string, updated_at timestamp_ntz")
    got = {r.id: r.due and (r.due - NOW).total_seconds() for r in claims(jobs, 10).collect()}
    assert got == {"executing": 32, "publishing": 30, "ds_scheduled": 600, "sent": None}


def test_stored_parts_follow_the_number_of_records(spark, monkeypatch):
    from tidewatch.plans import anomaly_queries as Q

    made = []

    class Seen(Q.KeyedTable):
        def __init__(self, *args, **options):
            super().__init__(*args, **options)
            made.append(self.buckets)

    monkeypatch.setattr(Q, "KeyedTable", Seen)
    monkeypatch.setattr(Q, "PART_ROWS", 50)
    rows = Q.a18_indexed(spark, "/root/testdata/sf0.001").count()
    records = Q.record_frame(spark, "/root/testdata/sf0.001").count()
    assert made == [records // 50] and made[0] > 8 and rows > 0
