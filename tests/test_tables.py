"""Versions, retries, folding and clean-up of the batch and keyed tables."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.streaming.manifest import CommitFailed, Conflict, Manifests
from tidewatch.streaming.tables import BatchTable, KeyedTable


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def total(df):
    return df.groupBy("id").agg(F.sum("n").alias("n"))


def folders(path):
    return sorted(os.listdir(f"{path}/data"))


def test_a_read_opens_one_manifest(spark, folder, monkeypatch):
    table = BatchTable(spark, folder)
    for i in range(6):
        assert table.write(spark.range(i, i + 1), i)
    opened = []
    plain = Manifests.snapshot
    monkeypatch.setattr(Manifests, "snapshot", lambda self, version=None: opened.append(version) or plain(self, version))
    rows = table.read()
    assert len(opened) == 1 and ids(rows) == list(range(6))
    # an older version stays as it was
    assert ids(table.read(3)) == [0, 1, 2] and sorted(r.batch_id for r in table.read(3).collect()) == [0, 1, 2]


def test_a_failed_commit_is_tried_again_and_leaves_the_old_version(spark, folder, monkeypatch):
    table = BatchTable(spark, folder, interval_ms=1)
    table.write(spark.range(2), 0)
    attempts, plain = [], Manifests.publish

    def failing(times):
        def publish(self, version, content):
            attempts.append(version)
            if len(attempts) <= times:
                raise OSError("no answer")
            return plain(self, version, content)

        return publish

    monkeypatch.setattr(Manifests, "publish", failing(3))
    assert table.write(spark.range(2, 4), 1) and len(attempts) == 4
    attempts.clear()
    monkeypatch.setattr(Manifests, "publish", failing(99))
    with pytest.raises(CommitFailed):
        table.write(spark.range(9, 12), 2)
    assert len(attempts) == 4
    monkeypatch.setattr(Manifests, "publish", plain)
    assert ids(table.read()) == [0, 1, 2, 3] and table.batch_ids() == [0, 1]
    # what the dead writer left goes, and the batch may come again
    left = len(folders(folder))
    assert len(table.vacuum(grace_ms=0)) == 1 and len(folders(folder)) == left - 1
    assert table.write(spark.range(9, 12), 2) and not table.write(spark.range(1), 2)
    assert ids(table.read()) == [0, 1, 2, 3, 9, 10, 11]


def test_two_writers_do_not_lose_each_other(spark, folder, monkeypatch):
    table, other = BatchTable(spark, folder), BatchTable(spark, folder)
    table.write(spark.range(1), 0)
    plain, raced = Manifests.publish, []

    def publish(self, version, content):
        if not raced:
            raced.append(version)
            other.write(spark.range(5, 6), 1)
        return plain(self, version, content)

    monkeypatch.setattr(Manifests, "publish", publish)
    assert table.write(spark.range(2, 3), 2)
    assert ids(table.read()) == [0, 2, 5]
    with pytest.raises(Conflict):
        plain(table.log, 1, {})


def test_fold_compact_and_vacuum(spark, folder):
    table = BatchTable(spark, folder)
    for i in range(3):
        table.write(spark.createDataFrame([(1, 1), (i, 10)], "id int, n int"), i)
    expected = sorted(map(str, total(table.read()).collect()))
    assert table.fold(total) == 2 and table.fold(total) is None
    assert sorted(map(str, total(table.read()).collect())) == expected and table.batch_ids() == []
    assert not table.write(spark.createDataFrame([(7, 7)], "id int, n bigint"), 1)
    table.write(spark.createDataFrame([(7, 7)], "id int, n bigint"), 3)
    assert table.read().count() == 4 and table.batch_ids() == [3]
    assert len(table.vacuum(grace_ms=0)) == 3 and len(folders(folder)) == 2
    assert len(table.log.versions()) == 1 and table.read().count() == 4
    # a log's batches are put together without reading the parts before
    before = folders(folder)
    assert table.compact() == 3 and table.compact() is None
    assert set(before) < set(folders(folder)) and table.read().filter("batch_id = 3").count() == 1
    assert table.vacuum() == [] and len(folders(folder)) == 3  # young files stay
    table.forget(3)
    assert not table.holds_rows() and not table.write(spark.range(1), 3)
    with pytest.raises(ValueError):
        table.refuse_fresh_checkpoint(f"{folder}/none")


def keyed(spark, folder, buckets=8):
    return KeyedTable(spark, folder, ["id"], lambda df: df.groupBy("id").agg(F.max("n").alias("n")), buckets)


def test_a_merge_rewrites_only_the_buckets_it_touches(spark, folder):
    table = keyed(spark, folder)
    table.merge(spark.range(200).withColumn("n", F.lit(1)), 0)
    before = table.files()
    assert len(before) == 8
    touched = table.merge(spark.createDataFrame([(3, 5), (3, 4), (4, 0)], "id long, n int"), 1)
    after = table.files()
    assert 1 <= len(touched) <= 2 and {b for b in before if before[b] != after[b]} == set(touched)
    assert {r.id: r.n for r in table.read().filter("n > 1").collect()} == {3: 5} and table.read().count() == 200
    assert {r.id: r.n for r in table.read(1).collect()} == dict.fromkeys(range(200), 1)
    assert table.merge(spark.createDataFrame([(3, 9)], "id long, n int"), 1) is None
    # a look-up reads the buckets of its keys
    found = table.lookup(spark.createDataFrame([(3,), (999,)], "id long"))
    assert [(r.id, r.n) for r in found.collect()] == [(3, 5)]
    read = {f.split("/__part=")[1].split("/")[0] for f in found.inputFiles() if "__part=" in f}
    assert len(read) <= 2 and read <= set(before)
    gone = table.vacuum(grace_ms=0)
    assert table.read().count() == 200 and all(g not in {f.rsplit("/", 1)[0] for f in after.values()} for g in gone)


def test_concurrent_merges_of_a_bucket(spark, folder, monkeypatch):
    table, other = keyed(spark, folder, 2), keyed(spark, folder, 2)
    table.merge(spark.createDataFrame([(1, 1)], "id long, n int"), 0)
    plain, raced = Manifests.publish, []

    def publish(self, version, content):
        if not raced:
            raced.append(version)
            other.merge(spark.createDataFrame([(1, 50), (2, 2)], "id long, n int"), 1)
        return plain(self, version, content)

    monkeypatch.setattr(Manifests, "publish", publish)
    table.merge(spark.createDataFrame([(1, 7), (9, 9)], "id long, n int"), 2)
    assert {r.id: r.n for r in table.read().collect()} == {1: 50, 2: 2, 9: 9}


def test_rows_that_a_merge_drops(spark, folder):
    """A key whose rows fold to nothing leaves; its bucket may become empty."""
    table = KeyedTable(spark, folder, ["id"], lambda df: df.groupBy("id").agg(F.min("n").alias("n")).filter("n > 0"), 4)
    table.merge(spark.createDataFrame([(1, 1), (2, 1)], "id long, n int"), 0)
    table.merge(spark.createDataFrame([(1, 0)], "id long, n int"), 1)
    assert [r.id for r in table.read().collect()] == [2]
    table.merge(spark.createDataFrame([(2, 0)], "id long, n int"), 2)
    assert not table.holds_rows() and table.read().count() == 0
    with pytest.raises(LookupError):
        keyed(spark, f"{folder}/other").read()


def test_parts_by_value(spark, folder):
    """Rows are found by the values they are parted by, nulls and the empty text apart, and other parts stay."""
    table = KeyedTable(spark, folder, ["id"], lambda df: df.groupBy("id").agg(F.max("day").alias("day"), F.max("n").alias("n")), 2, by=["day"])
    rows = [(i, d, 1) for i, d in enumerate(["a", "b", None, "", "a/b=c", "a"])]
    assert table.merge(spark.createDataFrame(rows, "id long, day string, n int"), mark=("job", "run-1"))
    assert table.merge(spark.createDataFrame([(0, "a", 9)], "id long, day string, n int"), mark=("job", "run-1")) is None
    before = table.files()
    assert len(table.merge(spark.createDataFrame([(0, "a", 5)], "id long, day string, n int"), mark=("job", "run-2"))) == 1
    assert sum(before[p] != f for p, f in table.files().items()) == 1
    for value, expected in (("a", [0, 5]), (None, [2]), ("", [3]), ("a/b=c", [4]), ("none", [])):
        assert ids(table.within(spark.createDataFrame([(value,)], "day string"))) == expected
    assert {(r.id, r.n) for r in table.read().collect()} == {(0, 5), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1)}
