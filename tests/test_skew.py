import random

from pyspark.sql import functions as F

from tidewatch.operators.skew import lookup, positions, previous, running, with_slices


def skewed(spark, n=3000):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        rows.append((key, rng.randrange(40), i, rng.randrange(100)))
    return rows, spark.createDataFrame(rows, "k string, t int, i int, v int")


def test_slices_follow_the_order(spark):
    _, df = skewed(spark)
    out = with_slices(df, ["t", "i"], 16)
    ordered = [r["__slice"] for r in out.orderBy("t", "i").collect()]
    assert ordered == sorted(ordered) and len(set(ordered)) > 8
    largest = out.groupBy("__slice").count().agg(F.max("count")).first()[0]
    assert largest < 3000 / 4


def test_positions_match_a_plain_sort(spark):
    rows, df = skewed(spark)
    got = {r.i: r.position for r in positions(df, ["k"], ["t", "i"]).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(range(len(mine)))


def test_positions_without_key_and_on_empty_input(spark):
    rows, df = skewed(spark, 500)
    got = {r.i: r.p for r in positions(df, [], ["t", "i"], "p").collect()}
    assert [got[r[2]] for r in sorted(rows, key=lambda r: (r[1], r[2]))] == list(range(500))
    assert positions(df.limit(0), ["k"], ["t"]).count() == 0


def test_running_totals(spark):
    rows, df = skewed(spark, 800)
    out = running(df, ["k"], ["t", "i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    got = {r.i: (r.s, r.m) for r in out.collect()}
    for key in {r[0] for r in rows}:
        total, best = 0, -1
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total, best = total + r[3], max(best, r[3])
            assert got[r[2]] == (total, best)


def test_previous_row_across_slices(spark):
    rows, df = skewed(spark, 800)
    df = df.withColumn("v", F.when(F.col("v") > 10, F.col("v")))
    got = {r.i: (r.prev_v, r.has_prev) for r in previous(df, ["k"], ["t", "i"], ["v"]).collect()}
    for key in {r[0] for r in rows}:
        before = None
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))):
            assert got[r[2]] == (before, n > 0)
            before = r[3] if r[3] > 10 else None


def test_lookup_keeps_all_rows_of_hot_and_null_keys(spark):
    rows, df = skewed(spark)
    dim = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, x int")
    out = lookup(df, dim, ["k"], ["x"], ["i"]).groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("x")).collect()
    want = {k: sum(r[0] == k for r in rows) for k in {r[0] for r in rows}}
    assert {r.k: r.n for r in out} == want
    assert {r.k: r.x for r in out} == {"hot": 1, "a": 2, "b": None, "c": None, None: None}


def test_hot_key_is_not_gathered(spark):
    """With shuffled joins forced, no partition holds the hot key's rows."""
    rows, df = skewed(spark, 4000)
    dim = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, x int")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = lookup(df, dim, ["k"], ["x"], ["i"]).withColumn("p", F.spark_partition_id())
        sizes = {r.p: r.n for r in out.groupBy("p").agg(F.count("*").alias("n")).collect()}
        assert out.filter("k = 'hot' and x = 1").count() == sum(r[0] == "hot" for r in rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes.values()) < 0.25 * len(rows)


def test_many_slices(spark):
    rows, df = skewed(spark, 2000)
    got = {r.i: r.p for r in positions(df, [], ["t", "i"], "p", parts=200).collect()}
    assert [got[r[2]] for r in sorted(rows, key=lambda r: (r[1], r[2]))] == list(range(len(rows)))


def test_order_with_nulls_and_times(spark):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.2 else rng.randrange(30), i) for i in range(600)]
    df = spark.createDataFrame(rows, "t int, i int").selectExpr(
        "timestamp_ntz'2026-03-29 00:30:00' + make_dt_interval(0, 0, t * 10) as n", "timestamp_seconds(1774744200 + t * 600) as z", "i"
    )
    want = [i for _, i in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))]
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for time in ("n", "z"):
                out = positions(df, [], [time, "i"], "p", parts=20).select("i", "p").collect()
                assert [r.i for r in sorted(out, key=lambda r: r.p)] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_time_numbers_do_not_depend_on_the_zone(spark):
    from tidewatch.functions.values import ntz_from_micros, ntz_micros

    df = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.999999' a, timestamp_ntz'2026-03-29 02:30:00.000001' b")
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = df.select(ntz_micros(df.a), ntz_micros(df.b), ntz_from_micros(ntz_micros(df.b)).cast("string")).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert tuple(got) == (-1, 1774751400000001, "2026-03-29 02:30:00.000001")
