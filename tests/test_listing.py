"""Deep pages and literal search from stored ranges."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.listing import PagedList, SearchList

NAMES = ["orders daily", "orders weekly", "50%_off", "a_b", "store metrics", "日本の店舗", "", None, "orders"]


def records(spark, n=600):
    rows = [(f"a{i:04d}", NAMES[i % len(NAMES)], f"set t_{i % 50}", i // 7, [f"f{i % 5}", None]) for i in range(n)]
    return spark.createDataFrame(rows, "id string, rule_name string, dataset_name string, seen int, fields array<string>")


def test_pages_read_their_ranges(spark, folder):
    df = records(spark)
    pages = PagedList(spark, folder, [F.col("seen").desc(), F.col("id").asc()], rows_per_range=50)
    with pytest.raises(LookupError):
        pages.page()
    pages.build(df)
    expected = [r.id for r in df.orderBy(F.desc("seen"), "id").collect()]
    for size in (1, 20, 100):
        for number in (1, 2, 600 // size // 2, 600 // size, 600 // size + 1):
            rows, total = pages.page(number, size)
            start = (max(number, 1) - 1) * size
            assert total == 600 and [r.id for r in rows.collect()] == expected[start:start + size], (size, number)
    rows, _ = pages.page(15, 20)
    files = rows.inputFiles()
    assert 1 <= len({f.split("__range=")[1].split("/")[0] for f in files}) <= 2
    # no task holds the rows before the page: what is read is about a range
    held = spark.read.parquet(*[f.rsplit("/", 1)[0] for f in files]).count()
    assert held <= 4 * 50
    pages.build(df.filter("seen < 10"))
    assert pages.page()[1] == 70
    assert len(pages.vacuum(grace_ms=0)) == 1 and pages.page(4, 20)[0].count() == 10
    pages.build(df.filter("false"))
    rows, total = pages.page()
    assert total == 0 and rows.count() == 0


@pytest.mark.parametrize("term", ["orders", "rders d", "%_o", "_", "a_b", "t_3", "t_33", "f2", "f", "日本", "の店舗", "missing text", "ordersx", "", "set"])
def test_search_is_exact(spark, search, term):
    df, found = search
    hit = F.coalesce(F.contains("rule_name", F.lit(term)), F.lit(False)) | F.contains("dataset_name", F.lit(term))
    hit = hit | F.coalesce(F.array_contains("fields", term), F.lit(False))
    expected = sorted(r.id for r in (df.filter(hit) if term else df).collect())
    assert sorted(r.id for r in found.search(term).collect()) == expected


@pytest.fixture(scope="module")
def search(spark):
    import tempfile

    df = records(spark)
    found = SearchList(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), ["rule_name", "dataset_name"], F.col("fields"), rows_per_range=20)
    found.build(df)
    return df, found


def test_search_leaves_files_unread(spark, search):
    _, found = search
    everywhere = found.ranges_of("")
    assert len(everywhere) > 20 and found.ranges_of("f2") == everywhere  # shorter than a gram
    for term in ("50%_off", "日本の店舗", "weekly"):
        few = found.ranges_of(term)
        assert few and len(few) < len(everywhere) / 3
        read = {f.split("__range=")[1].split("/")[0] for f in found.search(term).inputFiles()}
        assert read <= {str(r) for r in few}
    assert found.ranges_of("missing text") == []


def test_a_frequent_name_is_spread(spark, folder):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("name"))
    found = SearchList(spark, folder, ["name"], rows_per_range=200)
    found.build(df)
    sizes = dict(found.log.snapshot().content["ranges"])
    assert sum(sizes.values()) == 2000 and max(sizes.values()) < 600
    assert found.search("hot").count() == 1333
