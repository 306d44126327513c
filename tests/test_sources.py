from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tidewatch.sources import datasets as D


@pytest.fixture
def orders(spark):
    rows = [("o1", Decimal("12.34"), "paid"), ("o2", Decimal("37.66"), "paid"), ("o3", None, None)]
    df = spark.createDataFrame(rows, "order_id string, amount decimal(12,2), status string")
    df.createOrReplaceTempView("t_orders")
    spark.createDataFrame([("o1", "web"), ("o2", "app")], "order_id string, channel string").createOrReplaceTempView("t_links")
    return df


@pytest.mark.parametrize(
    "sql", ["SELECT * FROM t_orders", "select 1;", "WITH x AS (SELECT 1 a) SELECT a FROM x", "SELECT 1 UNION ALL SELECT 2", "SELECT * FROM t_orders ORDER BY 1 LIMIT 2",
            "SELECT status, count(*) OVER (PARTITION BY status) FROM t_orders WHERE amount IN (SELECT max(amount) FROM t_orders) GROUP BY status HAVING count(*) > 0",
            "SELECT /*+ BROADCAST(t_links) */ * FROM t_orders LEFT JOIN t_links USING (order_id)", "SELECT * FROM t_orders TABLESAMPLE (50 PERCENT)",
            "SELECT * FROM t_orders o, t_links l WHERE o.order_id = l.order_id", "SELECT o.x FROM (VALUES (1), (2)) AS o(x) EXCEPT SELECT 2", "SELECT explode(array(1, 2)) FROM t_orders", "SELECT * FROM t_orders LATERAL VIEW explode(array(1, 2)) e AS x"],
)
def test_queries_are_accepted(spark, orders, sql):
    D.scan(spark, sql).collect()


@pytest.mark.parametrize(
    "sql",
    ["", "  ", "DROP TABLE t_orders", "INSERT INTO t_orders SELECT * FROM t_orders", "CREATE TABLE a AS SELECT 1", "SELECT 1; SELECT 2", "DELETE FROM t_orders",
     "UPDATE t_orders SET status = 'x'", "SET a = 1", "SHOW TABLES", "ALTER TABLE t_orders ADD COLUMN x int", "TRUNCATE TABLE t_orders", "nonsense", None,
     "FROM t_orders INSERT INTO a SELECT *", "EXPLAIN SELECT 1", "VALUES (1)", "EXECUTE IMMEDIATE 'DROP VIEW t_orders'", "TABLE t_orders", "CACHE TABLE t_orders",
     "SELECT reflect('java.lang.System', 'lineSeparator')", "SELECT a FROM (SELECT java_method('java.lang.System', 'lineSeparator') a)",
     "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT 1 WHERE EXISTS (SELECT * FROM text.`/etc/hosts`)", "SELECT * FROM org.apache.spark.sql.json.`/tmp/x`",
     "WITH x AS (SELECT reflect('java.lang.System', 'lineSeparator') a) SELECT a FROM x", "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.System', 'lineSeparator'))"],
)
def test_everything_else_is_refused(spark, orders, sql):
    with pytest.raises(D.NotReadOnly):
        D.check_read_only(spark, sql)


def test_tables_of_databases_are_accepted(spark):
    for name in ("default.t", "spark_catalog.default.t"):
        D.check_read_only(spark, f"SELECT * FROM {name}")


def test_preview(spark, orders):
    seen = D.preview(orders, 2)
    assert (seen.row_count, seen.truncated, seen.rows.count()) == (2, True, 2)
    seen = D.preview(orders, 3)
    assert (seen.row_count, seen.truncated) == (3, False)
    assert seen.fields == [{"name": "order_id", "type": "VARCHAR"}, {"name": "amount", "type": "DECIMAL"}, {"name": "status", "type": "VARCHAR"}]


def test_bounded_queries(spark, orders):
    def value(sql):
        return D.scan(spark, sql).first()[0]

    assert value("SELECT count(*) FROM t_orders") == 3
    assert value("SELECT count(*) FROM t_orders WHERE status <> 'cancelled'") == 2
    assert value("WITH p AS (SELECT status, sum(amount) s FROM t_orders GROUP BY status) SELECT s FROM p WHERE status = 'paid'") == Decimal("50.00")
    assert value("SELECT count(*) FROM t_orders o JOIN t_links l ON o.order_id = l.order_id") == 2
    assert len(D.scan(spark, "SELECT * FROM t_orders LIMIT 1").collect()) == 1


def test_zero_columns_keep_the_rows(orders):
    assert D.project(orders, []).count() == 3


def test_values_that_do_not_fit_fail(spark):
    df = spark.createDataFrame([("123.45",), (None,)], "a string")
    fits = T.StructType([T.StructField("a", T.DecimalType(5, 2))])
    assert [r.a for r in D.typed(df, fits).collect()] == [Decimal("123.45"), None]
    with pytest.raises(Exception):
        D.typed(df, T.StructType([T.StructField("a", T.DecimalType(4, 2))])).collect()
    with pytest.raises(TypeError):
        D.typed(df, T.StructType([T.StructField("a", T.ArrayType(T.StringType()))]))


def test_label_repair(spark):
    rows = [("run-seed-0001", "SEED-000001", "??", "[]"), ("run-seed-0006", "SEED-000006", "??", "[]"), ("live-9", "L-1", "web", "[]")]
    df = spark.createDataFrame(rows, "id string, order_no string, channel string, items string")
    got = {r.order_no: (r.channel, r["items"]) for r in D.repair_labels(df).collect()}
    assert got["SEED-000001"] == ("堂食", '[{"name":"经典牛肉堡","quantity":2,"price":19}]')
    assert got["SEED-000006"] == ("小程序", '[{"name":"香辣鸡腿堡","quantity":1,"price":24}]')
    assert got["L-1"] == ("web", "[]")


def test_label_repair_of_numbers_ending_in_zeros(spark):
    df = spark.createDataFrame([("run-seed-00010000", "SEED-10000", "??", "[]")], "id string, order_no string, channel string, items string")
    row = D.repair_labels(df).first()
    assert (row.channel, row["items"]) == ("小程序", '[{"name":"鸡块","quantity":1,"price":18}]')
