"""Registered queries: dataset scans, previews, schema and typed reads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.plans import topic
from tidewatch.plans.registry import query
from tidewatch.session import table
from tidewatch.sources import changelog as C
from tidewatch.sources import datasets as D


@query(
    "s1_dataset_scan",
    """SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name
       UNION SELECT r_name, 0, 0 FROM region""",
)
def s1(spark, sf):
    D.register_tables(spark, sf, ["customer", "nation", "region"])
    return D.scan(
        spark,
        """WITH joined AS (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey)
           SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM joined GROUP BY n_name
           UNION SELECT r_name, 0, 0 FROM region""",
    )


ACCEPTED = {
    "select": "SELECT * FROM nation WHERE n_regionkey = 1",
    "with": "WITH x AS (SELECT n_regionkey AS k FROM nation) SELECT DISTINCT k FROM x",
    "union": "SELECT n_name FROM nation UNION SELECT r_name FROM region",
    "subquery": "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
}
REFUSED = {
    "drop": "DROP TABLE nation", "insert": "INSERT INTO nation SELECT * FROM nation", "create": "CREATE TABLE t AS SELECT 1 AS a",
    "two statements": "SELECT 1; DROP TABLE nation", "broken": "SELEC 1", "delete": "DELETE FROM nation", "values": "VALUES (1)",
    "immediate": "EXECUTE IMMEDIATE 'DROP VIEW nation'", "reflect": "SELECT reflect('java.lang.System', 'lineSeparator') FROM nation",
    "java method": "SELECT java_method('java.lang.System', 'lineSeparator') FROM nation",
    "hidden": "SELECT n_name FROM nation WHERE n_name = (SELECT max(reflect('java.lang.System', 'lineSeparator')) FROM region)",
}


@query(
    "s1_read_only_guard",
    " UNION ALL ".join(
        [f"SELECT '{name}' AS statement, 'accepted' AS outcome, count(*) AS found FROM ({text})" for name, text in ACCEPTED.items()]
        + [f"SELECT '{name}', 'refused', count(*) FROM nation" for name in REFUSED]
    ),
)
def s1_guard(spark, sf):
    """Rows of each accepted query, and of the table after each refused statement."""
    D.register_tables(spark, sf, ["nation", "region"])
    out = None
    for name, text in {**ACCEPTED, **REFUSED}.items():
        try:
            found, outcome = D.scan(spark, text), "accepted"
        except D.NotReadOnly:
            found, outcome = spark.table("nation"), "refused"
        row = found.agg(F.lit(name).alias("statement"), F.lit(outcome).alias("outcome"), F.count("*").alias("found"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "s2_preview",
    """SELECT CASE WHEN n > 200 THEN 200 ELSE n END AS row_count, n > 200 AS truncated, 4 AS field_count FROM (SELECT count(*) AS n FROM supplier)
       UNION ALL SELECT 200, true, 6 FROM (SELECT count(*) AS n FROM orders)""",
)
def s2(spark, sf):
    out = None
    for name in ("supplier", "orders"):
        seen = D.preview(table(spark, sf, name))
        row = seen.rows.agg(F.count("*").alias("row_count"), F.lit(seen.truncated).alias("truncated"), F.lit(len(seen.fields)).alias("field_count"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "s3_schema_inference",
    """SELECT * FROM (VALUES ('o_orderkey', 'BIGINT'), ('o_custkey', 'BIGINT'), ('o_orderstatus', 'VARCHAR'), ('o_totalprice', 'DOUBLE'), ('o_orderdate', 'DATETIME'), ('o_orderpriority', 'VARCHAR'),
       ('price', 'DECIMAL'), ('day', 'DATE'), ('small', 'SMALLINT'), ('flag', 'VARCHAR')) v(name, type), (SELECT count(*) AS "rows" FROM orders)""",
)
def s3(spark, sf):
    df = table(spark, sf, "orders").withColumns(
        {
            "price": F.col("o_totalprice").cast("decimal(12,2)"), "day": F.col("o_orderdate").cast("date"),
            "small": F.lit(1).cast("smallint"), "flag": F.lit(True),
        }
    )
    fields = F.array(*[F.struct(F.lit(f["name"]).alias("name"), F.lit(f["type"]).alias("type")) for f in D.inferred_fields(df)])
    return df.agg(F.count("*").alias("rows")).select(F.explode(fields).alias("f"), "rows").select("f.name", "f.type", "rows")


@query("s5_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def s5(spark, sf):
    return D.project(table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity"])


@query("s5_zero_column_projection", "SELECT count(*) AS n FROM lineitem")
def s5_zero(spark, sf):
    return D.project(table(spark, sf, "lineitem"), []).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s6_typed_rows",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(9,2)) AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders""",
)
def s6(spark, sf):
    schema = T.StructType(
        [T.StructField("o_orderkey", T.IntegerType()), T.StructField("o_totalprice", T.DecimalType(9, 2)), T.StructField("o_orderdate", T.TimestampNTZType())]
    )
    out = D.typed(table(spark, sf, "orders"), schema)
    return out.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderdate").cast("string").alias("o_orderdate"))


@query(
    "s9_change_envelopes",
    """WITH k AS (SELECT event_id, user_id, event_type, unnest(CASE WHEN event_type = 'click' THEN ['c', 'u', 'u'] WHEN event_type = 'view' AND user_id % 2 = 0 THEN ['c', 'u', 'd'] ELSE ['c', 'u'] END) AS op FROM events)
       SELECT op, concat('S00', 1 + user_id % 4) AS store_id, count(*) AS n FROM k GROUP BY ALL""",
)
def s9(spark, sf):
    rows = C.parse_changes(topic.raw(spark, sf))
    return rows.groupBy("op", F.coalesce("after.store_id", "before.store_id").alias("store_id")).agg(F.count("*").alias("n"))


@query(
    "s10_snapshot_and_change_ops",
    """SELECT event_type, CASE event_type WHEN 'error' THEN 'd' WHEN 'view' THEN 'r' WHEN 'click' THEN 'u' ELSE 'c' END AS op, round(sum(CASE WHEN event_type = 'error' THEN value ELSE value + 1 END), 2) AS total FROM events GROUP BY 1""",
)
def s10(spark, sf):
    df = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "view", "r").when(F.col("event_type") == "click", "u").otherwise("c")
    old, new = F.struct(F.col("value").alias("v")), F.struct((F.col("value") + 1).alias("v"))
    changes = df.select("event_type", op.alias("op"), F.when(op.isin("u", "d"), old).alias("before"), F.when(op != "d", new).alias("after"))
    return C.image(changes).groupBy("event_type", "op").agg(F.round(F.sum("row.v"), 2).alias("total"))


@query(
    "s15_label_repair",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['堂食', '外卖', '小程序'][(n + 2) % 3 + 1] ELSE 'old' END AS channel,
         CASE WHEN p_size % 2 = 0 THEN '[{"name":"' || ['经典牛肉堡', '香辣鸡腿堡', '薯条', '鸡块'][(n + 3) % 4 + 1] || '","quantity":' || (n % 2 + 1) || ',"price":' || (18 + n % 17) || '}]' ELSE '[]' END AS items
       FROM (SELECT *, (p_partkey + 1) % 10000 AS n FROM part)""",
)
def s15(spark, sf):
    n = F.col("p_partkey") + 1
    number = n.cast("string")  # padded to eight digits; a longer one keeps its last four
    orders = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("run-seed-"), F.lpad(number, F.greatest(F.lit(8), F.length(number)), "0")).alias("id"),
        F.concat(F.when(F.col("p_size") % 2 == 0, "SEED-").otherwise("LIVE-"), number).alias("order_no"),
        F.lit("old").alias("channel"), F.lit("[]").alias("items"),
    )
    return D.repair_labels(orders).select("p_partkey", "channel", "items")
