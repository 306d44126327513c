"""Datasets: read-only SQL, previews, typed reads and bounded table scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import ParseException

from tidewatch.functions.values import field_list

_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
_ANALYSIS = "org.apache.spark.sql.catalyst.analysis."

# Channel and item labels a seeded order's number selects.
CHANNELS = ["堂食", "外卖", "小程序"]
ITEMS = ["经典牛肉堡", "香辣鸡腿堡", "薯条", "鸡块"]

SCALAR_TYPES = (
    T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType,
)


class NotReadOnly(ValueError):
    """The text is not a single read-only query."""


#: Plan nodes of Spark's parser that a query may be made of; any other is refused.
READ_NODES = frozenset((
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample",
    "Sort", "SubqueryAlias", "Tail", "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedWith", "Unpivot", "WithWindowDefinition", "UnresolvedHint",
))
#: What a query may be at its root: SELECT (with or without clauses) or a set operation.
READ_ROOTS = READ_NODES - {"LocalRelation", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedTableValuedFunction", "OneRowRelation", "SubqueryAlias"}
#: Functions that run code of the caller's choice.
REFUSED_FUNCTIONS = frozenset(("reflect", "java_method", "try_reflect"))


def check_read_only(spark: SparkSession, sql: str) -> str:
    """Accept one SELECT, WITH or UNION statement; Spark's own parser decides.

    Every node of the parsed plan, those of subqueries and WITH parts included, must be
    one that reads; a statement that Spark learns in a later version is refused until listed.
    """
    if not isinstance(sql, str) or not sql.strip():
        raise NotReadOnly("a dataset needs a query")
    text = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        raise NotReadOnly(f"cannot parse the query: {error}") from error
    if plan.getClass().getSimpleName() not in READ_ROOTS:
        raise NotReadOnly("only SELECT or WITH queries are allowed")
    subquery = spark._jvm.java.lang.Class.forName(_EXPRESSIONS + "PlanExpression")
    function = spark._jvm.java.lang.Class.forName(_ANALYSIS + "UnresolvedFunction")
    plans, expressions = [plan], []

    def each(items):
        return [items.apply(i) for i in range(items.size())]

    while plans or expressions:
        if plans:
            node = plans.pop()
            if node.getClass().getSimpleName() not in READ_NODES:
                raise NotReadOnly(f"the statement does more than read: {node.getClass().getSimpleName()}")
            if node.getClass().getSimpleName() == "UnresolvedRelation":
                _check_table(spark, each(node.multipartIdentifier()))
            plans += each(node.children())
            plans += [p for p in each(node.innerChildren()) if hasattr(p, "innerChildren")]
            expressions += each(node.expressions())
        else:
            node = expressions.pop()
            if subquery.isInstance(node):
                plans.append(node.plan())
            if function.isInstance(node) and node.nameParts().last().lower() in REFUSED_FUNCTIONS:
                raise NotReadOnly(f"the function {node.nameParts().last()} is not allowed")
            expressions += each(node.children())
    return text


def _check_table(spark: SparkSession, parts: list[str]) -> None:
    """A table of a database or catalogue there is; ``format.`path` `` would read any file the job can."""
    if len(parts) > 1 and not spark.catalog.databaseExists(parts[0]) and not spark.catalog.listCatalogs(parts[0]):
        raise NotReadOnly(f"{'.'.join(parts)} is no table of a known database")


def register_tables(spark: SparkSession, directory: str, names: list[str]) -> None:
    """Make a directory of parquet tables available to dataset queries."""
    for name in names:
        spark.read.parquet(f"{directory}/{name}.parquet").createOrReplaceTempView(name)


def scan(spark: SparkSession, sql: str) -> DataFrame:
    """A dataset as a DataFrame: whole result, planned by Catalyst."""
    return spark.sql(check_read_only(spark, sql))


def jdbc_scan(
    spark: SparkSession, url: str, sql: str, options: dict[str, str], split_on: str | None = None,
    bounds: tuple[str, str] | None = None, splits: int = 1, fetch_size: int = 1000,
) -> DataFrame:
    """A dataset in a database; with a split column the scan runs in parallel."""
    text = check_read_only(spark, sql)
    reader = (
        spark.read.format("jdbc").options(**options).option("url", url)
        .option("fetchsize", fetch_size).option("preferTimestampNTZ", "true")
    )
    if split_on is None:
        return reader.option("query", text).load()
    low, high = bounds
    return (
        reader.option("dbtable", f"({text}) dataset")
        .option("partitionColumn", split_on).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", splits).load()
    )


@dataclass(frozen=True)
class Preview:
    fields: list[dict[str, str]]
    rows: DataFrame
    row_count: int
    truncated: bool


def preview(df: DataFrame, limit: int = 200) -> Preview:
    """The first rows, their number, and whether more exist."""
    seen = df.limit(limit + 1).count()
    return Preview(field_list(df.schema), df.limit(limit), min(seen, limit), seen > limit)


def inferred_fields(df: DataFrame) -> list[dict[str, str]]:
    return field_list(df.schema)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the requested columns; with none, still one row per table row."""
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df.select()


def check_scalar_schema(schema: T.StructType) -> None:
    for field in schema.fields:
        if not isinstance(field.dataType, SCALAR_TYPES):
            raise TypeError(f"unsupported type of {field.name}: {field.dataType.simpleString()}")


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns converted to a scalar schema; a value that does not fit fails the read.

    Times without zone keep their wall-clock value whatever the session zone.
    """
    check_scalar_schema(schema)
    columns = []
    for field in schema.fields:
        raw = F.col(f"`{field.name}`")
        value = raw.try_cast(field.dataType)
        message = F.lit(f"value does not fit {field.name} {field.dataType.simpleString()}")
        failed = F.raise_error(message).cast(field.dataType)
        columns.append(F.when(raw.isNotNull() & value.isNull(), failed).otherwise(value).alias(field.name))
    return df.select(*columns)


def repair_labels(orders: DataFrame, key: str = "id", number: str = "order_no") -> DataFrame:
    """Recompute channel and items of seeded orders from their key's last four digits."""
    n = F.right(F.col(key), F.lit(4)).try_cast("int")
    price = 18 + n % 17

    def pick(labels: list[str]):
        return F.element_at(F.array(*[F.lit(x) for x in labels]), F.pmod(n - 1, F.lit(len(labels))) + 1)

    item = F.struct(pick(ITEMS).alias("name"), (n % 2 + 1).alias("quantity"), price.alias("price"))
    seeded = F.col(number).like("SEED-%")
    return orders.withColumns(
        {
            "channel": F.when(seeded, pick(CHANNELS)).otherwise(F.col("channel")),
            "items": F.when(seeded, F.to_json(F.array(item))).otherwise(F.col("items")),
        }
    )
