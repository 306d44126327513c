"""Row encodings of the keyed sink: operation flag, text and JSON lines, schema check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operation flag column and its numbers, null text, default separator.
OP_COLUMN = "__op"
UPSERT, DELETE = 0, 1
ROW_KINDS = {"insert": UPSERT, "update_after": UPSERT, "update_before": DELETE, "delete": DELETE}
NULL_TEXT = "\\N"
DEFAULT_SEPARATOR = "\t"

# Written types a target column type accepts; types not listed accept anything.
ACCEPTED = {
    "bigint": {"bigint", "int", "binary"},
    "largeint": {"decimal", "bigint", "int", "binary"},
    "char": {"string"},
    "date": {"date", "string"},
    "datetime": {"timestamp_ntz", "timestamp", "string"},
    "decimal": {"decimal", "bigint", "int", "double", "float"},
    "double": {"double", "bigint", "int"},
    "float": {"float", "int"},
    "int": {"int", "binary"},
    "tinyint": {"tinyint", "int", "binary", "boolean"},
    "smallint": {"smallint", "int", "binary"},
    "varchar": {"string", "array", "map", "struct"},
    "string": {"string", "array", "map", "struct"},
}


class SchemaMismatch(ValueError):
    """The rows do not fit the target table."""


def encode_operations(rows: DataFrame, has_primary_key: bool = True, ignore_update_before: bool = True, kind: str = "row_kind") -> DataFrame:
    """Turn row kinds into the operation flag, dropping what must not be written."""
    if not has_primary_key:
        return rows.filter(F.col(kind).isin("insert", "update_after")).drop(kind)
    kept = rows.filter(F.col(kind) != "update_before") if ignore_update_before else rows
    flag = F.when(F.col(kind).isin("insert", "update_after"), UPSERT).when(
        F.col(kind).isin("delete", "update_before"), DELETE
    ).otherwise(F.raise_error(F.concat(F.lit("unsupported row kind: "), F.col(kind))).cast("int"))
    return kept.withColumn(OP_COLUMN, flag).drop(kind)


def change_rows(changes: DataFrame) -> DataFrame:
    """Change events as rows with their kind, both images of an update included."""
    others = [F.col(f"`{c}`") for c in changes.columns if c not in ("op", "before", "after")]
    op, step = F.col("op"), F.col("step")
    steps = F.when(op == "u", F.array(F.lit(0), F.lit(1))).when(op.isin("c", "r", "d"), F.array(F.lit(0)))
    spread = changes.select(*others, "op", "before", "after", F.explode(steps).alias("step"))
    old = (op == "d") | ((op == "u") & (step == 0))
    kind = F.when(op.isin("c", "r"), "insert").when(op == "d", "delete").when(step == 0, "update_before").otherwise("update_after")
    row = F.when(old, F.col("before")).otherwise(F.col("after"))
    return spread.select(*others, "step", kind.alias("row_kind"), row.alias("row")).select(*others, "step", "row_kind", "row.*")


def key_change_rows(changes: DataFrame, key: str) -> DataFrame:
    """Upsert of the new row, preceded by a delete of the old key when it differs."""
    moved = (F.col("op") == "u") & ~F.col(f"before.{key}").eqNullSafe(F.col(f"after.{key}"))
    return change_rows(changes.withColumn("__moved", moved)).filter(
        (F.col("row_kind") != "update_before") | F.col("__moved")
    ).drop("__moved")


def check_sink_schema(df: DataFrame, target: list[dict], primary_key: list[str] | None) -> bool:
    """Check rows against a target table; returns whether the columns are aligned.

    ``target``: ordered ``{name, type, key}`` of the table's columns. Key columns
    must agree, every written column must exist with an accepted type.
    """
    by_name = {c["name"].lower(): (i, c) for i, c in enumerate(target)}
    table_key = {c["name"].lower() for c in target if c.get("key")}
    if not target:
        raise SchemaMismatch("the target table has no columns")
    if table_key:
        if not primary_key:
            raise SchemaMismatch("the target has a primary key but none was declared")
        if {k.lower() for k in primary_key} != table_key or len(primary_key) != len(table_key):
            raise SchemaMismatch("the primary keys differ")
    places = []
    for field in df.schema.fields:
        if field.name == OP_COLUMN:
            continue
        if field.name.lower() not in by_name:
            raise SchemaMismatch(f"the target has no column {field.name}")
        place, column = by_name[field.name.lower()]
        wanted = column["type"].lower()
        if wanted in ACCEPTED and _root(field.dataType) not in ACCEPTED[wanted]:
            raise SchemaMismatch(f"{field.name}: {field.dataType.simpleString()} does not fit {wanted}")
        places.append(place)
    return not table_key and len(places) == len(target) and places == sorted(places)


def _root(data_type: T.DataType) -> str:
    return data_type.simpleString().split("(")[0].split("<")[0]


def separator(text: str | None, default: str = DEFAULT_SEPARATOR) -> str:
    """A column separator; ``\\x`` starts its hexadecimal form."""
    if not text:
        return default
    if not text.lower().startswith("\\x"):
        return text
    digits = text[2:]
    if not digits or len(digits) % 2:
        raise ValueError(f"bad hexadecimal separator: {text}")
    try:
        return bytes.fromhex(digits).decode("latin-1")
    except ValueError as error:
        raise ValueError(f"bad hexadecimal separator: {text}") from error


def _time_text(column: Column) -> Column:
    """ISO text of a time; whole minutes without seconds, fractions in threes."""
    text = F.replace(column.cast("string"), F.lit(" "), F.lit("T"))
    fraction = F.regexp_extract(text, r"\.(\d+)$", 1)
    digits = F.ceil(F.length(fraction) / 3) * 3
    padded = F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(fraction, digits.cast("int"), "0"))
    short = F.regexp_replace(text, r"(T\d\d:\d\d):00$", "$1")
    return F.when(fraction != "", padded).otherwise(short)


def sink_value(column: Column, data_type: T.DataType) -> Column:
    """A value the way the sink writes it."""
    if isinstance(data_type, T.BooleanType):
        return column.cast("bigint")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return _time_text(column)
    if isinstance(data_type, T.DateType):
        return column.cast("string")
    if isinstance(data_type, T.BinaryType):
        return F.conv(F.hex(F.substring(column, -8, 8)), 16, -10).cast("bigint")
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda item: sink_value(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(column, lambda _, item: sink_value(item, data_type.valueType))
    if isinstance(data_type, T.StructType):
        fields = [sink_value(column[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def text_lines(df: DataFrame, sep: str | None = None) -> DataFrame:
    """One text line per row: null as ``\\N``, nested values as JSON."""
    pieces = []
    for field in df.schema.fields:
        value = sink_value(F.col(f"`{field.name}`"), field.dataType)
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        text = F.to_json(value) if nested else value.cast("string")
        pieces.append(F.coalesce(text, F.lit(NULL_TEXT)))
    return df.select(F.concat_ws(separator(sep), *pieces).alias("value"))


def json_lines(df: DataFrame, json_columns: list[str] | None = None) -> DataFrame:
    """One JSON object per row; text columns holding JSON become real objects."""
    wanted = set(json_columns or [])
    values = []
    for field in df.schema.fields:
        value = sink_value(F.col(f"`{field.name}`"), field.dataType)
        if field.name in wanted:
            looks = F.col(f"`{field.name}`").rlike(r"^[\[{]")
            quoted = F.to_json(F.array(F.col(f"`{field.name}`")))
            as_text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
            value = F.parse_json(F.when(looks, F.col(f"`{field.name}`")).otherwise(as_text))
            value = F.when(F.col(f"`{field.name}`").isNotNull(), value)
        values.append(value.alias(field.name))
    return df.select(F.to_json(F.struct(*values)).alias("value"))
