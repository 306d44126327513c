"""Column helpers: type names, JSON text, fingerprints, safe cells, back-off."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type names reported for a dataset's fields.
TYPE_NAMES = {
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INT",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.DecimalType: "DECIMAL",
    T.DateType: "DATE",
    T.TimestampNTZType: "DATETIME",
    T.TimestampType: "TIMESTAMP",
    T.BinaryType: "TEXT",
    T.StringType: "VARCHAR",
}

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, *FLOATING, T.DecimalType)
TIMELIKE = (T.DateType, T.TimestampType, T.TimestampNTZType)


def type_name(data_type: T.DataType) -> str:
    if type(data_type).__name__ == "VariantType":
        return "JSON"
    return TYPE_NAMES.get(type(data_type), "VARCHAR")


def field_list(schema: T.StructType) -> list[dict[str, str]]:
    """The saved field list of a dataset: ``[{name, type}]`` in column order."""
    return [{"name": f.name, "type": type_name(f.dataType)} for f in schema.fields]


def iso_text(column: Column, data_type: T.DataType) -> Column:
    """ISO-8601 text of a date or time value, fraction kept only when present."""
    text = column.cast("string")
    return text if isinstance(data_type, T.DateType) else F.replace(text, F.lit(" "), F.lit("T"))


def json_safe(column: Column, data_type: T.DataType) -> Column:
    """A value JSON can hold: decimals as doubles, times as ISO text, bytes as UTF-8."""
    if isinstance(data_type, T.DecimalType):
        return column.cast("double")
    if isinstance(data_type, TIMELIKE):
        return iso_text(column, data_type)
    if isinstance(data_type, T.BinaryType):
        return F.decode(column, "UTF-8")
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda item: json_safe(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(column, lambda _, item: json_safe(item, data_type.valueType))
    if isinstance(data_type, T.StructType):
        inner = F.struct(*[json_safe(column[f.name], f.dataType).alias(f.name) for f in data_type.fields])
        return F.when(column.isNotNull(), inner)
    return column


def json_row(fields: list[tuple[str, Column, T.DataType]]) -> Column:
    """JSON object text of a row; nulls are kept."""
    safe = F.struct(*[json_safe(column, data_type).alias(name) for name, column, data_type in fields])
    return F.to_json(safe, {"ignoreNullFields": "false"})


def json_columns(df: DataFrame, names: list[str] | None = None) -> Column:
    wanted = names if names is not None else df.columns
    return json_row([(name, F.col(f"`{name}`"), df.schema[name].dataType) for name in wanted])


def json_scalar(column: Column, data_type: T.DataType) -> Column:
    """JSON text of a single value (quoted text, bare number, ``null``)."""
    wrapped = F.to_json(F.array(json_safe(column, data_type)), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def canonical_json(df: DataFrame, names: list[str], *, item_sep: str = ",", key_sep: str = ":") -> Column:
    """Key-sorted JSON object of the named columns with explicit separators."""
    pieces: list[Column] = []
    for index, name in enumerate(sorted(names)):
        quoted = name.replace("\\", "\\\\").replace('"', '\\"')
        head = ("{" if index == 0 else item_sep) + f'"{quoted}"{key_sep}'
        pieces += [F.lit(head), json_scalar(F.col(f"`{name}`"), df.schema[name].dataType)]
    return F.concat(*pieces, F.lit("}")) if pieces else F.lit("{}")


def fingerprint(business_key: Column) -> Column:
    """Identity of a business key: sha-256 of its canonical JSON text."""
    return F.sha2(business_key, 256)


def derived_id(*parts: Column) -> Column:
    """A repeatable 32-character id, so that a re-run task yields the same row."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, 32)


def clean_text(column: Column) -> Column:
    """Trimmed text, null when blank."""
    trimmed = F.regexp_replace(column.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(trimmed != "", trimmed)


def formula_safe(column: Column, data_type: T.DataType) -> Column:
    """Spreadsheet-safe cell: text that would start a formula gets a leading quote."""
    if not isinstance(data_type, T.StringType):
        return column
    risky = column.rlike(r"^[\s\p{Z}\x00-\x1f]*[=+\-@]")
    return F.when(risky, F.concat(F.lit("'"), column)).otherwise(column)


def backoff_seconds(attempts: Column, cap: int = 300) -> Column:
    """Job retry delay: two to the power of the attempts (at least one), capped."""
    exponent = F.least(F.greatest(attempts, F.lit(1)), F.lit(30))
    return F.least(F.pow(F.lit(2.0), exponent), F.lit(float(cap))).cast("long")


def request_backoff_seconds(failures: Column, base: int = 300, cap: int = 3600) -> Column:
    """Request retry delay: base doubled per further failure (exponent <= 10), capped."""
    exponent = F.least(F.greatest(failures - 1, F.lit(0)), F.lit(10))
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), exponent), F.lit(float(cap))).cast("long")


def plus_seconds(moment: Column, seconds: Column) -> Column:
    return moment + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def ntz_micros(moment: Column) -> Column:
    """Microseconds since 1970 of a time without zone, independent of the session zone."""
    days = F.unix_date(moment.cast("date")).cast("long")
    minutes = F.hour(moment).cast("long") * 60 + F.minute(moment)
    seconds = F.extract(F.lit("SECOND"), moment) * 1000000
    return (days * 1440 + minutes) * 60000000 + seconds.cast("long")


def ntz_from_micros(micros: Column) -> Column:
    """The inverse of ``ntz_micros``."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (micros.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return epoch + F.make_dt_interval(secs=seconds)


def severity_rank(severity: Column) -> Column:
    # List order of the severities.
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)
