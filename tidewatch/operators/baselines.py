"""Trailing baselines: the previous period and 7- or 30-day averages.

Rows are first folded to one row per entity and day (sum, count and last value),
which bounds an entity's history by the calendar; the trailing frames run over
that, and each row then looks its day's baseline up. No frame ever spans the raw
rows of an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.values import TIMELIKE
from tidewatch.operators.conditions import BASELINES, IncompatibleTypes, column_of
from tidewatch.operators.skew import attach

DAY = "__day"


def split_entity_and_time(schema: T.StructType, key_fields: list[str]) -> tuple[list[str], str]:
    """The one date/time key field, and the remaining key fields (the entity)."""
    times = [k for k in key_fields if k in schema.fieldNames() and isinstance(schema[k].dataType, TIMELIKE)]
    if len(times) != 1:
        raise ValueError("a baseline rule needs exactly one date or time field in its key")
    return [k for k in key_fields if k != times[0]], times[0]


def day_of(column: Column, data_type: T.DataType) -> Column:
    """Calendar day of a date, a time or ISO text; null for anything else."""
    if isinstance(data_type, TIMELIKE):
        return column.cast("date")
    if isinstance(data_type, T.StringType):
        iso = column.rlike(
            r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
        )
        return F.when(iso, F.substring(column, 1, 10).try_cast("date"))
    return F.lit(None).cast("date")


def baseline_name(field: str, baseline: str) -> str:
    return f"__base_{baseline}_{field}"


def attach_baselines(
    df: DataFrame, wanted: list[tuple[str, str]], entity: list[str], time_field: str, order_by: list[str]
) -> DataFrame:
    """Add one ``baseline_name`` column per wanted ``(field, baseline)``.

    ``order_by`` is the dataset's row order; among rows of the same day the last
    one by that order supplies the previous-period value, a null one included.
    """
    unknown = [b for _, b in wanted if b not in BASELINES]
    if unknown:
        raise ValueError(f"unsupported baseline: {unknown[0]}")
    fields = list(dict.fromkeys(f for f, _ in wanted))
    for f in fields:
        column_of(df.schema, f)
        if isinstance(df.schema[f].dataType, (*TIMELIKE, T.BooleanType)):
            raise IncompatibleTypes(f"cannot average {f}")
    dated = df.withColumn(DAY, day_of(F.col(f"`{time_field}`"), df.schema[time_field].dataType))
    names = [baseline_name(f, b) for f, b in wanted]
    daily = _daily(dated, fields, entity, order_by)
    history = _history(daily, wanted, entity).select(*[f"`{e}`" for e in entity], DAY, "__rows", *names)
    return attach(dated, history, [*entity, DAY], "__rows", names, order_by).drop(DAY)


def _daily(dated: DataFrame, fields: list[str], entity: list[str], order_by: list[str]) -> DataFrame:
    """One row per entity and day; undated rows never enter a history."""
    sequence = F.struct(*[F.col(f"`{c}`") for c in order_by])
    parts = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        number = F.col(f"`{f}`").cast("double")
        parts += [
            F.sum(number).alias(f"__sum{i}"),
            F.count(number).alias(f"__cnt{i}"),
            F.max_by(F.struct(number.alias("v")), sequence).alias(f"__last{i}"),
        ]
    return dated.filter(F.col(DAY).isNotNull()).groupBy(*[f"`{e}`" for e in entity], DAY).agg(*parts)


def _history(daily: DataFrame, wanted: list[tuple[str, str]], entity: list[str]) -> DataFrame:
    fields = list(dict.fromkeys(f for f, _ in wanted))
    daily = daily.withColumn("__d", F.unix_date(DAY))
    by_day = Window.partitionBy(*([f"`{e}`" for e in entity] or [F.lit(0)])).orderBy("__d")
    columns = []
    for f, baseline in wanted:
        i = fields.index(f)
        days = BASELINES[baseline]
        if days is None:
            value = F.lag(f"__last{i}").over(by_day)["v"]
        else:
            frame = by_day.rangeBetween(-days, -1)
            filled = F.sum(F.when(F.col(f"__cnt{i}") > 0, 1).otherwise(0)).over(frame)
            mean = F.sum(f"__sum{i}").over(frame) / F.sum(f"__cnt{i}").over(frame)
            value = F.when(filled >= days, mean)
        columns.append(value.alias(baseline_name(f, baseline)))
    return daily.select("*", *columns)
