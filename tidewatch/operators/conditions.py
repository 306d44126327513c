"""Rule conditions compiled to Column expressions.

A condition becomes two expressions: ``predicate``, plain SQL three-valued logic
that Catalyst can push into the scan, and ``passed``, the same test made strictly
two-valued for the evidence. Both select the same rows, because conditions are
combined with AND/OR only and never negated.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.values import FLOATING, INTEGRAL, NUMERIC, json_safe

# Operator and baseline names of a condition.
COMPARISONS = ("gt", "gte", "lt", "lte", "eq", "neq")
NULL_TESTS = ("is_null", "is_not_null")
RATIOS = ("gt_threshold_ratio", "lt_threshold_ratio")
OPERATORS = (*COMPARISONS, "between", *NULL_TESTS, *RATIOS)
BASELINES = {"prev_period": None, "7d_avg": 7, "30d_avg": 30}

_EXACT_DOUBLE = 2**53


class MissingField(ValueError):
    """A condition names a column the dataset does not have."""


class IncompatibleTypes(ValueError):
    """The two sides of a comparison can never be compared."""


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object = None
    upper_value: object = None
    value_source: str = "literal"
    value_field: str | None = None
    upper_value_source: str = "literal"
    upper_value_field: str | None = None
    baseline: str | None = None

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unsupported operator: {self.operator}")
        for side in self.sides:
            if getattr(self, f"{side}_source") == "field" and not getattr(self, f"{side}_field"):
                raise ValueError("a field comparison needs a target field")
        if self.operator in RATIOS and self.baseline not in BASELINES:
            raise ValueError("a ratio condition needs a baseline")

    @property
    def sides(self) -> tuple[str, ...]:
        if self.operator in NULL_TESTS:
            return ()
        return ("value", "upper_value") if self.operator == "between" else ("value",)


@dataclass(frozen=True)
class Compiled:
    predicate: Column
    passed: Column
    evidence: Column


@dataclass(frozen=True)
class _Operand:
    column: Column
    floating: bool
    shown: Column


def column_of(schema: T.StructType, name: str | None) -> Column:
    if not name or name not in schema.fieldNames():
        raise MissingField(f"comparison field does not exist: {name or '-'}")
    return F.col(f"`{name}`")


def _family(data_type: T.DataType) -> str:
    if isinstance(data_type, NUMERIC):
        return "number"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return data_type.typeName()


def _literal_family(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return "number"
    if isinstance(value, datetime):
        return "datetime"
    if isinstance(value, date):
        return "date"
    return "string"


def _number_text(text: Column) -> Column:
    """Text as a number; text that is no number fails the run."""
    number = text.try_cast("double")
    bad = text.isNotNull() & number.isNull()
    return F.when(bad, F.raise_error(F.lit("incompatible comparison value")).cast("double")).otherwise(number)


def _number_literal(value: object, actual_type: T.DataType) -> _Operand:
    try:
        number = value if isinstance(value, int) else float(value)
    except (TypeError, ValueError) as error:
        raise IncompatibleTypes(f"incompatible comparison value: {value!r}") from error
    if (
        isinstance(number, float)
        and isinstance(actual_type, INTEGRAL)
        and number.is_integer()
        and abs(number) <= _EXACT_DOUBLE
    ):
        number = int(number)  # keeps the column bare, so the filter reaches the scan
    if isinstance(number, float) or not isinstance(actual_type, INTEGRAL):
        number = float(number)
    column = F.lit(number)
    return _Operand(column, isinstance(number, float) and number != number, column.cast("string"))


def _comparable(column: Column, data_type: T.DataType) -> Column:
    return column.cast("double") if isinstance(data_type, T.DecimalType) else column


def _operand(condition: Condition, side: str, actual: Column, actual_type: T.DataType, schema: T.StructType) -> _Operand:
    numeric = _family(actual_type) == "number"
    if getattr(condition, f"{side}_source") == "field":
        name = getattr(condition, f"{side}_field")
        column = column_of(schema, name)
        data_type = schema[name].dataType
        shown = json_safe(column, data_type).cast("string")
        if numeric and _family(data_type) == "string":
            guarded = F.when(actual.isNotNull(), column)
            return _Operand(_number_text(guarded), True, shown)
        if _family(data_type) != _family(actual_type):
            raise IncompatibleTypes(f"cannot compare {condition.field} with {name}")
        return _Operand(_comparable(column, data_type), isinstance(data_type, FLOATING), shown)
    value = getattr(condition, side)
    if value is None:
        return _Operand(F.lit(None).cast(actual_type), False, F.lit(None).cast("string"))
    if numeric and _literal_family(value) in ("number", "string"):
        return _number_literal(value, actual_type)
    if _literal_family(value) != _family(actual_type):
        raise IncompatibleTypes(f"cannot compare {condition.field} with {value!r}")
    return _Operand(F.lit(value), False, F.lit(str(value)))


def _not_nan(operands: list[_Operand]) -> list[Column]:
    return [~F.isnan(o.column) for o in operands if o.floating]


def _compare(operator: str, actual: _Operand, value: _Operand, upper: _Operand | None) -> Column:
    """The bare test, with NaN never equal to or ordered against anything."""
    a, v = actual.column, value.column
    if operator == "neq":
        nan = [F.isnan(o.column) for o in (actual, value) if o.floating]
        test = a != v
        for extra in nan:
            test = test | extra
        return test & a.isNotNull() & v.isNotNull() if nan else test
    if operator == "between":
        test = (a >= v) & (a <= upper.column)
    else:
        test = {"gt": a > v, "gte": a >= v, "lt": a < v, "lte": a <= v, "eq": a == v}[operator]
    for guard in _not_nan([actual, value] + ([upper] if upper else [])):
        test = test & guard
    return test


def compile_condition(condition: Condition, schema: T.StructType, baseline: Column | None = None) -> Compiled:
    """Compile one condition against a schema; type and name errors surface here."""
    raw = column_of(schema, condition.field)
    actual_type = schema[condition.field].dataType
    actual = _Operand(_comparable(raw, actual_type), isinstance(actual_type, FLOATING), raw)
    resolved = {side: None for side in ("value", "upper_value")}
    if condition.operator == "is_null":
        predicate = raw.isNull()
    elif condition.operator == "is_not_null":
        predicate = raw.isNotNull()
    elif condition.operator in RATIOS:
        if baseline is None:
            raise ValueError("a ratio condition needs its baseline column")
        predicate, resolved["value"] = _ratio(condition, actual, actual_type, schema, baseline)
    else:
        for side in condition.sides:
            resolved[side] = _operand(condition, side, raw, actual_type, schema)
        predicate = _compare(condition.operator, actual, resolved["value"], resolved["upper_value"])
    passed = F.coalesce(predicate, F.lit(False))
    evidence = _evidence(condition, raw, actual_type, resolved, baseline, passed)
    return Compiled(predicate, passed, evidence)


def _ratio(condition, actual, actual_type, schema, baseline) -> tuple[Column, _Operand]:
    """Actual against baseline times ratio; any missing part means no match."""
    if _family(actual_type) not in ("number", "string"):
        raise IncompatibleTypes(f"cannot compare {condition.field} with a baseline")
    number = actual.column if _family(actual_type) == "number" else _number_text(actual.column)
    as_number = T.StructType(
        [f if f.name != condition.field else T.StructField(f.name, T.DoubleType()) for f in schema.fields]
    )
    ratio = _operand(condition, "value", F.when(baseline.isNotNull(), actual.column), T.DoubleType(), as_number)
    number = number.cast("double")
    bound = baseline * ratio.column
    test = number > bound if condition.operator.startswith("gt_") else number < bound
    return test & ~F.isnan(number) & ~F.isnan(bound), ratio


def _text(value: object) -> Column:
    return F.lit(None if value is None else str(value)).cast("string")


def _evidence(condition, raw, actual_type, resolved, baseline, passed) -> Column:
    """What the condition saw, as a struct of uniform type for every condition."""
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(condition.field).alias("field"),
        F.lit(condition.operator).alias("operator"),
        _text(condition.value).alias("value"),
        _text(condition.upper_value).alias("upper_value"),
        F.lit(condition.value_source).alias("value_source"),
        _text(condition.value_field).alias("value_field"),
        F.lit(condition.upper_value_source).alias("upper_value_source"),
        _text(condition.upper_value_field).alias("upper_value_field"),
        _text(condition.baseline).alias("baseline"),
        (resolved["value"].shown if resolved["value"] else null).alias("resolved_value"),
        (resolved["upper_value"].shown if resolved["upper_value"] else null).alias("resolved_upper_value"),
        json_safe(raw, actual_type).cast("string").alias("actual"),
        (baseline if baseline is not None else F.lit(None).cast("double")).alias("baseline_value"),
        passed.alias("matched"),
    )
