"""Bulk re-check of open anomalies against a check query.

One job instead of one query per anomaly: the check rows are folded per
parameter tuple first, the condition is evaluated once per tuple, and every
anomaly looks its tuple's verdict up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.values import NUMERIC, json_safe
from tidewatch.operators.anomalies import events, moment
from tidewatch.operators.conditions import Condition, IncompatibleTypes, MissingField, compile_condition
from tidewatch.operators.lifecycle import apply_updates, literal_json
from tidewatch.operators.skew import attach


def check_parameters(parameters: dict[str, str], check: DataFrame, dataset_fields: list[str]) -> None:
    """Every check parameter must map to a dataset field, and be a check column."""
    if not parameters:
        raise ValueError("a check needs at least one parameter")
    for name, field in parameters.items():
        if name not in check.columns:
            raise ValueError(f"check query has no parameter column {name}")
        if field not in dataset_fields:
            raise ValueError(f"parameter {name} maps to an unknown dataset field: {field}")


def _tolerant(check: DataFrame, condition: Condition) -> tuple[DataFrame, object]:
    """Operand text columns as numbers, plus the test for text that is none."""
    if condition.field not in check.columns or not isinstance(check.schema[condition.field].dataType, NUMERIC):
        return check, F.lit(False)
    bad = F.lit(False)
    for side in condition.sides:
        name = getattr(condition, f"{side}_field")
        if getattr(condition, f"{side}_source") != "field" or name not in check.columns:
            continue
        if isinstance(check.schema[name].dataType, T.StringType):
            number = F.col(f"`{name}`").try_cast("double")
            bad = bad | (F.col(f"`{condition.field}`").isNotNull() & F.col(f"`{name}`").isNotNull() & number.isNull())
            check = check.withColumn(f"__num_{side}", number)
    return check, bad


def _verdicts(check: DataFrame, parameters: list[str], condition: Condition) -> DataFrame:
    """One row per parameter tuple with its reason and the checked value."""
    row = F.struct(*[F.col(f"`{c}`") for c in check.columns])
    folded = check.groupBy(*[F.col(f"`{p}`").alias(f"__p{i}") for i, p in enumerate(parameters)]).agg(
        F.count(F.lit(1)).alias("__rows"), F.first(row).alias("__row")
    )
    keys = [f"__p{i}" for i in range(len(parameters))]
    single = folded.select(*keys, "__rows", "__row.*")
    single, bad = _tolerant(single, condition)
    schema = T.StructType([f for f in single.schema.fields if f.name not in keys])
    swapped = condition
    for side in condition.sides:
        if f"__num_{side}" in single.columns:
            swapped = Condition(**{**swapped.__dict__, f"{side}_field": f"__num_{side}"})
    actual = F.lit(None).cast("string")
    if condition.field in check.columns:
        actual = json_safe(F.col(f"`{condition.field}`"), check.schema[condition.field].dataType).cast("string")
    try:
        compiled = compile_condition(swapped, schema)
        reason = F.when(bad, "invalid_comparison").when(compiled.passed, "condition_passed").otherwise("condition_failed")
    except MissingField:
        reason = F.lit("missing_field")
    except IncompatibleTypes:
        reason = F.lit("invalid_comparison")
    reason = F.when(F.col("__rows") > 1, "multiple_rows").otherwise(reason)
    return single.select(*keys, reason.alias("reason"), F.when(F.col("__rows") == 1, actual).alias("actual"))


def recheck(
    anomalies: DataFrame, check: DataFrame, parameters: dict[str, str], condition: Condition, id_column: str = "id"
) -> DataFrame:
    """Add ``reason``, ``passed`` and ``actual`` to each anomaly.

    ``parameters`` maps check columns to the anomalies' row fields; they are
    compared as values of the check column's type. Exactly one check row must
    exist; field operands come from the check row.
    """
    check_parameters(parameters, check, anomalies.columns)
    names = list(parameters)
    verdicts = _verdicts(check, names, condition)
    keyed = anomalies
    keys = []
    for i, (name, field) in enumerate(parameters.items()):
        keyed = keyed.withColumn(f"__p{i}", F.col(f"`{field}`").cast(check.schema[name].dataType))
        keys.append(f"__p{i}")
    wanted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    looked_up = wanted.join(verdicts, keys, "left")
    joined = attach(keyed, looked_up, keys, "__n", ["reason", "actual"], [id_column])
    return joined.select(
        *[F.col(f"`{c}`") for c in anomalies.columns],
        F.coalesce("reason", F.lit("no_rows")).alias("reason"),
        (F.col("reason") == "condition_passed").alias("__passed"),
        "actual",
    ).withColumn("passed", F.coalesce("__passed", F.lit(False))).drop("__passed")


def store_results(records: DataFrame, results: DataFrame, condition: Condition, user_id: str, now) -> DataFrame:
    """Records with the last result and its version; a pass also resolves.

    ``results``: ``id``, ``reason``, ``passed``, ``actual``.
    """
    at = moment(now)
    document = F.to_json(
        F.struct(
            F.when(F.col("passed"), "passed").otherwise("failed").alias("outcome"),
            "reason",
            literal_json({k: v for k, v in condition.__dict__.items() if v is not None}).alias("condition"),
            "actual",
            F.lit(user_id).alias("operator_user_id"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("checked_at"),
        )
    )
    version = results.join(records.select("id", "validation_result_version", "status", "active_fingerprint", "resolved_at", "resolution_source", "resolved_by_user_id"), "id")
    updates = version.select(
        "id",
        document.alias("set_last_sql_validation_result"),
        (F.coalesce("validation_result_version", F.lit(0)) + 1).alias("set_validation_result_version"),
        F.when(F.col("passed"), "resolved").otherwise(F.col("status")).alias("set_status"),
        F.when(F.col("passed"), at).otherwise(F.col("resolved_at")).alias("set_resolved_at"),
        F.when(~F.col("passed"), F.col("active_fingerprint")).alias("set_active_fingerprint"),
        F.when(F.col("passed"), "validation").otherwise(F.col("resolution_source")).alias("set_resolution_source"),
        F.when(F.col("passed"), F.lit(user_id)).otherwise(F.col("resolved_by_user_id")).alias("set_resolved_by_user_id"),
    )
    return apply_updates(records, updates)


def result_events(results: DataFrame, condition: Condition, user_id: str, now) -> DataFrame:
    """A timeline row per result: resolved on a pass, a failure note otherwise."""
    expected = condition.value if condition.value_source == "literal" else condition.value_field
    failure = (
        F.when(F.col("reason") == "no_rows", "SQL 校验未通过：查询未返回数据")
        .when(F.col("reason") == "multiple_rows", "SQL 校验未通过：查询返回多行")
        .when(F.col("reason") == "missing_field", f"SQL 校验未通过：结果缺少字段 {condition.field}")
        .when(F.col("reason") == "invalid_comparison", "比较值类型不兼容")
        .otherwise(
            F.concat(
                F.lit(f"SQL 校验未通过：{condition.field} 实际值 "),
                F.coalesce("actual", F.lit("None")),
                F.lit(f"，期望 {condition.operator} {expected}"),
            )
        )
    )
    passed = results.filter("passed")
    failed = results.filter(~F.col("passed"))
    return events(passed, "validation_resolved", f"处理人 {user_id} 通过 SQL 校验并解决异常", now).unionByName(
        events(failed, "sql_validation_failed", failure, now)
    )
