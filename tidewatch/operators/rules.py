"""Rule documents and their evaluation over a dataset."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import all_of, any_of, canonical_json, fingerprint, json_columns
from tidewatch.operators.baselines import attach_baselines, baseline_name, split_entity_and_time
from tidewatch.operators.conditions import RATIOS, Condition, MissingField, column_of, compile_condition
from tidewatch.operators.day_partials import DayPartials

# Key names the repeat mode adds itself.
RESERVED_KEYS = ("__detected_at", "__occurrence_id")


@dataclass(frozen=True)
class Target:
    """A recipient: literal ``value`` or the row's ``field``."""

    source: str
    value: str | None = None
    field: str | None = None
    receive_id_type: str = "user_id"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    conditions: list[Condition]
    key_fields: list[str]
    name: str = ""
    dataset_name: str = ""
    logic: str = "AND"
    severity: str = "medium"
    description: str = ""
    deadline_seconds: int | None = None
    repeat_push_enabled: bool = False
    notification_targets: list[Target] = field(default_factory=list)
    validation_enabled: bool = False
    validation_method: str | None = None
    validation_targets: list[Target] = field(default_factory=list)
    sql_validation_config: dict = field(default_factory=dict)
    dataset_datasource_id: str | None = None
    private_message_template: str | None = None
    group_broadcast_enabled: bool = False
    group_webhook_url: str | None = None
    group_message_template: str | None = None
    group_mention_targets: list[Target] = field(default_factory=list)
    timeout_broadcast_enabled: bool = False
    timeout_message_template: str | None = None
    timeout_mention_targets: list[Target] = field(default_factory=list)

    def check(self, df: DataFrame) -> None:
        """Refuse a rule that cannot run on this dataset."""
        if not self.key_fields:
            raise ValueError("at least one key field is required")
        if not self.conditions:
            raise ValueError("at least one condition is required")
        if self.logic not in ("AND", "OR"):
            raise ValueError(f"unknown logic: {self.logic}")
        if self.repeat_push_enabled and set(RESERVED_KEYS) & set(self.key_fields):
            raise ValueError(f"key fields must not use the reserved names {', '.join(RESERVED_KEYS)}")
        for name in [*self.key_fields, *[c.field for c in self.conditions]]:
            column_of(df.schema, name)


def evaluate(df: DataFrame, rule: Rule, order_by: list[str], partials: DayPartials | None = None) -> DataFrame:
    """Rows that match a rule, with business key and evidence.

    Baselines come from the rows themselves or, with ``partials``, from stored days, which the rows are part of;
    ``df`` may then be the newest days only.

    Output: the dataset's columns plus ``business_key`` (canonical JSON),
    ``fingerprint``, ``row_details`` (JSON) and ``matched_conditions``.
    """
    rule.check(df)
    for name in order_by:
        if name not in df.columns:
            raise MissingField(f"order field does not exist: {name}")
    ratio_conditions = [c for c in rule.conditions if c.operator in RATIOS]
    source = df
    if ratio_conditions:
        entity, time_field = split_entity_and_time(df.schema, rule.key_fields)
        wanted = list(dict.fromkeys((c.field, c.baseline) for c in ratio_conditions))
        if partials is None:
            source = attach_baselines(df, wanted, entity, time_field, order_by)
        elif (partials.entity, partials.time_field) != (entity, time_field):
            raise ValueError(f"the stored days are those of {partials.entity} by {partials.time_field}")
        else:
            source = partials.attach(df, wanted)
    compiled = [
        compile_condition(
            c,
            df.schema,
            F.col(f"`{baseline_name(c.field, c.baseline)}`") if c.operator in RATIOS else None,
        )
        for c in rule.conditions
    ]
    combine = all_of if rule.logic == "AND" else any_of
    matched = source.filter(combine([c.predicate for c in compiled]))
    if rule.logic == "AND":
        evidence = F.array(*[c.evidence for c in compiled])
    else:
        evidence = F.filter(F.array(*[c.evidence for c in compiled]), lambda item: item["matched"])
    out = matched.select(
        *[F.col(f"`{c}`") for c in df.columns],
        canonical_json(df, rule.key_fields).alias("business_key"),
        json_columns(df).alias("row_details"),
        evidence.alias("matched_conditions"),
    )
    return out.withColumn("fingerprint", fingerprint(F.col("business_key")))


def run_summary(scanned: DataFrame, folded: DataFrame, new_records: DataFrame, rule: Rule, run_id: str) -> DataFrame:
    """The run's row: rows scanned, rows matched (from the folded matches), records new."""
    zero = F.lit(0).cast("bigint")
    counts = (
        scanned.agg(F.count(F.lit(1)).alias("scanned"), zero.alias("matched"), zero.alias("new"))
        .unionAll(folded.agg(zero, F.coalesce(F.sum("run_hits"), zero), zero))
        .unionAll(new_records.agg(zero, zero, F.count(F.lit(1))))
        .agg(F.sum("scanned").alias("scanned_rows"), F.sum("matched").alias("matched_rows"), F.sum("new").alias("new_anomalies"))
    )
    return counts.select(
        F.lit(run_id).alias("run_id"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit("success").alias("status"),
        "scanned_rows",
        "matched_rows",
        "new_anomalies",
        F.lit(None).cast("string").alias("error_message"),
    )


def failed_summary(spark, rule: Rule, run_id: str, error: Exception) -> DataFrame:
    """The run's row after a failure, with the error text cut to 2000 characters."""
    row = (run_id, rule.rule_id, "failed", 0, 0, 0, str(error)[:2000])
    schema = (
        "run_id string, rule_id string, status string, scanned_rows bigint, matched_rows bigint, "
        "new_anomalies bigint, error_message string"
    )
    return spark.createDataFrame([row], schema)
