"""Trailing averages from stored day summaries, so that a run does not read the whole history.

A summary row holds count, sums and last values of an entity's day. New rows are summed by themselves and merged into
the parts of their days, a late row for an old day included; a run reads the days its rows look back
on: up to seven or thirty before the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.baselines import DAY, _daily, _history, baseline_name, day_of
from tidewatch.operators.conditions import BASELINES, column_of
from tidewatch.operators.skew import attach
from tidewatch.session import materialise
from tidewatch.streaming.tables import KeyedTable

SPAN = "__span"


class DayPartials:
    """Day summaries of ``fields`` by entity; ``order_by`` is the dataset's row order."""

    def __init__(self, spark: SparkSession, path: str, entity: list[str], time_field: str, fields: list[str], order_by: list[str], buckets: int = 4, days: int = 1) -> None:
        """A part of the table holds ``days`` days (or one bucket of entities of them)."""
        self.spark, self.entity, self.time_field, self.fields, self.order_by, self.days = spark, entity, time_field, fields, order_by, days
        self.table = KeyedTable(spark, path, [*entity, DAY], self._merged, buckets, by=[SPAN])

    def _span(self) -> Column:
        return F.floor(F.unix_date(DAY) / self.days).cast("int").alias(SPAN)

    def _merged(self, days: DataFrame) -> DataFrame:
        parts = [F.sum("__rows").alias("__rows"), F.max("__at").alias("__at")]
        for i in range(len(self.fields)):
            parts += [F.sum(c).alias(c) for c in (f"__sum{i}", f"__cnt{i}")]
            parts.append(F.max_by(f"__last{i}", "__at").alias(f"__last{i}"))
        return days.groupBy(*[F.col(f"`{e}`") for e in self.entity], DAY, SPAN).agg(*parts)

    def _dated(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(DAY, day_of(F.col(f"`{self.time_field}`"), rows.schema[self.time_field].dataType))

    def add(self, rows: DataFrame, batch_id: int) -> list[str] | None:
        """Merge new rows in; the parts rewritten, None for a batch added before. Undated rows have no day."""
        for f in self.fields:
            column_of(rows.schema, f)
        dated = self._dated(rows)
        last = F.struct(*[F.col(f"`{c}`") for c in self.order_by])
        keys = [F.col(f"`{e}`") for e in self.entity]
        ends = dated.filter(F.col(DAY).isNotNull()).groupBy(*keys, DAY).agg(F.max(last).alias("__at"))
        same = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"e.`{c}`")) for c in (*self.entity, DAY)]
        daily = _daily(dated, self.fields, self.entity, self.order_by).alias("d").join(ends.alias("e"), same).select("d.*", "e.__at").withColumn(SPAN, self._span())
        return self.table.merge(materialise(daily, "days"), batch_id)

    def history(self, days: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
        """Entity, day, number of rows and the wanted averages of the given days (column ``DAY``)."""
        reach = [BASELINES[b] for _, b in wanted]
        if None in reach:
            raise ValueError("the previous period may be any time ago; stored days serve averages over a fixed number of days")
        back = F.explode(F.sequence(F.date_sub(DAY, max(reach)), F.col(DAY))).alias(DAY)
        needed = days.select(DAY).filter(F.col(DAY).isNotNull()).distinct().select(back).select(self._span()).distinct()
        names = [baseline_name(f, b) for f, b in wanted]
        fields = list(dict.fromkeys(f for f, _ in wanted))
        numbered = {}
        for to, f in enumerate(fields):
            numbered |= {f"__{kind}{to}": F.col(f"__{kind}{self.fields.index(f)}") for kind in ("sum", "cnt", "last")}
        kept = [F.col(f"`{e}`") for e in self.entity]
        stored = self.table.within(needed).select(*kept, DAY, "__rows", *[c.alias(n) for n, c in numbered.items()])
        asked = _history(stored, wanted, self.entity).join(days.select(DAY).distinct(), DAY, "left_semi")
        return asked.select(*kept, DAY, "__rows", *names)

    def attach(self, rows: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
        """Add one ``baseline_name`` column per wanted (field, baseline) to rows that were added before."""
        dated = self._dated(rows)
        names = [baseline_name(f, b) for f, b in wanted]
        return attach(dated, self.history(dated, wanted), [*self.entity, DAY], "__rows", names, self.order_by).drop(DAY)
