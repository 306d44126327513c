"""Skew-safe building blocks: lookups, positions and previous rows.

Any key may hold a large share of all rows, so nothing here gathers one key's
rows in a single task. Lookups peel the few heavy keys off into a broadcast of
provable size; ordered operations cut each key into value ranges first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

# A key is heavy when it holds more than 1/HEAVY_SHARE of all rows, or more than
# an average shuffle partition when there are more of those; there are fewer
# heavy keys than that however large the data is.
HEAVY_SHARE = 1000

# Rows of a slice in ordered operations, and sampled order tuples per slice.
ROWS_PER_SLICE = 4_000_000
SAMPLE_PER_SLICE = 16


def _share(df: DataFrame) -> int:
    return max(HEAVY_SHARE, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _join_peeled(
    fact: DataFrame, heavy: DataFrame, light: DataFrame, keys: list[str], values: list[str], spread: list[str]
) -> DataFrame:
    """Left lookup: ``heavy`` keys (few) by broadcast, the rest in a shuffled join AQE plans.

    Rows of heavy keys get a spread-out key (a hash of the ``spread`` columns) that
    matches nothing there, so no task receives a heavy key's rows.
    """
    heavy = heavy.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("__hk"), F.struct(*values).alias("__hv"))
    light = light.select(
        F.struct(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"), F.lit(0).cast("long").alias("away")).alias("__lk"),
        F.struct(*values).alias("__lv"),
    )
    key = F.struct(*[F.col(f"`{k}`").alias(k) for k in keys])
    marked = fact.withColumn("__fk", key).join(F.broadcast(heavy), F.col("__fk") == F.col("__hk"), "left")
    away = 1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.lit(1 << 20))
    # key and spread value are compared as one struct: as two columns the constant
    # on the light side would be folded away and heavy rows would gather again
    away = F.when(F.col("__hk").isNotNull(), away).otherwise(F.lit(0).cast("long"))
    marked = marked.withColumn("__fs", F.struct(F.col("__fk").alias("key"), away.alias("away")))
    joined = marked.join(light, F.col("__fs") == F.col("__lk"), "left")
    found = F.coalesce(F.col("__hv"), F.col("__lv"))
    return joined.select(*[F.col(f"`{c}`") for c in fact.columns], *[found[v].alias(v) for v in values])


def attach(
    fact: DataFrame, facts_by_key: DataFrame, keys: list[str], weight: str, values: list[str], spread: list[str]
) -> DataFrame:
    """Left lookup of per-key values.

    Keys are compared as structs, in which nulls equal nulls. ``facts_by_key`` has
    one row per key with the number of fact rows in ``weight``. It is written once: the
    number of facts, the heavy keys and the join all come from it, so neither it
    nor the fact is computed again.
    """
    known = materialise(facts_by_key.select(*[F.col(f"`{k}`") for k in keys], weight, *values), "by-key")
    total = known.agg(F.sum(weight)).scalar()
    heavy = known.filter(F.col(weight) * _share(fact) > total)
    return _join_peeled(fact, heavy, known, keys, values, spread)


def lookup(fact: DataFrame, dim: DataFrame, keys: list[str], values: list[str], spread: list[str]) -> DataFrame:
    """Left lookup in ``dim`` (one row per key) for facts whose keys may be skewed.

    The fact's keys are counted first (a mergeable count over the key columns
    only) to peel the heavy ones off; only those are written out.
    """
    counted = fact.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__weight"))
    total = fact.agg(F.count(F.lit(1))).scalar()
    heavy = counted.filter(F.col("__weight") * _share(fact) > total).join(dim.select(*keys, *values), keys, "left")
    return _join_peeled(fact, materialise(heavy, "heavy"), dim, keys, values, spread)


def _cut_blocks(df: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """One row: ordered cut tuples of the slices, in blocks of about equal number.

    The number of slices follows the rows. Cuts come from a repeatable sample of the
    distinct order tuples (by hash), so a frequent tuple counts once, like any other.
    """
    key = F.struct(*[F.col(f"`{c}`").alias(c) for c in order])
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in order])
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(hashed).alias("tuples")).first()
    wanted = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(seen["rows"] / ROWS_PER_SLICE))
    one_in = max(1, seen["tuples"] // (wanted * SAMPLE_PER_SLICE))
    sample = df.filter(F.pmod(hashed, F.lit(one_in)) == 0).select(key.alias("cut")).distinct()
    row = sample.agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    step = F.greatest(F.lit(1), F.ceil(F.size("cuts") / wanted).cast("int"))
    row = row.withColumn("step", step)
    row = row.select(F.filter("cuts", lambda _, i: (i > 0) & (i % F.col("step") == 0)).alias("cuts"))
    row = row.withColumn("width", F.greatest(F.lit(1), F.floor(F.sqrt(F.size("cuts"))).cast("int")))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("cuts"), F.lit(1)), F.col("width")), lambda i: i <= F.size("cuts"))
    return materialise(row.select("width", F.transform(starts, lambda i: F.slice("cuts", i, F.col("width"))).alias("blocks")), "cuts")


def with_slices(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Add ``__slice``: the index of the value range the row's order tuple falls in.

    Slices follow the order, so an ordered operation may run inside each slice
    and be stitched together from one summary row per (key, slice). The slice is
    found in two short steps (coarse block, then position within it).
    """
    # as a column of its own: a subquery may not stand inside a lambda
    cut = df.withColumn("__cuts", _cut_blocks(df, order, parts).select(F.struct("width", "blocks")).scalar())
    blocks, width = F.col("__cuts.blocks"), F.col("__cuts.width")
    key = F.struct(*[F.col(f"`{c}`").alias(c) for c in order])
    coarse = F.size(F.filter(blocks, lambda block: block[0] <= key))
    inner = F.get(blocks, F.greatest(coarse, F.lit(1)) - 1)
    fine = F.coalesce(F.size(F.filter(inner, lambda c: c <= key)), F.lit(0))
    return cut.withColumn("__slice", F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine).cast("int")).drop("__cuts")


def _by_weight(df: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of light and of heavy keys; None where there are none. Without keys all rows are heavy."""
    if not keys:
        return None, df
    key = F.struct(*[F.col(f"`{k}`").alias(k) for k in keys])
    total = df.agg(F.count(F.lit(1))).scalar()
    heavy = df.groupBy(key.alias("__hk")).count().filter(F.col("count") * _share(df) > total).select("__hk")
    heavy = materialise(heavy, "heavy")
    if heavy.isEmpty():
        return df, None
    marked = df.withColumn("__wk", key)
    match = F.col("__wk") == F.col("__hk")
    light = marked.join(F.broadcast(heavy), match, "left_anti").drop("__wk")
    return light, marked.join(F.broadcast(heavy), match, "left_semi").drop("__wk")


def _keyed(sliced: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``__slot``: key columns and slice as one struct, in which nulls are equal.

    Windows, summaries and joins all use it, so the rows are shuffled once.
    """
    return sliced.withColumn("__slot", F.struct(*[F.col(f"`{k}`").alias(k) for k in keys], F.col("__slice")))


def _slices_of(keys: list[str]):
    """A key's slices in order."""
    return Window.partitionBy(*([F.col(f"__slot.`{k}`") for k in keys] or [F.lit(0)])).orderBy("__slot.__slice")


def running(
    df: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]], parts: int | None = None
) -> DataFrame:
    """Add prefix totals (the row included) per key, by ``order``.

    ``totals`` maps a column name to ``("sum" | "max", expression)``. Light keys take a
    plain frame. For heavy ones the frame runs inside (key, slice); what the earlier
    slices contribute comes from one summary row per (key, slice).
    """
    light, heavy = _by_weight(materialise(df, "rows"), keys)
    done = []
    if light is not None:
        frame = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        folds = {"sum": F.sum, "max": F.max}
        done.append(light.select("*", *[folds[kind](expression).over(frame).alias(name) for name, (kind, expression) in totals.items()]))
    if heavy is not None:
        done.append(_running_sliced(heavy, keys, order, totals, parts))
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def _running_sliced(
    df: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]], parts: int | None
) -> DataFrame:
    fold = {"sum": F.sum, "max": F.max}
    combine = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}
    kinds = [kind for kind, _ in totals.values()]
    sliced = _keyed(with_slices(df, order, parts), keys)
    for i, (_, expression) in enumerate(totals.values()):
        sliced = sliced.withColumn(f"__x{i}", expression)
    inside = Window.partitionBy("__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = _slices_of(keys).rowsBetween(Window.unboundedPreceding, -1)
    summary = sliced.groupBy("__slot").agg(*[fold[kind](f"__x{i}").alias(f"__t{i}") for i, kind in enumerate(kinds)])
    carried = summary.select(
        F.col("__slot").alias("__ck"), *[fold[kind](f"__t{i}").over(before).alias(f"__c{i}") for i, kind in enumerate(kinds)]
    )
    local = sliced
    for i, kind in enumerate(kinds):
        local = local.withColumn(f"__l{i}", fold[kind](f"__x{i}").over(inside))
    joined = local.join(carried, F.col("__slot") == F.col("__ck"))
    results = [
        combine[kind](F.col(f"__l{i}"), F.col(f"__c{i}")).alias(name) for i, (name, kind) in enumerate(zip(totals, kinds))
    ]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *results)


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "position", parts: int | None = None) -> DataFrame:
    """Zero-based position of each row within its key, by ``order``."""
    counted = running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, parts)
    return counted.withColumn(name, F.col(f"`{name}`") - 1)


def previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str = "prev_", parts: int | None = None) -> DataFrame:
    """Each row with the ``values`` of the row before it within its key.

    The input is written once. Light keys take a plain ``lag``; for heavy ones the
    first row of a (key, slice) takes its predecessor from the last row of the key's
    nearest earlier slice. ``has_prev`` tells a missing predecessor from one whose
    values are null.
    """
    light, heavy = _by_weight(materialise(df, "rows"), keys)
    done = []
    if light is not None:
        carried = F.struct(*[F.col(f"`{v}`").alias(v) for v in values])
        found = light.withColumn("__prev", F.lag(carried).over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)))
        done.append(found.select(
            *[F.col(f"`{c}`") for c in df.columns], *[F.col("__prev")[v].alias(f"{prefix}{v}") for v in values],
            F.col("__prev").isNotNull().alias("has_prev"),
        ))
    if heavy is not None:
        done.append(_previous_sliced(heavy, keys, order, values, prefix, parts))
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def _previous_sliced(df: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str, parts: int | None) -> DataFrame:
    sliced = _keyed(with_slices(df, order, parts), keys)
    carried = F.struct(*[F.col(f"`{v}`").alias(v) for v in values])
    inside = Window.partitionBy("__slot").orderBy(*order)
    last = sliced.groupBy("__slot").agg(
        F.max_by(carried, F.struct(*[F.col(f"`{c}`") for c in order])).alias("__last")
    )
    last = last.select(F.col("__slot").alias("__ck"), F.lag("__last").over(_slices_of(keys)).alias("__carry"))
    joined = sliced.withColumn("__prev", F.lag(carried).over(inside)).join(last, F.col("__slot") == F.col("__ck"))
    found = F.coalesce(F.col("__prev"), F.col("__carry"))
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[found[v].alias(f"{prefix}{v}") for v in values],
        found.isNotNull().alias("has_prev"),
    )
