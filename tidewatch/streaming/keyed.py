"""Change streams with one small state per key, kept in RocksDB.

``checked_changes`` keeps each key's last log position and current row. A delivery that is not
after the key's last position is a repeat and goes no further; a change whose before image is not the current
row is marked. State has one entry per live key, and one per deleted key until the
retention has passed, however often a key changes.

``zero_filled_windows`` keeps each shop's panes and an event-time timer, and emits every window at its end, with
zeros where the shop had nothing in it.

Rows pass through as text, as they came from the log; only keys, positions and images are looked into.
A key's rows of one micro-batch are ordered in one task, so bound the batches (files or offsets per trigger).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewatch.sources.changelog import ORDER_ROW, SOURCE_ROW
from tidewatch.streaming.windows import LATENESS_MS, LENGTH_MS, SLIDE_MS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a long-running stream remembers a deleted key's position, in milliseconds.
RETENTION_MS = 7 * 86_400_000
#: Packs of state for streams of many keys, and packs that one call in Python serves; fixed for the life of a checkpoint.
PACKS, LANE_PACKS = 16_384, 16
#: Panes of a block of stored windows, and rows a task holds before it sums them by pane.
PANES, FOLD_ROWS = 720, 500_000
#: Fixed value: what is said of a change that does not fit the current row.
MISMATCH = "before image does not match the current row"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, as state by key needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _position(source: Column) -> Column:
    """Log position as text that sorts like it: the file's number and name, position, row; null where it is not known."""
    number = F.lpad(F.regexp_extract(source["file"], "([0-9]*)$", 1), 20, "0")
    name = F.regexp_replace(source["file"], "[0-9]+$", "")
    return F.concat(name, F.lit(":"), number, F.lit(":"), F.lpad(source["pos"].cast("string"), 20, "0"), F.lit(":"), F.lpad(source["row"].cast("string"), 10, "0"))


class _Changes(StatefulProcessor):
    """State of a key: server, position and row of its last change; of a deleted one only the first two, for a while."""

    def __init__(self, retention_ms: int | None, with_rows: bool) -> None:
        self.retention_ms, self.with_rows = retention_ms, with_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "server string, position string, row string")
        self.gone = handle.getValueState("gone", "server string, position string", ttlDurationMs=self.retention_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.live.get()
        gone = None if known else self.gone.get()
        server, position = (known or gone or (None, None))[:2]
        live, current = (True, known[2]) if known else (False, None)
        for row in sorted(rows, key=lambda r: (r["partition"], r["offset"])):
            on, at = row["server"], row["position"]
            # positions of one server's log only grow; those of another cannot be compared
            if at is not None and position is not None and on == server and at <= position:
                continue
            wrong = self.with_rows and row["op"] in ("u", "d") and row["before"] != current
            yield Row(value=row["value"], partition=row["partition"], offset=row["offset"], timestamp=row["timestamp"], problem=MISMATCH if wrong else None)
            if at is not None:
                server, position = on, at
            live = row["op"] != "d"
            current = row["after"] if live and self.with_rows else None
        if live:
            self.live.update((server, position, current))
            if gone:
                self.gone.clear()
        else:
            if known:
                self.live.clear()
            self.gone.update((server, position))

    def close(self) -> None:
        pass


def _texts(column: pd.Series) -> list[str | None]:
    return [x if isinstance(x, str) else None for x in column.tolist()]


class _PackedChanges(StatefulProcessor):
    """State of a lane, by pack: JSON lists of key, server, position, digest of the row, and when a deleted key went (else null)."""

    def __init__(self, retention_ms: int | None, with_rows: bool) -> None:
        self.retention_ms, self.with_rows = retention_ms, with_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packs = handle.getMapState("packs", "pack int", "entries string")

    def _entries(self, text: str, now: int) -> dict:
        """Entries by key, without deleted ones whose retention has passed."""
        held = {k: (server, position, row, gone) for k, server, position, row, gone in json.loads(text)}
        if self.retention_ms is None:
            return held
        return {k: e for k, e in held.items() if e[3] is None or e[3] + self.retention_ms > now}

    def _load(self, pack: int, now: int) -> dict:
        return self._entries(self.packs.getValue((pack,))[0], now) if self.packs.containsKey((pack,)) else {}

    def _store(self, packs: dict[int, dict]) -> None:
        for pack, entries in packs.items():
            if entries:
                text = json.dumps([(k, *e) for k, e in entries.items()], ensure_ascii=False, separators=(",", ":"))
                self.packs.updateValue((pack,), (text,))
            else:
                self.packs.removeKey((pack,))
        if self.retention_ms is not None:
            ends = [e[3] + self.retention_ms for entries in packs.values() for e in entries.values() if e[3] is not None]
            if ends and not any(t <= min(ends) for t in self.handle.listTimers()):
                self.handle.registerTimer(min(ends))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.retention_ms is None else timerValues.getCurrentProcessingTimeInMs()
        seen = pd.concat(list(rows), ignore_index=True)
        seen = seen.iloc[np.lexsort((seen["offset"].to_numpy(), seen["partition"].to_numpy()))]
        images = (_texts(seen["before"]), _texts(seen["after"])) if self.with_rows else ([None] * len(seen),) * 2
        changes = zip(seen["pack"].tolist(), _texts(seen["key"]), _texts(seen["op"]), _texts(seen["server"]), _texts(seen["position"]), *images, strict=True)
        packs, kept, problems = {}, [], []
        for i, (pack, k, op, on, at, before, after) in enumerate(changes):
            found = packs.get(pack)
            if found is None:
                found = packs[pack] = self._load(pack, now)
            server, position, current, _ = found.get(k, (None, None, None, None))
            if at is not None and position is not None and on == server and at <= position:
                continue
            kept.append(i)
            problems.append(MISMATCH if self.with_rows and op in ("u", "d") and before != current else None)
            if at is not None:
                server, position = on, at
            found[k] = (server, position, None, now) if op == "d" else (server, position, after, None)
        self._store(packs)
        out = seen.iloc[kept][["value", "partition", "offset", "micros"]]
        yield out.assign(problem=pd.Series(problems, index=out.index, dtype=object))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = [(k[0], v[0]) for k, v in self.packs.iterator()]
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        self._store({pack: self._entries(text, now) for pack, text in held})
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def checked_changes(
    raw: DataFrame, key: str, row_type: str = ORDER_ROW, retention_ms: int | None = None, with_rows: bool = True, packs: int | None = None
) -> DataFrame:
    """Raw records (value, partition, offset, timestamp) without repeats, each with ``problem`` or null.

    ``problem`` tells a change whose before image is not the key's current row; that row is the after
    image of the change before, wrong or not. ``with_rows`` False keeps positions only and checks nothing.
    Records of a key must come in one partition, as a log keyed by it has them. A change without a
    position is never a repeat. With ``retention_ms`` a deleted key is forgotten that long after its last change, by the
    clock; such a stream looks at the clock in batches without data too, so it runs on an interval and
    does not end by itself. With ``packs`` state is kept in so many packs by a hash of the key, for streams of
    many keys: a pack of a few thousand keys is read and stored once a batch, in place of several calls per key.
    """
    event = F.from_json("value", f"op string, before {row_type}, after {row_type}, source {SOURCE_ROW}", {"mode": "FAILFAST"})
    parsed = raw.filter(F.col("value").isNotNull()).withColumn("event", F.explode(F.array(event)))
    # both images as text of the same type, so that equal rows are equal text
    images = [F.to_json(F.col(f"event.{side}")) for side in ("before", "after")]
    marked = parsed.select(
        F.coalesce(F.col(f"event.after.{key}"), F.col(f"event.before.{key}")).cast("string").alias("key"), F.col("event.op").alias("op"),
        F.col("event.source.server_id").cast("string").alias("server"), _position(F.col("event.source")).alias("position"),
        *[(image if with_rows else F.lit(None).cast("string")).alias(side) for image, side in zip(images, ("before", "after"), strict=True)],
        "value", "partition", "offset", "timestamp",
    )
    time = "None" if retention_ms is None else "ProcessingTime"
    if packs is None:
        return marked.groupBy("key").transformWithState(
            statefulProcessor=_Changes(retention_ms, with_rows),
            outputStructType="value string, partition int, offset bigint, timestamp timestamp, problem string",
            outputMode="Append", timeMode=time,
        )
    digests = [F.sha2(F.col(side), 256).alias(side) for side in ("before", "after")] if with_rows else []
    pack = F.pmod(F.xxhash64("key"), F.lit(packs)).cast("int")
    packed = marked.select(
        F.floor(pack / LANE_PACKS).cast("int").alias("lane"), pack.alias("pack"), "key", "op", "server", "position", *digests,
        "value", "partition", "offset", F.unix_micros("timestamp").alias("micros"),
    )
    done = packed.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=_PackedChanges(retention_ms, with_rows),
        outputStructType="value string, partition int, offset bigint, micros bigint, problem string",
        outputMode="Append", timeMode=time,
    )
    return done.select("value", "partition", "offset", F.timestamp_micros("micros").alias("timestamp"), "problem")


def _pane_sums(shop: str, slide_ms: int):
    """Sums of a task's rows by shop and pane; ``until`` is that of the newest row."""
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fold(parts: list[pd.DataFrame]) -> pd.DataFrame:
            return pd.concat(parts).groupby([shop, "pane"], dropna=False, as_index=False).agg({"until_us": "max", "sign": "sum", "cents": "sum"})

        held, rows = [], 0
        for frame in frames:
            held.append(frame.assign(pane=frame["millis"] // slide_ms * slide_ms)[[shop, "pane", "until_us", "sign", "cents"]])
            rows += len(frame)
            if rows > FOLD_ROWS:
                held = [fold(held)]
                rows = 0
        if held:
            yield fold(held)

    return sums


class _Windows(StatefulProcessor):
    """State of a shop: count and cents by pane, kept by block of time, and the end of the last window emitted."""

    def __init__(self, shop: str, length_ms: int, slide_ms: int) -> None:
        self.shop, self.length_ms, self.slide_ms = shop, length_ms, slide_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block bigint", "panes string")
        self.emitted = handle.getValueState("emitted", "upto bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, at: int) -> None:
        """One timer per shop: at the next end of a window."""
        if self.timer.exists():
            before = self.timer.get()[0]
            if before == at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A known shop has windows before its first order."""
        start = int(initialState["from_ms"].iloc[0])
        self.emitted.update((start,))
        self._wake(start + self.slide_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        seen = pd.concat(list(rows))
        sums = seen.groupby("pane")[["sign", "cents"]].sum()
        sums = sums[sums.index + self.length_ms > closed]  # else its last window is out
        first = int(sums.index[0]) if len(sums) else None
        for block, part in sums.groupby(sums.index // (PANES * self.slide_ms)):
            held = self._panes(self.blocks.getValue((int(block),))[0]) if self.blocks.containsKey((int(block),)) else {}
            for at, n, cents in zip(part.index.tolist(), part["sign"].tolist(), part["cents"].tolist(), strict=True):
                old = held.get(at, (0, 0))
                held[at] = (old[0] + n, old[1] + cents)
            self._keep(int(block), held)
        if first is not None and not self.emitted.exists():
            self.emitted.update((max(first, closed // self.slide_ms * self.slide_ms),))
        if self.emitted.exists():
            self._wake(self.emitted.get()[0] + self.slide_ms)
        yield pd.DataFrame()

    @staticmethod
    def _panes(text: str) -> dict[int, tuple[int, int]]:
        return {at: (n, cents) for at, n, cents in json.loads(text)}

    def _keep(self, block: int, panes: dict[int, tuple[int, int]]) -> None:
        if panes:
            self.blocks.updateValue((block,), (json.dumps([(at, *sums) for at, sums in panes.items()], separators=(",", ":")),))
        else:
            self.blocks.removeKey((block,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        closed = timerValues.getCurrentWatermarkInMs() // self.slide_ms * self.slide_ms
        upto = self.emitted.get()[0]
        blocks = {k[0]: self._panes(v[0]) for k, v in self.blocks.iterator()}
        held = sorted((at, *sums) for panes in blocks.values() for at, sums in panes.items())
        at, n, cents = (np.array([h[i] for h in held], dtype=np.int64) for i in range(3))
        n, cents = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(cents)])
        # a long pause is emitted in steps
        for low in range(upto + self.slide_ms, closed + 1, self.slide_ms * 65_536):
            ends = np.arange(low, min(low + self.slide_ms * 65_536, closed + 1), self.slide_ms, dtype=np.int64)
            first, last = np.searchsorted(at, ends - self.length_ms), np.searchsorted(at, ends)
            yield pd.DataFrame({
                self.shop: key[0], "window_start_ms": ends - self.length_ms, "window_end_ms": ends,
                "order_count": n[last] - n[first], "cents": cents[last] - cents[first],
            })
        for block, panes in blocks.items():
            left = {p: sums for p, sums in panes.items() if p + self.length_ms > closed}
            if len(left) < len(panes):
                self._keep(block, left)
        self.emitted.update((max(closed, upto),))
        self._wake(max(closed, upto) + self.slide_ms)

    def close(self) -> None:
        pass


def zero_filled_windows(
    deltas: DataFrame, shops: DataFrame, from_ms: int, shop: str = "shop_id", amount: str = "amount", time: str = "event_time",
    length_ms: int = LENGTH_MS, slide_ms: int = SLIDE_MS, lateness_ms: int = LATENESS_MS,
) -> DataFrame:
    """Every window of every shop from ``from_ms`` on, once, when the watermark passes its end; zeros where nothing was.

    ``shops`` (known before the stream starts) have their timers from the start; a shop that first appears in the
    stream joins with its first order. Rows that only closed windows would hold are dropped.
    """
    # rows are late once their last window is closed, so that is the time the watermark is compared with; it trails
    # the newest row itself by the lateness
    length = F.make_dt_interval(secs=F.lit(length_ms / 1000).cast("decimal(18,6)"))
    signed = deltas.select(
        F.col(shop).alias(shop), F.unix_millis(F.col(time)).alias("millis"), F.unix_micros(F.col(time) + length).alias("until_us"), F.col("sign").cast("bigint").alias("sign"),
        F.coalesce((F.col("sign") * F.col(amount).cast("decimal(18,2)") * 100).cast("bigint"), F.lit(0)).alias("cents"),
    ).filter(F.col("millis").isNotNull())
    # a batch's rows are summed by pane in many tasks, so that a shop's own task gets a row per pane
    kind = StructType([deltas.schema[shop]])
    column = f"{kind.fields[0].name} {kind.fields[0].dataType.simpleString()}"
    panes = signed.repartition(shop, F.floor(F.col("millis") / (PANES * slide_ms))).mapInPandas(
        _pane_sums(shop, slide_ms), f"{column}, pane bigint, until_us bigint, sign bigint, cents bigint"
    )
    # a pane's newest row stands for it: one that is late has only closed windows, and so have the pane's others
    panes = panes.select(shop, "pane", F.timestamp_micros("until_us").alias("until"), "sign", "cents").withWatermark("until", f"{length_ms + lateness_ms} milliseconds")
    start = from_ms // slide_ms * slide_ms
    known = shops.select(shop).distinct().withColumn("from_ms", F.lit(start)).groupBy(shop)
    done = panes.groupBy(shop).transformWithStateInPandas(
        statefulProcessor=_Windows(shop, length_ms, slide_ms),
        outputStructType=f"{column}, window_start_ms bigint, window_end_ms bigint, order_count bigint, cents bigint",
        outputMode="Append", timeMode="EventTime", initialState=known,
    )
    return done.select(
        shop, "window_start_ms", "window_end_ms", "order_count", (F.col("cents").cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").alias("total_amount")
    )
