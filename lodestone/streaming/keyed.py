"""Keyed state over event time: rows of a key are held until the watermark passes them, and then folded in order.

Times count to the millisecond. A stream gives what its batch twin gives over the same rows, in whatever order they arrive, as long as none is later than
the watermark allows. State is kept by ``transformWithState``; a timer at the end of a key's first open period folds all that the
watermark has passed, so a key's rows are read once for a move of the watermark, not once a row or period. A key's open rows and one small carry are all that is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: From a carry and a row (time in ms, id, amount) to the next carry and what is put out, if anything.
Step = Callable[[tuple, tuple], tuple[tuple, tuple | None]]


class InOrder(StatefulProcessor):
    """Holds a key's rows, and folds those that the watermark has passed in the order of (time, id), at the latest once a period ends."""

    def __init__(self, step: Step, start: tuple, carry: str, names: tuple[str, ...], period_ms: int = 60_000):
        self.step, self.start, self.carry, self.names, self.period = step, start, carry, ("key", *names), period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long, id long, amount long")
        self.state = handle.getValueState("carry", self.carry)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        own = [(r["t"], r["id"], r["amount"]) for r in rows if r["hit"]]
        if key[0] is not None and own:
            self.held.appendList(own)
            self._wake(own)
        return iter([])

    def _wake(self, rows: list[tuple]) -> None:
        self.handle.registerTimer((min(rows)[0] // self.period + 1) * self.period)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # what comes later is at or after the watermark: all before it is whole, whichever period it is in
        end = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = [tuple(r) for r in self.held.get()]
        due, later = sorted(r for r in rows if r[0] < end), [r for r in rows if r[0] >= end]
        if not due:
            return  # an earlier timer of the key took them
        if later:
            self.held.put(later)
            self._wake(later)
        else:
            self.held.clear()
        held = self.state.get()
        now = self.start if held is None else tuple(held)
        for r in due:
            now, out = self.step(now, r)
            if out is not None:
                yield Row(**dict(zip(self.names, (*key, *out))))
        self.state.update(now)

    def close(self) -> None:
        pass


def _folded(events: DataFrame, key: str, time: str, id_col: str, amount: Column, delay: str, processor: InOrder, output: str, hit: Column | None = None) -> DataFrame:
    spark: SparkSession = events.sparkSession
    if spark.conf.get(_PROVIDER, None) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)  # the store that knows lists and timers
    hit = F.lit(True) if hit is None else hit
    own = events.select(F.col(key).alias("key"), F.col(time).alias("at"), F.unix_millis(time).alias("t"), F.col(id_col).cast("long").alias("id"), amount.cast("long").alias("amount"), hit.alias("hit"))
    # a filter would go below the watermark, which every row is to move: the processor passes over rows without a key or hit
    own = own.withWatermark("at", delay).where("at is not null")
    return own.groupBy("key").transformWithState(processor, f"key {own.schema['key'].dataType.simpleString()}, {output}", "Append", "EventTime")


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


def escalations(events: DataFrame, key: str, time: str, id_col: str, hit: Column, least: int = 2, delay: str = "1 hour") -> DataFrame:
    """(key, escalated_at): the time of a key's ``least``-th hit, once for a key. In a stream, as soon as nothing earlier can come."""
    if not events.isStreaming:
        own = events.where(hit & F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.unix_millis(time).alias("t"), F.col(id_col).alias("id"))
        place = F.row_number().over(Window.partitionBy("key").orderBy("t", "id"))
        return own.withColumn("place", place).where(F.col("place") == least).select("key", F.timestamp_millis("t").alias("escalated_at"))

    def step(seen: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        n = seen[0] + 1
        return (min(n, least + 1),), ((_time(row[0]),) if n == least else None)

    return _folded(events, key, time, id_col, F.lit(0), delay, InOrder(step, (0,), "n long", ("escalated_at",)), "escalated_at timestamp", hit)


def admissions(requests: DataFrame, key: str, time: str, id_col: str, per_minute: int = 30, per_hour: int = 500, delay: str = "1 hour") -> DataFrame:
    """(key, id, refused_by): whether each request passes tumbling limits, ``minute`` or ``hour`` if one refuses it, else null.

    What the minute refuses counts towards no limit; what the hour refuses has counted in its minute.
    """
    if not requests.isStreaming:
        own = requests.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.unix_millis(time).alias("t"), F.col(id_col).cast("long").alias("id"))
        inside = lambda ms, *more: F.row_number().over(Window.partitionBy("key", F.expr(f"t div {ms}"), *more).orderBy("t", "id"))
        own = own.withColumn("late", inside(60_000) > per_minute)
        hour = (~F.col("late")) & (inside(3_600_000, "late") > per_hour)
        return own.withColumn("refused_by", F.when(F.col("late"), "minute").when(hour, "hour")).select("key", "id", "refused_by")

    def step(seen: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        minute, in_minute, hour, in_hour = seen
        m, h = row[0] // 60_000, row[0] // 3_600_000
        in_minute, in_hour = in_minute if m == minute else 0, in_hour if h == hour else 0
        if in_minute >= per_minute:
            return (m, in_minute, h, in_hour), (row[1], "minute")
        if in_hour >= per_hour:
            return (m, in_minute + 1, h, in_hour), (row[1], "hour")
        return (m, in_minute + 1, h, in_hour + 1), (row[1], None)

    return _folded(requests, key, time, id_col, F.lit(0), delay, InOrder(step, (-1, 0, -1, 0), "m long, in_minute long, h long, in_hour long", ("id", "refused_by")), "id long, refused_by string")


def capped_turns(turns: DataFrame, key: str, time: str, id_col: str, tokens: str, cap: int = 50_000, most: int = 15, delay: str = "1 hour") -> DataFrame:
    """(key, id, total): the turns of a conversation that run, with its tokens after each: the first ``most``, each only if
    those before it took less than ``cap``."""
    amount = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    if not turns.isStreaming:
        own = turns.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.unix_millis(time).alias("t"), F.col(id_col).cast("long").alias("id"), amount.alias("amount"))
        w = Window.partitionBy("key").orderBy("t", "id")
        own = own.withColumns({"place": F.row_number().over(w), "total": F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0))})
        return own.where((F.col("place") <= most) & (F.col("total") - F.col("amount") < cap)).select("key", "id", "total")

    def step(seen: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        n, total = seen
        if n >= most or total >= cap:
            return seen, None
        return (n + 1, total + row[2]), (row[1], total + row[2])

    return _folded(turns, key, time, id_col, amount, delay, InOrder(step, (0, 0), "n long, total long", ("id", "total")), "id long, total long")
