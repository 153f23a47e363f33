"""Out-of-service status of machines, with automatic clearing."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vitalspark.operators.changes import OOS_DAYS
from vitalspark.streaming.store import compact_latest, keep_state_on_disk, read_latest, write_batch

# the newest event in microseconds, doubled, plus one for a report
EVENTS = "machine string, last long"
STATE = "last bigint, cleared boolean"
CHANGES = "machine string, last long, cleared boolean"
OPEN, FIX = "report", "resolve"
#: The key of events without a machine; machines are numbers.
NO_MACHINE = "none"


class MachineClock(StatefulProcessor):
    """Keeps the newest event of a machine; a timer clears a report that nothing followed."""

    def __init__(self, hold_us: int):
        self.hold_us = hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", STATE)

    def _due(self, last: int) -> int:
        """Millisecond at which a report clears."""
        return ((last >> 1) + self.hold_us) // 1000

    def _row(self, key, last: int, cleared: bool) -> pd.DataFrame:
        self.state.update((last, cleared))
        return pd.DataFrame({"machine": [key[0]], "last": [last], "cleared": [cleared]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(part["last"].max()) for part in rows)
        before = self.state.get() if self.state.exists() else None
        if before is not None and newest <= before[0]:
            return
        if before is not None and before[0] & 1 and not before[1]:
            self.handle.deleteTimer(self._due(before[0]) - 1)
        due, passed = self._due(newest), False
        if newest & 1:
            passed = due <= timerValues.getCurrentWatermarkInMs()
            if not passed:
                self.handle.registerTimer(due - 1)
        yield self._row(key, newest, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, cleared = self.state.get()
        if not last & 1 or cleared:
            return
        if self._due(last) <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, last, True)
        else:
            self.handle.registerTimer(self._due(last))

    def close(self) -> None:
        pass


def newest_events(events: DataFrame) -> DataFrame:
    """One row per machine and Arrow batch, so that a machine with most of the events sends few."""

    def reduce(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by("machine").aggregate([("last", "max")])
            yield from table.rename_columns(["machine", "last"]).to_batches()

    last = F.unix_micros("at") * 2 + (F.col("kind") == OPEN).cast("long")
    machine = F.coalesce(F.col("gym_equipment_id").cast("long").cast("string"), F.lit(NO_MACHINE))
    return events.select(machine.alias("machine"), last.alias("last")).mapInArrow(reduce, EVENTS)


def status_columns(hold_us: int) -> list:
    """The stored row of a machine from ``last`` and ``cleared``; clearing is due at whole milliseconds."""
    out = (F.col("last") % 2 != 0) & ~F.col("cleared")
    at = F.shiftright("last", 1)
    due = F.timestamp_micros(at - F.pmod(at, F.lit(1000)) + hold_us)
    machine = F.when(F.col("machine") != NO_MACHINE, F.col("machine")).cast("long")
    return [
        machine.alias("gym_equipment_id"), out.alias("is_out_of_service"),
        F.when(F.col("cleared"), due).otherwise(F.timestamp_micros(at)).alias("changed_at"),
        F.when(out, due).alias("auto_clear_at"),
        F.when(F.col("cleared"), "cleared").when(out, OPEN).otherwise(FIX).alias("cause"),
    ]


def stream_oos_state(
    events: DataFrame,
    store: str,
    checkpoint: str,
    *,
    days: int = OOS_DAYS,
    delay: str = "1 day",
    compact_every: int | None = 64,
    **trigger,
) -> StreamingQuery:
    """Status changes from events (gym_equipment_id, at, kind 'report' or 'resolve').

    Each report restarts the clock; a fix stops it; when it runs out the machine is in
    service again, without waiting for another event of its own. The clock is the watermark:
    the newest event of any machine less ``delay``. The newest event of a machine decides, on
    equal times a report, however late and in whichever batch it comes, so the status after any
    cut into batches is the same. Other kinds and events without a time leave everything as it is.

    The state is Spark's keyed state with event-time timers: a batch reads and writes the machines
    it has events of and those whose time has run out. Late events reach the state too, because
    the column that carries the watermark ends before it. After every ``compact_every`` batches the
    stored changes are reduced to one row per machine (never, if None).
    """
    keep_state_on_disk(events.sparkSession)
    hold_us = int(timedelta(days=days).total_seconds() * 1_000_000)
    timed = events.withColumn("at", F.col("at").cast("timestamp")).filter(
        F.col("at").isNotNull() & F.col("kind").isin(OPEN, FIX)).withWatermark("at", delay)
    changed = newest_events(timed).groupBy("machine").transformWithStateInPandas(
        MachineClock(hold_us), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        # a machine may change by an event and by its timer in one batch; the later state counts
        last = batch.groupBy("machine").agg(F.max(F.struct("last", "cleared")).alias("s"))
        write_batch(last.select("machine", "s.*").select(*status_columns(hold_us)), store, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_latest(batch.sparkSession, store, ["gym_equipment_id"])

    return (
        changed.writeStream.outputMode("update").foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def machine_status(spark: SparkSession, store: str) -> DataFrame:
    """Current status of every machine that had an event."""
    return read_latest(spark, store, ["gym_equipment_id"])
