"""Silence of devices as a stream: keyed state, timers in event time, and a time to live.

The stream's clock is its watermark. Each device keeps its newest uplinks (as many as it needs to count as known), uplinks
that the watermark hasn't reached yet, and whether it is in alert. A timer wakes it when something may change: an uplink is reached, it has
been silent for too long, or its uplinks leave the inventory. So after each trigger the devices in alert are those that
the check device-silent finds as of the watermark (down to its second), late rows within the watermark counted, and a
trigger costs what changed, not the inventory's window. When the last uplink has left the inventory, nothing of the device is kept.

Before rows meet by device, each batch of a partition keeps the newest few of a device, name and second; more can't matter. So
a device that sends a third of all rows makes a few rows a second of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.scope import Scope

#: Stores of keyed state that know timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What is kept of a device, in one value: each read or write of state is a call from Python to the executor.
STATE = "pending array<struct<at: bigint, name: string>>, heard array<bigint>, names map<string, bigint>, raised bigint, timer bigint"
EVENTS = "dev_eui string, device_name string, event string, as_of timestamp, last_seen timestamp"
SECOND = 1_000_000


class Silence(StatefulProcessor):
    """Per device: pending (time, name) beyond the clock, heard (the newest times up to it), names and their last times, raised (when it was last heard, if it is in alert), and its timer."""

    def __init__(self, silent: int, inventory: int, least: int):
        self.silent, self.inventory, self.least = silent, inventory, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.device = handle.getValueState("device", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        return self._turn(key[0], timerValues.getCurrentWatermarkInMs(), [(r["micros"], r["device_name"]) for r in rows])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._turn(key[0], timerValues.getCurrentWatermarkInMs(), [])

    def _turn(self, device: str, clock: int, new: list) -> Iterator[Row]:
        now = clock * 1000 // SECOND * SECOND
        known = now - self.inventory
        old = self.device.get() or ([], [], {}, None, None)
        pending = [(r[0], r[1]) for r in old[0]] + new
        due, later = [p for p in pending if p[0] <= now], [p for p in pending if p[0] > now]
        heard = [at for at in [*old[1], *(at for at, _ in due)] if at > known]
        heard = sorted(heard)[-self.least :]
        names = dict(old[2])
        for at, name in due:
            if name is not None:
                names[name] = max(at, names.get(name, at))
        kept = {k: v for k, v in names.items() if v > known}
        was = old[3]
        is_silent = len(heard) == self.least and heard[-1] < now - self.silent

        timer = self._wake(clock, later, heard, is_silent, old[4])
        if later or heard or kept:
            self.device.update((later, heard, kept, heard[-1] if is_silent else None, timer))
        else:
            self.device.clear()
        if (heard[-1] if is_silent else None) != was:
            event = "clear" if not is_silent else "raise" if was is None else "touch"
            last = pd.Timestamp(heard[-1], unit="us") if heard else None
            yield Row(dev_eui=device, device_name=max(kept, default=None), event=event, as_of=pd.Timestamp(now, unit="us"), last_seen=last)

    def _wake(self, clock: int, later: list, heard: list[int], is_silent: bool, old: int | None) -> int | None:
        """One timer, at the first second in which something may change; it is set only where it isn't the old one."""
        at = [t for t, _ in later]
        if heard:
            at.append((heard[0] if len(heard) == self.least else heard[-1]) + self.inventory)  # no longer known, or forgotten
            if not is_silent:
                at.append(heard[-1] + self.silent + 1)
        timer = max(clock + 1, -(-min(at) // SECOND) * 1000) if at else None
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)
        return timer

    def close(self) -> None:
        pass


def _newest_few(least: int):
    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            second = -(-b.micros // SECOND)
            yield b.sort_values("micros").groupby(["dev_eui", b.device_name.fillna("\0"), second], sort=False).tail(least)

    return thin


def silence(uplinks: DataFrame, silent_minutes: float = 180, inventory_hours: float = 168, min_uplinks: int = 5, late: str = "2 hours", scope: Scope | None = None) -> DataFrame:
    """Events (dev_eui, device_name, event, as_of, last_seen) of a stream of uplinks: raise, touch (heard and silent again
    between two triggers) and clear. late: how late rows may be.

    Rows without device or time don't count. The session needs PROVIDER as its store of state.
    """
    rows = (scope or Scope()).apply(uplinks).filter("dev_eui is not null and time is not null")
    rows = rows.select("dev_eui", "device_name", F.unix_micros(F.col("time").cast("timestamp")).alias("micros"))
    rows = rows.mapInPandas(_newest_few(min_uplinks), rows.schema).withColumn("time", F.timestamp_micros("micros"))
    processor = Silence(round(silent_minutes * 60 * SECOND), round(inventory_hours * 3600 * SECOND), min_uplinks)
    return rows.withWatermark("time", late).groupBy("dev_eui").transformWithState(processor, EVENTS, "Append", "EventTime")


def in_alert(events: DataFrame) -> DataFrame:
    """Devices in alert after these events: those whose last one isn't a clear."""
    last = events.groupBy("dev_eui").agg(F.max_by(F.struct("device_name", "event", "as_of", "last_seen"), "as_of").alias("e"))
    return last.filter("e.event <> 'clear'").select("dev_eui", "e.device_name", "e.as_of", "e.last_seen")
