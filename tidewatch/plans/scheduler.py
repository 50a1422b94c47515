"""Passes on a schedule: none starts while another runs, and one that fails doesn't end the service."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from ..log import Log

_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


class Schedule:
    """A five-field cron expression: lists, ranges and steps."""

    def __init__(self, expression: str, zone: str = "UTC"):
        parts = expression.split()
        if len(parts) != 5:
            raise ValueError(f"schedule must have five fields, not {expression!r}")
        self.zone = ZoneInfo(zone)
        self.fields = [self._field(p, lo, hi) for p, (lo, hi) in zip(parts, _FIELDS)]
        self.any_day, self.any_weekday = parts[2] == "*", parts[4] == "*"

    @staticmethod
    def _field(text: str, lo: int, hi: int) -> set[int]:
        found: set[int] = set()
        for part in text.split(","):
            m = re.fullmatch(r"(?:\*|(\d+)(?:-(\d+))?)(?:/(\d+))?", part)
            if not m:
                raise ValueError(f"can't read {part!r} in the schedule")
            step = int(m[3] or 1)
            first = lo if m[1] is None else int(m[1])
            last = hi if m[1] is None or (m[3] and not m[2]) else int(m[2] or m[1])
            if not (lo <= first <= last <= hi) or step < 1:
                raise ValueError(f"{part!r} is out of range in the schedule")
            found.update(range(first, last + 1, step))
        return found

    def matches(self, t: datetime) -> bool:
        minute, hour, day, month, weekday = self.fields
        on_day, on_weekday = t.day in day, (t.isoweekday() % 7) in {w % 7 for w in weekday}
        right_day = (on_day and on_weekday) if self.any_day or self.any_weekday else (on_day or on_weekday)
        return t.minute in minute and t.hour in hour and t.month in month and right_day

    def after(self, t: datetime) -> datetime:
        """The first minute after t that the schedule names."""
        t = t.astimezone(self.zone).replace(second=0, microsecond=0) + timedelta(minutes=1)
        for _ in range(366 * 24 * 60):
            if self.matches(t):
                return t
            t += timedelta(minutes=1)
        raise ValueError("the schedule names no time within a year")


class Service:
    def __init__(self, schedule: Schedule, job: Callable[[], object], log: Log | None = None):
        self.schedule, self.job, self.log = schedule, job, log or Log()
        self.busy, self.stopped = threading.Lock(), threading.Event()

    def tick(self) -> bool:
        """Run the job unless it is running; False if it was skipped."""
        if not self.busy.acquire(blocking=False):
            self.log.warning("pass skipped, the one before still runs")
            return False
        try:
            self.job()
        except Exception as e:  # noqa: BLE001
            self.log.error("pass failed", error=str(e))
        finally:
            self.busy.release()
        return True

    def stop(self) -> None:
        self.stopped.set()

    def serve(self, run_on_start: bool = False, now: Callable[[], datetime] = lambda: datetime.now().astimezone()) -> None:
        """Until stop(): a running pass ends first."""
        if run_on_start:
            self.tick()
        while not self.stopped.is_set():
            at = self.schedule.after(now())
            if self.stopped.wait(max(0.0, (at - now()).total_seconds())):
                break
            self.tick()
