"""Where an alert goes: the check's own target, then by severity, by class, by default; null stops the search."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a route that isn't there; null means "record only".
ABSENT = "\0absent"


def destination(severity: str, routing: str, notify_to: Any, by_severity: dict, by_class: dict, default: Any) -> str | None:
    for target in (notify_to, by_severity.get(severity, ABSENT), by_class.get(routing, ABSENT), default):
        if target != ABSENT:
            return target
    return None


def destination_column(severity: Column, routing: Column, notify_to: Column, by_severity: dict, by_class: dict, default: Any) -> Column:
    """The same as an expression. notify_to: ABSENT where the check has none."""

    def lookup(key: Column, routes: dict) -> Column:
        out = F.lit(ABSENT)
        for k, v in routes.items():
            out = F.when(key == k, F.lit(v)).otherwise(out)
        return out

    out = F.lit(None if default == ABSENT else default)
    for step in (lookup(routing, by_class), lookup(severity, by_severity), notify_to):
        out = F.when(step.eqNullSafe(F.lit(ABSENT)), out).otherwise(step)
    return out
