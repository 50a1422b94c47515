"""Pre-flight: does the configuration fit the checks and the tables? Schemas only, no job runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from ..functions import params as P
from ..sources.state import StateStore
from .checks.base import Check
from .config import Config


@dataclass(frozen=True)
class Problem:
    level: str
    message: str


def verify(config: Config, checks: Mapping[str, Check], columns: Mapping[str, set[str]], store: StateStore | None = None) -> list[Problem]:
    found: list[Problem] = []
    said: set[str] = set()

    def say(level: str, message: str, about: str = "") -> None:
        """A problem, once for each thing it is about, however many checks meet it."""
        if (about or message) not in said:
            said.add(about or message)
            found.append(Problem(level, message))

    if not columns:
        say("error", "there are no event tables")
    if store is not None and not store.exists():
        say("error", f"{store.folder} has no alert state; initialise it first")
    if not config.enabled:
        say("warning", "no check is enabled")
    for c in config.enabled:
        check = checks.get(c.rule)
        if check is None:
            say("error", f"{c.kind}: there is no rule {c.rule}")
            continue
        for key in sorted(set(c.params) - set(check.params)):
            say("warning", f"{c.kind}: {c.rule} doesn't read parameter {key}")
        for table, needed in check.requires.items() if columns else ():
            if table not in columns:
                say("error", f"table {table} is missing (for {c.rule})", table)
            for column in sorted(set(needed) - columns.get(table, set(needed))):
                say("error", f"table {table} has no column {column} (for {c.rule})", f"{table}.{column}")
    return found


def lookback(config: Config, checks: Mapping[str, Check]) -> float:
    """Hours before a pass that its checks look at, all of them: what each states as its reach, or the greatest of its parameters in hours."""
    return max((_reach(checks[c.rule], {**checks[c.rule].params, **c.params}) for c in config.enabled if c.rule in checks), default=24.0)


def _reach(check: Check, params: dict) -> float:
    if check.reach is not None:
        return float(check.reach(params))
    hours = []
    for k in params:
        if k.endswith("Hours") and params[k] is not None:
            try:
                hours.append(P.number(params, k))
            except P.ParamError:
                pass  # the check itself reports it
    return max(hours, default=24.0)
