"""Shared scans: a pass reads event_up twice, however many checks look at it.

One scan gives the numeric readings of all window checks: the greatest lookback and the union of their candidate
paths make one frame, which is cached; each check filters it by path, time and scope. Where partial sums of the readings are
stored, these checks read them instead, and of event_up the edges of their windows only. The other scan sums up uplinks for all
checks that count them (silence, decoding, signal, presence of fields, joins) and takes each device's newest
decoded uplink, by one aggregation with a condition for each check; its result, a row for each device and name, is cached. A newest
uplink of the greatest lookback is the newest of a shorter one as well, if it lies in that.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions import payload
from ..operators import resolvers as R
from ..operators.folds import Fold, folded, newest_of, one
from ..operators.scope import Scope
from ..sources.partials import Partials
from .checks.base import Check, Context
from .config import CheckConfig

NEWEST_RULES = ("battery-low", "measurement-threshold", "boolean-alarm", "geofence-breach")
#: Name of the fold of newest uplinks; no check's kind has a blank.
NEWEST = "newest uplinks"
WINDOW_RULES = ("measurement-peak", "measurement-rate", "measurement-stuck", "counter-stalled", "counter-spike")


class SharedTables(Mapping):
    """The event tables, and what several checks share: readings, sums over uplinks, newest decoded uplinks."""

    def __init__(self, tables: Mapping[str, DataFrame], as_of: str, readings: DataFrame | None, sums: DataFrame | None, folds: Mapping[str, tuple[int, Fold]], partials: Partials | None):
        self._tables, self._as_of, self._readings, self._sums, self._folds, self._partials = tables, as_of, readings, sums, folds, partials
        if readings is None:
            self.telemetry = None

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def fill(self) -> None:
        """Compute what is shared, so that its time isn't that of the first check that reads it."""
        for df in self.cached():
            df.count()

    def cached(self) -> list[DataFrame]:
        return [df for df in (self._readings, self._sums) if df is not None]

    def folded(self, kind: str) -> DataFrame | None:
        """A check's sums over uplinks; None if they aren't among the shared ones."""
        return one(self._sums, *self._folds[kind]) if kind in self._folds else None

    def newest(self, scope: Scope) -> DataFrame | None:
        found = self.folded(NEWEST) if scope == Scope() else None
        return None if found is None else newest_of(found, "object")

    def stats(self, paths: R.Paths, hours: float, scope: Scope, decimals: int | None) -> DataFrame | None:
        """Window statistics from stored partial sums; None where these don't have all the paths."""
        if self._partials is None or not self._partials.has(paths):
            return None
        return self._partials.stats(self["event_up"], paths, hours, scope, self._as_of, decimals, distinct=decimals is not None)

    def telemetry(self, paths: R.Paths, hours: float, scope: Scope) -> DataFrame:
        """As resolvers.telemetry, from the shared readings."""
        names = [".".join(p) for p in paths]
        rows = scope.apply(self._readings.filter(F.col("path").isin(names)))
        rows = rows.filter(F.col("time") > R.since(self._readings, self._as_of, hours))
        order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path")) - 1
        return rows.select("dev_eui", "device_name", "time", "deduplication_id", order.cast("int").alias("ord"), "num")


def shared(tables: Mapping[str, DataFrame], checks: list[tuple[CheckConfig, Check]], as_of: str, partials: Partials | None = None) -> SharedTables | None:
    """Tables with what these checks share; None if there is nothing. A check whose parameters are wrong is left to itself."""
    paths: dict[str, tuple[str, ...]] = {}
    hours, users, back, folds = 0, 0, [], {}
    for c, check in checks:
        merged = {**check.params, **c.params}
        try:
            if check.id in NEWEST_RULES and Scope.of(merged) == Scope():
                back.append(P.number(merged, "lookbackHours"))
            fold = check.folds(Context(tables, c.params, as_of, c.kind))
            if fold is not None:
                folds[c.kind] = fold
            if check.id not in WINDOW_RULES:
                continue
            own, own_hours = P.paths(merged), P.whole(merged, "lookbackHours", 1)
        except (P.ParamError, LookupError, ValueError):
            continue  # the check itself reports it
        if partials is not None and partials.has(own):
            continue
        users += 1
        hours = max(hours, own_hours)
        paths |= {".".join(p): p for p in own}
    up, readings, sums = tables["event_up"], None, None
    if back:
        folds[NEWEST] = Fold(max(back) + 1, newest=("object",))  # an hour more: some round theirs
    numbered = {kind: (i, f) for i, (kind, f) in enumerate(folds.items())}
    if numbered:
        sums = folded(up, as_of, list(folds.values())).cache()
    if users > 1:
        rows = R.window(up, as_of, hours).filter(F.col("object").isNotNull())
        readings = payload.readings(rows, paths, "dev_eui", "device_name", "device_profile_name", "time", "deduplication_id").cache()
    if sums is None and readings is None and partials is None:
        return None
    return SharedTables(tables, as_of, readings, sums, numbered, partials)


def release(tables: Mapping[str, DataFrame]) -> None:
    if isinstance(tables, SharedTables):
        for df in tables.cached():
            df.unpersist()
