"""What a check is: a pure function of event tables, parameters, time and devices already in alert."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import params as P
from ...operators.folds import Fold, folded, one
from ...operators.scope import DEFAULTS as SCOPE
from ...operators.scope import Scope

SEVERITIES = ("info", "warning", "critical")
ROUTINGS = ("fact", "situation")

#: Columns that every scoped check reads, by table.
COMMON = ("time", "dev_eui", "device_name", "device_profile_name")
UPLINK = {"event_up": (*COMMON, "deduplication_id", "object")}


@dataclass
class Context:
    """Inputs of one run of a check. open_devices: dev_eui of devices with an open alert of this kind."""

    tables: Mapping[str, DataFrame]
    params: Mapping[str, Any]
    as_of: str
    kind: str = ""
    open_devices: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"there is no table {name}")
        return self.tables[name]

    @property
    def scope(self) -> Scope:
        return Scope.of(dict(self.params))

    def newest(self) -> DataFrame | None:
        """Newest decoded uplinks that a planner has put into the tables, if they are the ones this check looks at."""
        shared = getattr(self.tables, "newest", None)
        return shared(self.scope) if shared else None

    def folded(self, fold: Fold) -> DataFrame:
        """Sums over uplinks by device, name and profile; a planner may have put them into the tables already."""
        shared = getattr(self.tables, "folded", None)
        found = shared(self.kind) if shared else None
        return found if found is not None else one(folded(self.table("event_up"), self.as_of, [fold]), 0, fold)

    def with_open(self, df: DataFrame) -> DataFrame:
        """df with is_open."""
        if self.open_devices is None:
            return df.withColumn("is_open", F.lit(False))
        known = self.open_devices.select(F.col("dev_eui").alias("_open")).distinct()
        return df.join(known, df.dev_eui == known["_open"], "left").withColumn("is_open", F.col("_open").isNotNull()).drop("_open")


@dataclass(frozen=True)
class Check:
    id: str
    description: str
    severity: str
    defaults: dict[str, Any]
    requires: dict[str, tuple[str, ...]]
    find: Callable[[Context], DataFrame]
    #: What the check sums up of event_up, where it reads these sums through Context.folded: a planner makes them for all checks at once.
    fold: Callable[[Context], Fold] | None = None
    #: Hours before a pass that the check reads, of its parameters; without it the greatest parameter in ...Hours.
    reach: Callable[[dict[str, Any]], float] | None = None
    routing: str = "fact"
    scoped: bool = True
    params: dict[str, Any] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "params", {**self.defaults, **(SCOPE if self.scoped else {})})

    def folds(self, ctx: Context) -> Fold | None:
        """The check's fold for these parameters; wrong ones raise."""
        ctx.params = {**self.params, **ctx.params}
        return self.fold(ctx) if self.fold else None

    def run(self, ctx: Context) -> DataFrame:
        """Findings: dev_eui, device_name, severity, summary, detail (a struct)."""
        ctx.params = {**self.params, **ctx.params}
        return self.find(ctx)


def label() -> Column:
    return F.coalesce(F.col("device_name"), F.col("dev_eui"))


def told(pattern: str, *values: Column | str) -> Column:
    """A one-line summary: the device's label, then the pattern's text."""
    return F.format_string("%s: " + pattern, label(), *[F.col(v) if isinstance(v, str) else v for v in values])


def finding(df: DataFrame, severity: Column | str, summary: Column, order: Column | None = None, **detail: Column) -> DataFrame:
    """Findings in the common form. order: a number that is lower for worse findings; these are announced first."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        "dev_eui", "device_name", severity.alias("severity"), summary.alias("summary"), F.struct(*[c.alias(k) for k, c in detail.items()]).alias("detail"),
        *([] if order is None else [order.cast("bigint").alias("ordinal")]),
    )


def graded(hit: Column, ordinary: str) -> Column:
    return F.when(hit, F.lit("critical")).otherwise(F.lit(ordinary))


def candidates(ctx: Context, key: str = "paths") -> list[tuple[str, ...]]:
    return P.paths(dict(ctx.params), key)
