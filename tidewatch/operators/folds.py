"""Conditional sums over uplinks: what several checks want of one table, each over its own window and scope, in one scan.

A Fold says what is made of each uplink of its window and scope, and what of that is summed up. folded() evaluates any number of folds
in one aggregation over the widest window and gives each its own columns, by device, name and profile; one() picks a
fold's columns out again. A payload is parsed once for all folds that look into it. Sums, counts, minima and maxima of numbers
and times are hashed before the shuffle. Only a fold with a newest row makes Spark sort, as a rank would.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload
from .scope import Scope
from .times import since, window

KEY = ("dev_eui", "device_name", "device_profile_name")
_HOW = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
Own = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Fold:
    """row: columns made of each uplink, in order; c("name") is one made before. values: name -> (sum, min, max or count of what isn't
    null; expression). parses: the payload is needed, as column _v. newest: columns of the newest decoded uplink, by
    (time, deduplication_id). Expressions may not fail on any row."""

    hours: float
    scope: Scope = field(default_factory=Scope)
    row: dict[str, Own] = field(default_factory=dict)
    values: dict[str, tuple[str, Own]] = field(default_factory=dict)
    parses: bool = False
    newest: tuple[str, ...] = ()


def folded(up: DataFrame, as_of: str, folds: Sequence[Fold]) -> DataFrame:
    """A row for each device, name and profile with an uplink in the widest window."""
    rows = window(up, as_of, max(f.hours for f in folds))
    inside = {f"_in{i}": (F.col("time") > since(up, as_of, f.hours)) & F.coalesce(f.scope.matches(), F.lit(False)) for i, f in enumerate(folds)}
    rows = rows.withColumns(inside)
    looked_into = [F.col(f"_in{i}") for i, f in enumerate(folds) if f.parses]
    if looked_into:
        rows = rows.withColumn("_v", F.when(reduce(Column.__or__, looked_into), payload.parsed()))
    own = [lambda name, i=i: F.col(f"_{i}_{name}") for i in range(len(folds))]
    for step in range(max(len(f.row) for f in folds)):
        made = [(i, *list(f.row.items())[step]) for i, f in enumerate(folds) if step < len(f.row)]
        rows = rows.withColumns({f"_{i}_{name}": F.when(F.col(f"_in{i}"), make(own[i])) for i, name, make in made})
    sums = []
    for i, f in enumerate(folds):
        counts = F.col(f"_in{i}")
        sums.append(F.count_if(counts).alias(f"f{i}_rows"))
        sums += [_HOW[how](F.when(counts, value(own[i]))).alias(f"f{i}_{name}") for name, (how, value) in f.values.items()]
        if f.newest:
            when = F.when(counts & F.col("object").isNotNull(), F.struct("time", "deduplication_id"))
            sums.append(F.max_by(F.struct("time", "deduplication_id", *f.newest), when).alias(f"f{i}_newest"))
    return rows.groupBy(*KEY).agg(*sums)


def one(sums: DataFrame, i: int, f: Fold) -> DataFrame:
    """Fold i: KEY, rows (above 0), its values, and newest as a struct."""
    names = ["rows", *f.values, *(["newest"] if f.newest else [])]
    return sums.filter(F.col(f"f{i}_rows") > 0).select(*KEY, *[F.col(f"f{i}_{n}").alias(n) for n in names])


def newest_of(found: DataFrame, *columns: str) -> DataFrame:
    """dev_eui, device_name, time and columns of each device's newest decoded uplink, of a fold with newest."""
    when = F.when(F.col("newest").isNotNull(), F.struct("newest.time", "newest.deduplication_id"))
    rows = found.groupBy("dev_eui").agg(F.max_by(F.struct("device_name", "newest"), when).alias("n")).filter("n is not null")
    return rows.select("dev_eui", "n.device_name", "n.newest.time", *[f"n.newest.{c}" for c in columns])
