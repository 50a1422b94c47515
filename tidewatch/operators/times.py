"""Windows over event tables: literals of the column's type, so that filters reach the files' statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scope import Scope


def moment(events: DataFrame, as_of: str) -> Column:
    """as_of as a literal of the type of the table's time column, so that filters reach the files' statistics."""
    return F.lit(as_of).cast(events.schema["time"].dataType)


def since(events: DataFrame, as_of: str, hours: float = 0, minutes: float = 0) -> Column:
    seconds = hours * 3600 + minutes * 60
    return moment(events, as_of) - F.expr(f"make_dt_interval(0, 0, 0, {seconds:.6f})")


def window(events: DataFrame, as_of: str, hours: float, scope: Scope | None = None) -> DataFrame:
    """Events after as_of - hours and up to as_of."""
    first, last = since(events, as_of, hours), moment(events, as_of)
    rows = events.filter((F.col("time") > first) & (F.col("time") <= last))
    if "day" in events.columns:  # folders by day
        rows = rows.filter((F.col("day") >= F.to_date(first)) & (F.col("day") <= F.to_date(last))).drop("day")
    return (scope or Scope()).apply(rows)


def hours_between(start: Column, end: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(3.6e9)
