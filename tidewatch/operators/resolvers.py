"""The reusable queries under the checks.

Each is one lazy DataFrame over uplinks (dev_eui, device_name, device_profile_name, time,
deduplication_id, object): time and scope reach the scan, the payload is parsed once, candidate
paths are literals. as_of is explicit; a window is open at its start: time > as_of - hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload
from .folds import Fold, folded, one
from .scope import Scope
from .times import hours_between, moment, since, window  # noqa: F401  (resolvers' users take them from here)

Paths = list[tuple[str, ...]]


def _names(paths: Paths) -> list[str]:
    return [".".join(p) for p in paths]


def _newest(rows: DataFrame, *columns: str) -> DataFrame:
    """The newest row of each device; ties go to the greatest id."""
    order = Window.partitionBy("dev_eui").orderBy(F.col("time").desc(), F.col("deduplication_id").desc())
    keep = ["dev_eui", "device_name", "time", *columns]
    return rows.select(*keep, "deduplication_id").withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*keep)


def newest_decoded(up: DataFrame, hours: float, scope: Scope, as_of: str) -> DataFrame:
    """dev_eui, device_name, time, object: each device's newest decoded uplink."""
    return _newest(window(up, as_of, hours, scope).filter(F.col("object").isNotNull()), "object")


def _parsed(up: DataFrame, hours: float, scope: Scope, as_of: str, newest: DataFrame | None) -> DataFrame:
    """The newest decoded uplinks with their payload. newest: they are there already, of a window that reaches farther back."""
    rows = newest_decoded(up, hours, scope, as_of) if newest is None else newest.filter(F.col("time") > since(newest, as_of, hours))
    return rows.withColumn("_v", payload.parsed())


def latest_readings(up: DataFrame, paths: Paths, hours: float, scope: Scope, as_of: str, newest: DataFrame | None = None) -> DataFrame:
    """dev_eui, device_name, matched_path, value, at: first numeric candidate on each device's newest decoded uplink.

    A device whose newest decoded uplink has none of them has no row.
    """
    rows = _parsed(up, hours, scope, as_of, newest)
    value, path = payload.first_of([payload.leaf_number(F.col("_v"), p) for p in paths], _names(paths))
    out = rows.select("dev_eui", "device_name", path.alias("matched_path"), value.cast("double").alias("value"), F.col("time").alias("at"))
    return out.filter("value is not null")


def latest_flags(up: DataFrame, paths: Paths, hours: float, scope: Scope, true_values: list[str], as_of: str, newest: DataFrame | None = None) -> DataFrame:
    """dev_eui, device_name, matched_path, raw, value, at: first candidate that is there, compared to the words for true."""
    rows = _parsed(up, hours, scope, as_of, newest)
    raw, path = payload.first_of([payload.leaf_text(F.col("_v"), p) for p in paths], _names(paths))
    yes = F.lower(F.col("raw")).isin([v.lower() for v in true_values])
    out = rows.select("dev_eui", "device_name", path.alias("matched_path"), raw.alias("raw"), F.col("time").alias("at"))
    return out.filter("raw is not null").select("dev_eui", "device_name", "matched_path", "raw", yes.alias("value"), "at")


def latest_fixes(up: DataFrame, lat_paths: Paths, lon_paths: Paths, hours: float, scope: Scope, as_of: str, newest: DataFrame | None = None) -> DataFrame:
    """dev_eui, device_name, lat, lon, at: both halves from each device's newest decoded uplink, or no row."""
    rows = _parsed(up, hours, scope, as_of, newest)
    half = lambda paths: F.coalesce(*[payload.leaf_number(F.col("_v"), p) for p in paths]).cast("double")
    out = rows.select("dev_eui", "device_name", half(lat_paths).alias("lat"), half(lon_paths).alias("lon"), F.col("time").alias("at"))
    return out.filter("lat is not null and lon is not null")


def telemetry(up: DataFrame, paths: Paths, hours: float, scope: Scope, as_of: str, *more: str) -> DataFrame:
    """dev_eui, device_name, time, deduplication_id, more columns of up, ord, num: every numeric reading of every candidate."""
    rows = window(up, as_of, hours, scope).filter(F.col("object").isNotNull())
    rows = rows.select("dev_eui", "device_name", "time", "deduplication_id", *more, payload.parsed().alias("_v"))
    each = F.array(*[F.struct(F.lit(i).alias("ord"), payload.leaf_number(F.col("_v"), p).alias("num")) for i, p in enumerate(paths)])
    return rows.select("dev_eui", "device_name", "time", "deduplication_id", *more, F.inline(F.filter(each, lambda x: x["num"].isNotNull())))


def by_value(readings: DataFrame, *key: str) -> DataFrame:
    """Readings summed up by value: key, num, n, lo and hi (time and id of its first and last reading), device_name."""
    when = F.struct("time", "deduplication_id")
    return readings.groupBy(*key, "num").agg(F.count("*").alias("n"), F.min(when).alias("lo"), F.max(when).alias("hi"), F.max("device_name").alias("device_name"))


def winners(sums: DataFrame, paths: Paths) -> DataFrame:
    """Statistics of each device's winning candidate, of sums by device and candidate."""
    first = Window.partitionBy("dev_eui")
    won = sums.withColumn("_first", F.min("ord").over(first)).filter("ord = _first")
    name = F.element_at(F.array(*[F.lit(n) for n in _names(paths)]), F.col("ord") + 1)
    return won.select(
        "dev_eui",
        "device_name",
        name.alias("matched_path"),
        *[F.col(c).cast("double").alias(c) for c in ("vmin", "vmax")],
        F.round(F.col("total") / F.col("samples"), 4).cast("double").alias("vavg"),
        F.col("lo.num").cast("double").alias("vfirst"),
        F.col("hi.num").cast("double").alias("vlast"),
        "samples",
        "distinct_values",
        F.col("lo.time").alias("first_at"),
        F.col("hi.time").alias("last_at"),
        (F.col("total").cast("double") / F.col("samples")).alias("mean"),
    )


def stats_of(readings: DataFrame, paths: Paths, decimals: int | None = None) -> DataFrame:
    """Statistics of each device's winning candidate (the first that has a reading anywhere in the window).

    dev_eui, device_name, matched_path, vmin, vmax, vavg, vfirst, vlast, samples, distinct_values,
    first_at, last_at. Readings are first summed by value, before and after a shuffle by device,
    candidate and value; only these sums meet by device, so one device may hold any share of the rows.
    """
    return stats_of_values(by_value(rounded(readings, decimals), "dev_eui", "ord"), paths)


def rounded(readings: DataFrame, decimals: int | None) -> DataFrame:
    return readings if decimals is None else readings.withColumn("num", F.round("num", decimals).cast(payload.READING))


def stats_of_values(values: DataFrame, paths: Paths) -> DataFrame:
    """stats_of, from a row for each device, candidate and value."""
    wide = lambda c: c.cast("decimal(38,12)")
    sums = values.groupBy("dev_eui", "ord").agg(
        F.max("device_name").alias("device_name"),
        F.min("num").alias("vmin"),
        F.max("num").alias("vmax"),
        F.sum(wide(F.col("num") * F.col("n"))).alias("total"),
        F.sum("n").alias("samples"),
        F.count("*").alias("distinct_values"),
        F.min(F.struct("lo.time", "lo.deduplication_id", "num")).alias("lo"),
        F.max(F.struct("hi.time", "hi.deduplication_id", "num")).alias("hi"),
    )
    return winners(sums, paths)


def window_stats(up: DataFrame, paths: Paths, hours: float, scope: Scope, as_of: str, decimals: int | None = None) -> DataFrame:
    return stats_of(telemetry(up, paths, hours, scope, as_of), paths, decimals)


def presence(paths: Paths, hours: float, recent_hours: float, scope: Scope, up: DataFrame, as_of: str) -> Fold:
    """What path_presence sums up of its uplinks."""
    recent = F.col("time") > since(up, as_of, recent_hours)
    row = {f"seen{i}": lambda c, p=p: F.when(payload.leaf_text(F.col("_v"), p).isNotNull(), F.col("time")) for i, p in enumerate(paths)}
    values = {"recent_uplinks": ("count", lambda c: F.when(recent, True))}
    for i in range(len(paths)):
        seen = lambda c, i=i: c(f"seen{i}")
        values |= {f"ever{i}": ("count", seen), f"now{i}": ("count", lambda c, i=i: F.when(recent, c(f"seen{i}"))), f"last{i}": ("max", seen)}
    return Fold(hours, scope, row, values, parses=True)


def presence_of(sums: DataFrame, paths: Paths, each_path: bool = False) -> DataFrame:
    """path_presence from a fold's sums by device, name and profile."""
    parts = [F.max("device_name").alias("device_name"), F.sum("recent_uplinks").alias("recent_uplinks")]
    for i in range(len(paths)):
        parts += [F.sum(f"ever{i}").alias(f"ever{i}"), F.sum(f"now{i}").alias(f"now{i}"), F.max(f"last{i}").alias(f"last{i}")]
    by_device = sums.groupBy("dev_eui").agg(*parts)
    found = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("matched_path"),
                    F.col(f"ever{i}").alias("ever_seen"),
                    F.col(f"now{i}").alias("recent_seen"),
                    F.col(f"last{i}").alias("last_seen_at"),
                )
                for i, name in enumerate(_names(paths))
            ]
        ),
        lambda x: x["ever_seen"] > 0,
    )
    found = found if each_path else F.slice(found, 1, 1)
    rows = by_device.select("dev_eui", "device_name", "recent_uplinks", F.inline(found))
    return rows.select("dev_eui", "device_name", "matched_path", "ever_seen", "recent_seen", "recent_uplinks", "last_seen_at")


def path_presence(up: DataFrame, paths: Paths, hours: float, recent_hours: float, scope: Scope, as_of: str, each_path: bool = False) -> DataFrame:
    """dev_eui, device_name, matched_path, ever_seen, recent_seen, recent_uplinks, last_seen_at.

    The candidate is the first that was ever there (any type but JSON null); with each_path there is a
    row for each candidate that was. Uplinks count whether decoded or not.
    """
    f = presence(paths, hours, recent_hours, scope, up, as_of)
    return presence_of(one(folded(up, as_of, [f]), 0, f), paths, each_path)
