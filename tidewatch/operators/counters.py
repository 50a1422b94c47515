"""Counters between neighbouring readings: what they advanced, and where they were reset, inside a window.

First and last reading don't show a counter that started again in between. Readings are sorted in range partitions of
(device, candidate, time, id), so a device with any share of the rows lies in many of them. Each partition compares
neighbours and gives one row for each device and candidate it holds: the sums, and its first and last reading. These
edges, a row for each partition that a device reaches into, are compared once more in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolvers import Paths

#: Readings are compared as whole numbers of this many parts.
UNITS = 1_000_000
_RUNS = "dev_eui string, ord int, at timestamp, id string, first bigint, last bigint, readings bigint, resets bigint, advance bigint"


def _runs(batches):
    """A row for each run of one device and candidate of a sorted partition; a run goes on over batches."""
    held = None
    for b in batches:
        dev, order, num = b.column("dev_eui"), b.column("ord").to_numpy(), b.column("units").to_numpy()
        n = len(num)
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(dev.slice(1), dev.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (order[1:] != order[:-1])
        step = np.zeros(n, np.int64)
        step[1:] = num[1:] - num[:-1]
        fell = (step < 0) & ~new
        start = np.flatnonzero(new)
        end = np.append(start[1:], n) - 1
        sums = [np.add.reduceat(x, start) for x in (fell.astype(np.int64), np.where(new, 0, np.where(fell, num, step)))]
        rows = [list(x) for x in zip(dev.take(pa.array(start)).to_pylist(), order[start].tolist(), start.tolist(), num[start].tolist(), num[end].tolist(), (end - start + 1).tolist(), *[s.tolist() for s in sums])]
        for r in rows:
            r[2:3] = [b.column("time")[r[2]].as_py(), b.column("id")[r[2]].as_py()]
        if held is not None and held[:2] == rows[0][:2]:
            gap = rows[0][4] - held[5]
            held = [*held[:5], rows[0][5], held[6] + rows[0][6], held[7] + rows[0][7] + (gap < 0), held[8] + rows[0][8] + (rows[0][4] if gap < 0 else gap)]
            rows[0] = held
        elif held is not None:
            rows.insert(0, held)
        held = rows.pop()
        yield _batch(rows)
    if held is not None:
        yield _batch([held])


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.timestamp("us", "UTC"), pa.string(), *[pa.int64()] * 5]
    names = ["dev_eui", "ord", "at", "id", "first", "last", "readings", "resets", "advance"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def advances(readings: DataFrame, paths: Paths) -> DataFrame:
    """dev_eui, matched_path, readings, resets, advance of each device's winning candidate, as in resolvers.stats_of.

    readings: dev_eui, time, deduplication_id, ord, num. A reading below the one before it is a reset: the counter began again at 0,
    so the reading itself is the advance. Readings are rounded to UNITS. Equal times go by id.
    """
    units = F.round(F.col("num") * UNITS).try_cast("bigint")
    rows = readings.select("dev_eui", "ord", F.col("time").cast("timestamp").alias("time"), F.col("deduplication_id").alias("id"), units.alias("units"))
    order = ["dev_eui", "ord", "time", "id"]
    runs = rows.filter("units is not null").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, _RUNS)
    before = Window.partitionBy("dev_eui", "ord").orderBy("at", "id")  # over a row for each partition that a device reaches into
    runs = runs.withColumn("gap", F.col("first") - F.lag("last").over(before))
    total = runs.groupBy("dev_eui", "ord").agg(
        F.sum("readings").alias("readings"),
        (F.sum("resets") + F.count_if(F.col("gap") < 0)).alias("resets"),
        (F.sum("advance") + F.coalesce(F.sum(F.when(F.col("gap") < 0, F.col("first")).otherwise(F.col("gap"))), F.lit(0))).alias("units"),
    )
    won = total.withColumn("_first", F.min("ord").over(Window.partitionBy("dev_eui"))).filter("ord = _first")
    name = F.element_at(F.array(*[F.lit(".".join(p)) for p in paths]), F.col("ord") + 1)
    return won.select("dev_eui", name.alias("matched_path"), "readings", "resets", (F.col("units") / UNITS).alias("advance"))
