"""Counters compared neighbour by neighbour, against a loop; a device with a third of the rows lies in many partitions."""

import random
from datetime import datetime, timedelta

import pytest

from tidewatch.operators import counters

PATHS = [("a",), ("b", "c")]
SCHEMA = "dev_eui string, device_name string, time timestamp, deduplication_id string, ord int, num decimal(38,12)"


def brute(rows):
    out = {}
    for dev in {r[0] for r in rows}:
        order = min(r[4] for r in rows if r[0] == dev)
        values = [r[5] for r in sorted((r for r in rows if r[0] == dev and r[4] == order), key=lambda r: (r[2], r[3]))]
        steps = list(zip(values, values[1:]))
        out[dev] = (".".join(PATHS[order]), len(values), sum(b < a for a, b in steps), float(sum(b if b < a else b - a for a, b in steps)))
    return out


def made(seed, n=3000):
    from decimal import Decimal

    rng, rows, value = random.Random(seed), [], {}
    for i in range(n):
        dev = "hot" if rng.random() < 0.4 else f"d{rng.randrange(30)}"
        order = rng.randrange(2) if dev != "d3" else 1
        v = value.get((dev, order), Decimal(rng.randrange(50))) + Decimal(rng.randrange(0, 500)) / 100
        v = Decimal(rng.randrange(3)) if rng.random() < 0.05 else v
        value[dev, order] = v
        # Equal times, in the order of ids.
        rows.append((dev, None, datetime(2024, 1, 1) + timedelta(seconds=i // 3), f"{i:06d}", order, v))
    return rows


@pytest.mark.parametrize("partitions, batch", [(1, 10_000), (16, 7), (64, 100)])
def test_against_a_loop(spark, partitions, batch):
    rows = made(partitions)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
        got = {r["dev_eui"]: (r["matched_path"], r["readings"], r["resets"], round(r["advance"], 6)) for r in counters.advances(df, PATHS).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {k: (*v[:3], round(v[3], 6)) for k, v in brute(rows).items()}
    assert got == want and want["hot"][2] > 10


def test_few_readings(spark):
    rows = [("one", None, datetime(2024, 1, 1), "x", 0, 5), ("none", None, datetime(2024, 1, 1), "y", 0, None)]
    from decimal import Decimal

    rows = [(*r[:5], None if r[5] is None else Decimal(r[5])) for r in rows]
    got = [tuple(r) for r in counters.advances(spark.createDataFrame(rows, SCHEMA), PATHS).collect()]
    assert got == [("one", "a", 1, 0, 0.0)]
    assert counters.advances(spark.createDataFrame([], SCHEMA), PATHS).count() == 0
