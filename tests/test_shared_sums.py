"""Fused scans, stored partial sums and the silence stream: the same rows as each check or window by itself, from fewer uplinks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.golden import AS_OF, Store, eui
from tidewatch.operators import folds
from tidewatch.operators import resolvers as R
from tidewatch.operators.scope import Scope
from tidewatch.plans import config as C
from tidewatch.plans import planner
from tidewatch.plans.checks import CHECKS, Context
from tidewatch.plans.runner import run_pass
from tidewatch.sources.partials import HOUR, Partials
from tidewatch.sources.state import StateStore
from tidewatch.streaming import silence as S

PATHS = [("a",), ("b", "c")]


def fleet(seed=1, n=900):
    """Devices with gaps, renamed ones, odd payloads, equal times, and one that sends a third of all rows."""
    rng, s = random.Random(seed), Store()
    for _ in range(n):
        tail = "1" if rng.random() < 0.34 else f"{rng.randrange(2, 24):x}"
        body = rng.choice([{"a": rng.randrange(5)}, {"b.c": rng.randrange(300) / 10}, {"a": "x", "b.c": 2}, {}, None, "null", "no json", {"a": 1.25}])
        minutes = rng.choice((rng.randrange(0, 3000), rng.randrange(0, 50) * 60))
        name = rng.choice([f"n{tail}", f"n{tail}", f"m{tail}", None])
        s.up(tail, name, 1, 0, body, start=minutes, profile=rng.choice("pq"), rssi=rng.randrange(-125, -60), snr=rng.choice([1.5, None]))
    for i in range(12):
        s.add("event_join", f"{i % 5 + 1:x}", "j", i * 40, dev_addr=f"{i % 3}")
    return s


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def counted(df):
    """df, and a function that tells how many of its rows were read since."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return df.mapInArrow(each, df.schema), lambda: n.value


CONFIG = [
    {"rule": "device-silent", "params": {"silentMinutes": 300, "minUplinks": 3}},
    {"rule": "device-silent", "as": "silent-scoped", "params": {"silentMinutes": 200, "inventoryHours": 24, "minUplinks": 1, "deviceNamePattern": "n%", "deviceProfiles": ["q"]}},
    {"rule": "decode-failure", "params": {"lookbackHours": 40, "minFailures": 2, "minFailureRatio": 0.2}},
    {"rule": "signal-degraded", "params": {"lookbackHours": 30, "rssiThresholdDbm": -90, "snrThresholdDb": 1, "minUplinks": 2}},
    {"rule": "measurement-missing", "params": {"paths": ["a", "b.c"], "lookbackHours": 50, "recentHours": 6, "minRecentUplinks": 1, "minHistoricalSightings": 1}},
    {"rule": "join-churn", "params": {"lookbackHours": 20, "maxJoins": 1}},
    {"rule": "measurement-peak", "params": {"paths": ["b.c", "a"], "threshold": 3, "lookbackHours": 20, "minSamples": 1}},
    {"rule": "measurement-stuck", "params": {"paths": ["a"], "lookbackHours": 30, "minSamples": 2, "decimals": 0, "maxDistinctValues": 2}},
    {"rule": "counter-stalled", "params": {"paths": ["a"], "lookbackHours": 31, "minSamples": 2}},
    {"rule": "measurement-threshold", "params": {"paths": ["a"], "lookbackHours": 40, "max": 1}},
    {"rule": "boolean-alarm", "params": {"paths": ["a"], "lookbackHours": 10, "trueValues": ["1"]}},
    {"rule": "measurement-rate", "as": "wrong", "params": {"paths": [], "lookbackHours": 5}},
]


def a_pass(spark, folder, tables, **more):
    s = run_pass(spark, C.parse({"checks": CONFIG}, {}), CHECKS, tables, StateStore(spark, str(folder)), AS_OF, **more)
    return {o.kind: (o.status, o.findings) for o in s.outcomes}


def test_a_pass_scans_uplinks_twice(spark, tmp_path):
    tables = fleet().tables(spark)
    alone = a_pass(spark, tmp_path / "alone", tables, fuse=False)
    total = tables["event_up"].count()
    up, read = counted(tables["event_up"])
    fused = a_pass(spark, tmp_path / "fused", {**tables, "event_up": up})
    assert fused == alone and fused["wrong"][0] == "error"
    assert sum(n > 0 for status, n in fused.values() if status == "ok") >= 9
    assert read() <= 2 * total


def test_a_pass_over_partial_sums(spark, tmp_path):
    tables = fleet().tables(spark)
    sums = Partials(spark, str(tmp_path / "sums"), PATHS)
    sums.append(tables["event_up"], 0)
    assert a_pass(spark, tmp_path / "sums-pass", tables, partials=sums) == a_pass(spark, tmp_path / "alone", tables, fuse=False)


def test_each_fold_by_itself(spark):
    up = fleet(2).tables(spark)["event_up"]
    some = [
        folds.Fold(24, Scope(["p"]), values={"last": ("max", lambda c: F.col("time"))}),
        folds.Fold(5, Scope([], "n%"), newest=("object",)),
        R.presence(PATHS, 40, 3, Scope(), up, AS_OF),
    ]
    together = folds.folded(up, AS_OF, some)
    for i, f in enumerate(some):
        assert rows(folds.one(together, i, f)) == rows(folds.one(folds.folded(up, AS_OF, [f]), 0, f))
    newest = folds.newest_of(folds.one(together, 1, some[1]), "object")
    assert rows(newest) == rows(R.newest_decoded(up, 5, Scope([], "n%"), AS_OF))


def test_a_planner_shares_what_it_can(spark):
    tables = fleet().tables(spark)
    known = [(c, CHECKS[c.rule]) for c in C.parse({"checks": CONFIG}, {}).enabled]
    shared = planner.shared(tables, known, AS_OF)
    assert shared.folded("wrong") is None and shared.folded("device-silent") is not None
    assert shared.newest(Scope(["p"])) is None and shared.newest(Scope()) is not None
    assert planner.shared(tables, [known[-1]], AS_OF) is None
    planner.release(shared)


# -- Stored partial sums ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Sums of four batches: two halves, late rows of the same hours, and one that is written twice."""
    up = fleet(7, 1500).tables(spark)["event_up"]
    sums = Partials(spark, str(tmp_path_factory.mktemp("sums")), PATHS)
    part = F.pmod(F.xxhash64("deduplication_id"), F.lit(4))
    for b in (0, 1, 2, 3, 3):
        sums.append(up.filter(part == b), b)
    return up, sums


@pytest.mark.parametrize("hours, as_of", [(48, AS_OF), (30.3, "2024-06-01 11:17:03"), (0.5, AS_OF), (1.2, "2024-06-01 09:59:59"), (1, "2024-06-01 08:00:00"), (2000, "2024-06-03 00:30:00")])
@pytest.mark.parametrize("scope, decimals", [(Scope(), None), (Scope(["p"], "n%"), 0)])
def test_partial_sums_make_any_window(store, hours, as_of, scope, decimals):
    up, sums = store
    for paths in (PATHS, PATHS[::-1]):
        want = R.window_stats(up, paths, hours, scope, as_of, decimals)
        assert rows(sums.stats(up, paths, hours, scope, as_of, decimals)) == rows(want)
        if decimals is None:
            assert rows(sums.stats(up, paths, hours, scope, as_of, distinct=False).drop("distinct_values")) == rows(want.drop("distinct_values"))


def test_only_the_edges_are_read(spark, store):
    """Uplinks of all whole hours are taken away: nothing changes."""
    up, sums = store
    as_of, hours = "2024-06-01 11:17:03", 30.3
    micros = F.unix_micros("time")
    end = 1717240623 * 1_000_000
    first, last = -(-(end - int(hours * HOUR)) // HOUR), end // HOUR
    edges = up.filter((micros <= first * HOUR) | (micros > last * HOUR))
    assert edges.count() < up.count()
    want = rows(R.window_stats(up, PATHS, hours, Scope(), as_of))
    assert want and rows(sums.stats(edges, PATHS, hours, Scope(), as_of)) == want


def test_edges_are_pushed_down(spark, store, tmp_path):
    up, sums = store
    up.write.parquet(str(tmp_path / "up"))
    df = sums.stats(spark.read.schema(up.schema).parquet(str(tmp_path / "up")), PATHS, 30.3, Scope(), "2024-06-01 11:17:03")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    pushed = next(x for x in plan.split("\n\n") if f"{tmp_path}/up" in x and "PushedFilters" in x)
    assert "Or(LessThanOrEqual(time" in pushed and pushed.count("GreaterThan(time") == 2


def test_unknown_paths(store):
    up, sums = store
    with pytest.raises(LookupError):
        sums.stats(up, [("z",)], 5, Scope(), AS_OF)
    assert sums.has(PATHS) and not sums.has([("z",)])


# -- Silence as a stream ---------------------------------------------------------------------------


def replay(spark, folder, batches, **params):
    """After each trigger: the clock and the devices in alert. The query is started anew from its checkpoint for each batch, and once more without a new one."""
    spark.conf.set(*S.PROVIDER)
    schema, out, seen = batches[0].schema, [], None
    for b in [*batches, None]:
        if b is not None:
            b.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            seen = b if seen is None else seen.union(b)
        events = S.silence(spark.readStream.schema(schema).parquet(f"{folder}/in"), **params)
        q = events.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination(300)
        clock = [p["eventTime"]["watermark"] for p in q.recentProgress if "watermark" in p["eventTime"]]
        if b is None and clock:
            assert clock[-1][:19] == out[-1][0].replace(" ", "T")
        found = S.in_alert(spark.read.schema(S.EVENTS).parquet(f"{folder}/out"))
        out.append((clock[-1][:19].replace("T", " ") if clock else out[-1][0], found.collect(), seen))
    return out


def test_silence_stream_is_the_check_at_each_trigger(spark, tmp_path):
    """Devices fall silent, come back, are forgotten; rows come out of order, some late; one device sends most of the rows."""
    rng, s, end = random.Random(4), Store(), datetime(2024, 6, 1, 12)
    for day in range(8):
        for i in range(9):
            if (day + i) % 4 or i == 0:
                for _ in range(60 if i == 0 else 4):
                    s.up(f"{i:x}", f"n{i}-{day // 3}", 1, 0, None, start=(8 - day) * 1440 - rng.randrange(0, 700))
    up = s.tables(spark)["event_up"]
    # The last batch holds rows of the sixth day too, late by less than the watermark's delay.
    day_of = lambda t: (t - (end - timedelta(days=8))) // timedelta(days=1)
    picked = [[r for r in up.collect() if day_of(r["time"]) in days and (r["deduplication_id"] < "u000005") == early] for days, early in (((0, 1), True), ((0, 1), False), ((2, 3), False), ((4,), False), ((5, 6, 7), False))]
    batches = [spark.createDataFrame(rng.sample(p, len(p)), up.schema) for p in picked if p]
    params = {"silentMinutes": 600, "inventoryHours": 60, "minUplinks": 4}
    steps = replay(spark, str(tmp_path), batches, silent_minutes=600, inventory_hours=60, min_uplinks=4, late="26 hours")
    sets = []
    for clock, found, seen in steps:
        want = {(r["dev_eui"], r["device_name"]): r["detail"]["lastSeen"] for r in CHECKS["device-silent"].run(Context({"event_up": seen}, params, clock)).collect()}
        assert {(r["dev_eui"], r["device_name"]): r["last_seen"] for r in found} == want
        sets.append({r["dev_eui"] for r in found})
    assert len({frozenset(x) for x in sets}) >= 3 and any(a - b for a, b in zip(sets, sets[1:]))  # raised, and cleared


def test_silence_stream_counts_late_rows(spark, tmp_path):
    at = lambda *minutes: [(eui("1"), "n", datetime(2024, 6, 1) + timedelta(minutes=m)) for m in minutes]
    other = [(eui("2"), None, datetime(2024, 6, 1) + timedelta(minutes=m)) for m in (0, 500, 590, 600)]
    schema = "dev_eui string, device_name string, time timestamp"
    batches = [spark.createDataFrame(x, schema) for x in (at(0, 10, 20) + other[:2], at(450), [*other[2:], (None, "x", datetime(2024, 6, 1)), (eui("3"), "x", None)])]
    steps = replay(spark, str(tmp_path), batches, silent_minutes=200, inventory_hours=24, min_uplinks=3, late="1 hour")
    assert [sorted(r["dev_eui"][-1] for r in found) for _, found, _ in steps] == [["1"], ["1"], [], []]
    assert steps[0][1][0]["last_seen"] == datetime(2024, 6, 1, 0, 20)


def test_thin_keeps_what_can_matter():
    import pandas as pd

    df = pd.DataFrame({"dev_eui": "1", "device_name": [None, "a"] * 50, "micros": range(1, 101)})
    assert sorted(next(S._newest_few(3)(iter([df]))).micros) == list(range(95, 101))  # three of each name in the one second


def test_silence_asks_little_of_its_state():
    """A device's turn reads its state once, writes it once and sets one timer: each is a call to the executor."""
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from tidewatch.streaming.silence import Silence

    handle, processor = MagicMock(), Silence(10**9, 10**10, 1)
    handle.getValueState.return_value.get.return_value = None
    processor.init(handle)
    made = len(handle.mock_calls)
    list(processor.handleInputRows(("d",), iter([{"micros": 5 * 10**6, "device_name": "n"}]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 6000)))
    assert len(handle.mock_calls) - made <= 3
