"""Small stores in which each rule of the resolvers makes a difference."""

import random

import pytest
from pyspark.sql import functions as F

from tests.golden import AS_OF, Store, eui
from tidewatch.operators import resolvers as R
from tidewatch.operators.scope import Scope
from tidewatch.plans.checks import CHECKS, Context


def by_device(df):
    return {r["dev_eui"][-1]: r for r in df.collect()}


def latest(spark, s, paths, hours=24, scope=None):
    return by_device(R.latest_readings(s.tables(spark)["event_up"], paths, hours, scope or Scope(), AS_OF))


def test_candidates_in_order(spark):
    s = Store()
    s.up("1", "n", 1, 5, {"a": 1, "b.c": 2})
    s.up("2", "n", 1, 5, {"b.c": 3})
    s.up("3", "n", 1, 5, {"z": 3})
    got = latest(spark, s, [("a",), ("b", "c")])
    assert (got["1"]["value"], got["1"]["matched_path"], got["2"]["value"]) == (1, "a", 3) and "3" not in got
    assert latest(spark, s, [("b", "c"), ("a",)])["1"]["value"] == 2


def test_newest_and_window(spark):
    s = Store()
    for minutes, v in ((90, 1), (5, 2), (45, 3)):
        s.up("1", "n", 1, 0, {"a": v}, start=minutes)
    s.up("2", "n", 1, 30 * 60, {"a": 9})
    s.up("3", "n", 1, 10, {"b": 1})
    s.up("3", "n", 1, 20, {"a": 1})
    s.up("4", "n", 1, -5, {"a": 1})
    got = latest(spark, s, [("a",)])
    assert got["1"]["value"] == 2 and set(got) == {"1"}
    assert set(latest(spark, s, [("a",)], 48)) == {"1", "2"}


def test_numbers(spark):
    s = Store()
    bodies = ["3.7V", "unknown", True, {"x": 1}, None, 21.5, "21.5", "-3", "+5", ".5", "5.", "1e3", " 5 ", "5\n", [1]]
    for i, v in enumerate(bodies):
        s.up(f"{i:x}", "n", 1, 5, {"t": v})
    s.up("f1", "n", 1, 5, '{"t": 12345678.5}')
    s.up("f2", "n", 1, 5, '{"t": 0.0005}')
    s.up("f3", "n", 1, 5, '{"t": 1e-3}')
    got = {r["dev_eui"].lstrip("0"): r["value"] for r in R.latest_readings(s.tables(spark)["event_up"], [("t",)], 24, Scope(), AS_OF).collect()}
    assert got == {"5": 21.5, "6": 21.5, "7": -3.0, "f1": 12345678.5, "f2": 0.0005, "f3": 0.001}


def test_window_statistics(spark):
    s = Store()
    for minutes, v in ((100, 70), (10, 50), (190, 90)):
        s.up("1", "n", 1, 0, {"a": v}, start=minutes)
    s.up("2", "n", 3, 10, {"b": 1})
    s.up("2", "n", 1, 50, {"a": 7, "b": 100})
    for i, v in enumerate((30.001, 30.002, 30.0031, 30.0009)):
        s.up("3", f"n{i}", 1, 10 + i, {"a": v})
    up = s.tables(spark)["event_up"]
    got = by_device(R.window_stats(up, [("a",), ("b",)], 24, Scope(), AS_OF))
    assert (got["1"]["vfirst"], got["1"]["vlast"], got["1"]["vavg"]) == (90, 50, 70)
    assert (got["2"]["matched_path"], got["2"]["samples"]) == ("a", 1)
    assert got["3"]["distinct_values"] == 4 and got["3"]["device_name"] == "n3"
    assert by_device(R.window_stats(up, [("a",)], 24, Scope(), AS_OF, 1))["3"]["distinct_values"] == 1


def test_flags(spark):
    s = Store()
    for i, v in enumerate((True, False, "TRUE", 1, 0, "open")):
        s.up(str(i), "n", 1, 5, {"f": v, "g": True})
    got = by_device(R.latest_flags(s.tables(spark)["event_up"], [("f",), ("g",)], 24, Scope(), ["true", "1"], AS_OF))
    assert [got[str(i)]["value"] for i in range(6)] == [True, False, True, True, False, False]


def test_presence_and_fixes(spark):
    s = Store()
    s.up("1", "n", 20, 60, {"soil": 1}, start=20 * 60)
    s.up("1", "n", 6, 30, None)
    s.up("2", "n", 6, 30, {"soil": 1})
    s.up("3", "n", 1, 5, {"lat": 1.5, "lon": 2})
    s.up("4", "n", 1, 5, {"lat": 1.5})
    up = s.tables(spark)["event_up"]
    got = by_device(R.path_presence(up, [("soil",)], 168, 12, Scope(), AS_OF))
    assert tuple(got["1"][k] for k in ("ever_seen", "recent_seen", "recent_uplinks")) == (20, 0, 6) and set(got) == {"1", "2"}
    assert set(by_device(R.latest_fixes(up, [("lat",)], [("lon",)], 24, Scope(), AS_OF))) == {"3"}


def test_scope(spark):
    s = Store()
    s.up("1", "pump-1", 1, 5, {"a": 1}, profile="p1")
    s.up("2", "pump-2", 1, 5, {"a": 1}, profile="p2")
    s.up("3", None, 1, 5, {"a": 1}, profile=None)
    names = lambda **k: set(latest(spark, s, [("a",)], scope=Scope(**k)))
    assert names() == {"1", "2", "3"} and names(profiles=["p1"]) == {"1"} and names(name_like="pump%") == {"1", "2"}
    assert names(profiles=["p2"], name_like="%1") == set()


def test_odd_keys(spark):
    s = Store()
    s.up("1", "n", 1, 5, '{"a\'b": {"c.d": 4}, "list": [7, 8], "map": {"0": 9}}')
    assert latest(spark, s, [("a'b", "c.d")])["1"]["value"] == 4
    assert latest(spark, s, [("list", "1")])["1"]["value"] == 8 and latest(spark, s, [("map", "0")])["1"]["value"] == 9


def test_row_order_never_matters(spark):
    s, rng = Store(), random.Random(4)
    for i in range(60):
        s.up(str(i % 4), f"n{i}", 1, 10 * (i % 9), {"a": rng.choice((1, 2, 3)), "b": i})
    up = s.tables(spark)["event_up"].persist()
    for k in range(3):
        other = up.orderBy(F.rand(k)).repartition(3 + k)
        for make in (lambda d: R.window_stats(d, [("c",), ("a",)], 24, Scope(), AS_OF), lambda d: R.latest_readings(d, [("b",)], 24, Scope(), AS_OF)):
            assert sorted(map(str, make(up).collect())) == sorted(map(str, make(other).collect()))


def test_pushdown(spark, tmp_path):
    s = Store()
    s.up("1", "n", 5, 5, {"a": 1})
    s.tables(spark)["event_up"].write.parquet(str(tmp_path / "up"))
    found = CHECKS["device-silent"].run(Context({"event_up": spark.read.parquet(str(tmp_path / "up"))}, {}, AS_OF))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(time" in plan and "object" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("bad", [{"raiseAtVolts": 4, "clearAtVolts": 3}, {"criticalAtVolts": 9}, {"raiseAtVolts": "x"}, {"paths": []}])
def test_bad_parameters(spark, bad):
    with pytest.raises(ValueError):
        CHECKS["battery-low"].run(Context(Store().tables(spark), bad, AS_OF))


def test_hysteresis(spark):
    s = Store()
    for tail, v in (("1", 3.5), ("2", 3.5), ("3", 3.3), ("4", 3.15)):
        s.up(tail, "n", 1, 5, {"battery": v})
    opened = spark.createDataFrame([(eui("1"),), (eui("3"),)], "dev_eui string")
    got = by_device(CHECKS["battery-low"].run(Context(s.tables(spark), {}, AS_OF, "k", opened)))
    assert {k: r["severity"] for k, r in got.items()} == {"1": "warning", "3": "warning", "4": "critical"}
