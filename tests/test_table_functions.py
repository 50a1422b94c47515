"""SQL table functions give the resolvers' rows, and their windows reach the scan; fleets made in Spark give the findings they plant."""

import pytest

from tests.golden import AS_OF, Store
from tests.test_shared_sums import PATHS, fleet, rows
from tidewatch.functions import table_functions as TF
from tidewatch.operators import resolvers as R
from tidewatch.operators.scope import Scope
from tidewatch.plans import config as C
from tidewatch.plans.checks import CHECKS, Context
from tidewatch.plans.runner import run_pass
from tidewatch.sources.fleet import FAULTS, Fleet
from tidewatch.sources.state import StateStore

AT, NAMES = f"TIMESTAMP'{AS_OF}'", "array('a', 'b.c')"
SCOPED = Scope(["p"], "n%")
CALLS = {
    f"latest_readings({NAMES}, {AT}, 30)": lambda up: R.latest_readings(up, PATHS, 30, Scope(), AS_OF),
    f"latest_readings({NAMES}, {AT}, 7.5, array('p'), 'n%')": lambda up: R.latest_readings(up, PATHS, 7.5, SCOPED, AS_OF),
    f"latest_flags({NAMES}, array('X', '2'), {AT}, 30)": lambda up: R.latest_flags(up, PATHS, 30, Scope(), ["X", "2"], AS_OF),
    f"latest_fixes(array('a'), {NAMES}, {AT})": lambda up: R.latest_fixes(up, PATHS[:1], PATHS, 24, Scope(), AS_OF),
    f"window_stats({NAMES}, {AT}, 40, array('p'), 'n%')": lambda up: R.window_stats(up, PATHS, 40, SCOPED, AS_OF).drop("mean"),
    f"path_presence(array('z', 'b.c', 'a'), 3, {AT}, 40)": lambda up: R.path_presence(up, [("z",), *PATHS[::-1]], 40, 3, Scope(), AS_OF),
    f"event_window({AT}, 5)": lambda up: R.window(up, AS_OF, 5).select("dev_eui", "device_name", "time", "deduplication_id", "object"),
}


@pytest.mark.parametrize("call", list(CALLS))
def test_functions_are_the_resolvers(spark, call):
    tables = fleet(9).tables(spark)
    TF.register(spark, tables)
    got, want = spark.sql(f"SELECT * FROM {call}"), CALLS[call](tables["event_up"])
    assert got.columns == want.columns and rows(got) == rows(want) and got.count()


def test_windows_reach_the_scan(spark, tmp_path):
    up = fleet(9).tables(spark)["event_up"]
    up.write.parquet(str(tmp_path / "up"))
    TF.register(spark, {"event_up": spark.read.parquet(str(tmp_path / "up"))})
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for call in CALLS:
        plan = spark.sql(f"SELECT * FROM {call}")._jdf.queryExecution().explainString(mode)
        pushed = [x for x in plan.splitlines() if x.startswith("PushedFilters")]
        assert pushed and all("GreaterThan(time" in x and "LessThanOrEqual(time" in x for x in pushed), call


def test_payloads_are_parsed_once_and_paths_are_literals(spark):
    TF.register(spark, fleet(9).tables(spark))
    for call in CALLS:
        if call.startswith(("window_stats", "path_presence")):
            plan = spark.sql(f"SELECT * FROM {call}")._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("parseJson") == 1 and "lambda" not in plan, call


def test_more_paths_than_are_unrolled(spark):
    tables = fleet(9).tables(spark)
    TF.register(spark, tables)
    names = [f"none{i}" for i in range(TF.UNROLLED + 1)] + ["a", "b.c"]
    got = spark.sql(f"SELECT * FROM window_stats(array({str(names)[1:-1]}), {AT}, 40)")
    want = R.window_stats(tables["event_up"], [tuple(n.split(".")) for n in names], 40, Scope(), AS_OF).drop("mean")
    assert rows(got) == rows(want) and got.count()


def test_numbers_in_paths(spark):
    s = Store()
    s.up("1", "n", 1, 5, '{"list": [4, 5], "map": {"1": 6}}')
    TF.register(spark, s.tables(spark))
    for path in ("list.1", "map.1"):
        got = spark.sql(f"SELECT value FROM latest_readings(array('{path}'), {AT})").first()["value"]
        assert got == {"list.1": 5.0, "map.1": 6.0}[path]


def test_a_fleet_gives_its_findings(spark, tmp_path):
    """A third of 900,000 rows are one device's; every planted fault is found and nothing else, by a fused pass and alone."""
    f = Fleet(devices=2000, steps=300, hot_share=1 / 3)
    up = f.uplinks(spark)
    assert up.count() == f.rows and up.select("deduplication_id").distinct().count() == f.rows
    assert up.filter("dev_eui = '0000000000000000'").count() == f.steps + f.more
    tables = {**Store().tables(spark), "event_up": up}
    config = C.parse({"checks": [c for c, _ in f.checks()], "statementTimeoutMs": 600_000}, {})
    s = run_pass(spark, config, CHECKS, tables, StateStore(spark, str(tmp_path)), f.end)
    assert {o.kind: (o.status, o.findings) for o in s.outcomes} == {c["rule"]: ("ok", n) for c, n in f.checks()}


def test_counts_of_a_fleet():
    f = Fleet(devices=23, steps=20)
    for fault in set(FAULTS):
        assert f.of(fault) == sum(FAULTS[d % len(FAULTS)] == fault for d in range(23))
    assert Fleet(10**6, 100).rows == 10**8 - 10**5 * 12


def test_counters_across_resets(spark, tmp_path):
    """A counter that fell inside the window and passed its first reading again."""
    s = Store()
    values = {"1": [5, 90, 2, 40], "2": [5, 6, 7, 40], "3": [9, 9, 9, 9]}
    for tail, v in values.items():
        s.up(tail, "n", 4, 60, lambda g, v=v: {"total": v[4 - g]})
    tables = s.tables(spark)
    params = {"paths": ["total"], "lookbackHours": 12, "minSamples": 2, "minAdvance": 1}
    reason = lambda **more: {r["dev_eui"][-1]: r["detail"]["reason"] for r in CHECKS["counter-stalled"].run(Context(tables, {**params, **more}, AS_OF)).collect()}
    assert reason() == {"3": "stalled"} and reason(acrossResets=True) == {"1": "decrease", "3": "stalled"}
    spike = lambda **more: {r["dev_eui"][-1]: r["detail"]["advance"] for r in CHECKS["counter-spike"].run(Context(tables, {**params, "maxRatePerHour": 20, **more}, AS_OF)).collect()}
    assert spike() == {} and spike(acrossResets=True) == {"1": 85 + 2 + 38}
