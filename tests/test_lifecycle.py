import json
import os
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.golden import AS_OF, Store, eui
from tidewatch.operators import findings as FF
from tidewatch.operators import reconcile as RC
from tidewatch.plans import config as C
from tidewatch.plans import registry
from tidewatch.plans.checks.base import Check
from tidewatch.plans.runner import run_pass
from tidewatch.sources.state import StateStore

T1, T2, T3 = "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"


def found(spark, *rows):
    """(kind, dev, severity, summary[, ordinal])"""
    return spark.createDataFrame([(r[0], "rule", r[4] if len(r) > 4 else 0, r[1], None, r[2], r[3], "{}") for r in rows], FF.SCHEMA)


def empty(spark):
    return spark.createDataFrame([], RC.STATE)


def test_raise_touch_resolve_and_again(spark):
    a = RC.reconcile(empty(spark), found(spark, ("k", "1", "info", "x"), ("other", "1", "info", "y")), T1, ["k", "other"]).state.cache()
    b = RC.reconcile(a, found(spark, ("k", "1", "critical", "z")), T2, ["k"])
    row = b.state.filter("kind = 'k'").first()
    assert (row["severity"], row["summary"], str(row["raised_at"]), str(row["last_seen_at"])) == ("critical", "z", T1, T2)
    assert b.state.filter("kind = 'other' and resolved_at is null").count() == 1 and b.raised.count() == 0
    c = RC.reconcile(b.state, found(spark), T3, ["k"]).state
    assert c.filter(f"kind = 'k' and resolved_at = timestamp '{T3}'").count() == 1
    d = RC.reconcile(c, found(spark, ("k", "1", "info", "w")), "2024-01-04 00:00:00", ["k"]).state
    assert d.filter("kind = 'k'").count() == 2 and d.select("id").distinct().count() == 3
    assert RC.orphans(d, ["k"]).count() == 1


def test_duplicates_in_one_list(spark):
    r = RC.reconcile(empty(spark), found(spark, ("k", "1", "info", "first", 0), ("k", "1", "critical", "last", 1)), T1, ["k"])
    assert [x["summary"] for x in r.state.collect()] == ["last"] and r.raised.first()["announced"]["summary"] == "first"
    assert tuple(r.counts.first()[c] for c in ("findings", "raised", "touched", "resolved")) == (2, 1, 1, 0)


def test_notified_is_stamped_once(spark):
    a = RC.reconcile(empty(spark), found(spark, ("k", "1", "info", "x"), ("k", "2", "info", "x")), T1, ["k"]).state
    ids = a.filter("dev_eui = '1'").select("id")
    b = RC.mark_notified(RC.mark_notified(a, ids, T1), a.select("id"), T2)
    assert {r["dev_eui"]: str(r["notified_at"]) for r in b.collect()} == {"1": T1, "2": T2}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("123"), st.sampled_from(["info", "critical"])), max_size=5), min_size=1, max_size=3))
def test_invariants(spark, passes):
    """One open row for each key at most; a pass repeated changes nothing but times; open rows are the last findings."""
    state = empty(spark)
    for i, rows in enumerate(passes):
        rows = [(*r, "s", n) for n, r in enumerate(rows)]
        state = RC.reconcile(state, found(spark, *rows), f"2024-01-0{i + 1} 00:00:00", ["a", "b"]).state
    opened = [(r["kind"], r["dev_eui"]) for r in state.filter("resolved_at is null").collect()]
    assert len(opened) == len(set(opened)) and set(opened) == {(r[0], r[1]) for r in passes[-1]}


def canned(rows=(), fail=None):
    def find(ctx):
        if fail:
            raise fail
        spark = ctx.table("event_up").sparkSession
        return spark.createDataFrame(list(rows), "dev_eui string, device_name string, severity string, summary string").withColumn("detail", F.struct(F.lit(1).alias("n")))

    return find


def check(id, find):
    return Check(id, "d", "warning", {}, {"event_up": ("time",)}, find)


def run(spark, store, checks, raw=None, **more):
    config = C.parse({"checks": raw or [{"rule": c} for c in checks], "statementTimeoutMs": 300_000}, {})
    return run_pass(spark, config, {k: check(k, f) for k, f in checks.items()}, Store().tables(spark), store, AS_OF, **more)


def test_failing_check_resolves_nothing(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    row = ("1", None, None, "x")
    run(spark, store, {"a": canned([row]), "b": canned([row])})
    s = run(spark, store, {"a": canned(fail=RuntimeError("boom")), "b": canned()})
    assert {(r["kind"]) for r in store.read().filter("resolved_at is null").collect()} == {"a"}
    assert [(o.kind, o.error) for o in s.errors] == [("a", "boom")] and s.resolved == 1
    assert store.ledger().filter("status = 'error' and error = 'boom'").count() == 1


def late(ctx):
    """Fails only when its rows are made."""
    return canned([("1", None, None, "x")])(ctx).withColumn("summary", F.raise_error(F.lit("at run time")))


def test_failure_at_run_time_is_isolated(spark, tmp_path):
    s = run(spark, StateStore(spark, str(tmp_path)), {"a": late, "b": canned([("1", None, None, "x")])})
    assert [o.kind for o in s.errors] == ["a"] and s.raised == 1


def test_unknown_disabled_junk_and_dry_run(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    rows = [("1", None, None, "x"), ("", None, None, "x"), (None, None, None, "x"), ("2", None, None, "")]
    raw = [{"rule": "nope"}, {"rule": "a", "enabled": False, "as": "off"}, {"rule": "a"}]
    s = run(spark, store, {"a": canned(rows)}, raw, dry_run=True)
    assert s.raised == 0 and [o.findings for o in s.outcomes if o.kind == "a"] == [1]
    assert store.version() == 0 and store.ledger().count() == 0
    s = run(spark, store, {"a": canned(rows)}, raw)
    assert {o.kind: o.status for o in s.outcomes} == {"nope": "error", "a": "ok"} and s.raised == 1
    assert store.ledger().count() == 2


def test_severity(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    rows = [("1", None, "critical", "x"), ("2", None, None, "x"), ("3", None, "warning", "x")]
    run(spark, store, {"a": canned(rows)}, [{"rule": "a", "severity": "info"}])
    assert {r["dev_eui"]: r["severity"] for r in store.read().collect()} == {"1": "critical", "2": "info", "3": "info"}


def test_notification_and_retry(spark, tmp_path):
    store, calls = StateStore(spark, str(tmp_path)), []
    raw = {"checks": [{"rule": "a"}], "notify": {"destinations": {"x": {"webhookUrl": "https://x.y"}}, "defaultDestination": "x"}, "statementTimeoutMs": 300_000}
    checks = {"a": check("a", canned([("1", None, None, "x")]))}

    def post(status):
        return lambda url, body, headers, timeout: (calls.append(body), (status, b""))[1]

    once = lambda status, **more: run_pass(spark, C.parse(raw, {}), checks, Store().tables(spark), store, AS_OF, post=post(status), **more)
    assert once(500).delivery.failed == 1 and store.read().first()["notified_at"] is None
    assert once(200).delivery.attempted == 0 and store.read().first()["notified_at"] is None
    assert once(200, retry_pending=True).delivery.delivered == 1 and store.read().first()["notified_at"] is not None
    assert once(200, retry_pending=True).delivery.attempted == 0 and len(calls) == 2


def test_only_routed_alerts_are_sent_worst_first(spark, tmp_path):
    """Alerts without a destination are counted when they are raised and never sent; the others go out by severity and the rule's order."""
    store, calls = StateStore(spark, str(tmp_path)), []
    raw = {"checks": [{"rule": "a"}], "notify": {"destinations": {"x": {"webhookUrl": "https://x.y"}}, "bySeverity": {"info": None}, "defaultDestination": "x"}, "statementTimeoutMs": 300_000}

    def find(ctx):
        rows = [(str(i), None, sev, "x", worst) for i, (sev, worst) in enumerate((("warning", 5), ("info", 1), ("critical", 9), ("warning", -3), ("critical", 2), ("info", 0)))]
        df = ctx.table("event_up").sparkSession.createDataFrame(rows, "dev_eui string, device_name string, severity string, summary string, ordinal long")
        return df.withColumn("detail", F.struct(F.lit(1).alias("n")))

    post = lambda url, body, headers, timeout: (calls.append(json.loads(body)["devEui"]), (200, b""))[1]
    once = lambda **more: run_pass(spark, C.parse(raw, {}), {"a": check("a", find)}, Store().tables(spark), store, AS_OF, post=post, **more).delivery
    first = once()
    assert (first.delivered, first.unrouted) == (4, 2) and calls == ["4", "2", "3", "0"]
    again = once(retry_pending=True)
    assert (again.attempted, again.unrouted, len(calls)) == (0, 0, 4)


def test_closed_alerts_are_written_once(spark, tmp_path):
    """A pass over many closed alerts writes none of them again, and reads back all of them."""
    store = StateStore(spark, str(tmp_path))
    rows = [(str(i), None, None, "x") for i in range(50)]
    run(spark, store, {"a": canned(rows), "b": canned(rows[:1])})
    run(spark, store, {"a": canned(), "b": canned(rows[:1])})
    files = {f: f.stat().st_mtime_ns for f in tmp_path.glob("closed/**/*.parquet")}
    assert files and store.closed().count() == 50
    for _ in range(4):
        run(spark, store, {"a": canned(rows[:2]), "b": canned(rows[:1])})
        run(spark, store, {"a": canned(), "b": canned(rows[:1])})
    assert {f: f.stat().st_mtime_ns for f in files} == files
    assert store.closed().count() == 58 and store.opened().count() == 1 and store.read().count() == 59
    assert sum(spark.read.parquet(str(p)).count() for p in tmp_path.glob("open/v=*")) <= 9
    assert len(list(tmp_path.glob("open/v=*"))) == 3 and not list(tmp_path.glob("work/*"))


def test_each_check_has_its_own_time(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    slow = lambda ctx: (time.sleep(1.5), canned([("1", None, None, "x")])(ctx))[1]
    run(spark, store, {"a": slow, "b": canned()})
    ledger = {r["kind"]: r for r in store.ledger().collect()}
    assert ledger["a"]["duration_ms"] >= 1500 and (ledger["a"]["finished_at"] - ledger["a"]["started_at"]).total_seconds() >= 1.5
    assert ledger["a"]["duration_ms"] != ledger["b"]["duration_ms"]


def test_timeout(spark, tmp_path):
    def slow(ctx):
        df = ctx.table("event_up").sparkSession.range(0, 40, 1, 8)
        return df.select(
            F.col("id").cast("string").alias("dev_eui"), F.lit(None).cast("string").alias("device_name"), F.lit("info").alias("severity"),
            F.expr("string(java_method('java.lang.Thread', 'sleep', 800L))").alias("summary"), F.struct(F.lit(1).alias("n")).alias("detail"),
        )

    config = C.parse({"checks": [{"rule": "a"}], "statementTimeoutMs": 300}, {})
    s = run_pass(spark, config, {"a": check("a", slow)}, Store().tables(spark), StateStore(spark, str(tmp_path)), AS_OF)
    assert [o.status for o in s.outcomes] == ["error"]


def test_state_versions(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    assert not store.exists()
    store.initialise()
    store.initialise()
    assert store.exists() and store.version() == 0 and store.read().count() == 0
    a = RC.reconcile(store.read(), found(spark, ("k", eui("1"), "info", "x")), T1, ["k"]).state
    for n in range(1, 6):
        assert store.write(a if n == 1 else store.read()) == n
    store.prune(2)
    assert store.read().count() == 1 and store.duplicates().count() == 0
    assert RC.status(store.read(), T2).first()["open_for"].days == 1


def test_two_passes_at_once(spark, tmp_path):
    """The second writer of a version fails and leaves the first one's as it is; afterwards passes go on."""
    store = StateStore(spark, str(tmp_path))
    a = RC.reconcile(store.read(), found(spark, ("k", eui("1"), "info", "x")), T1, ["k"]).state
    b = RC.reconcile(store.read(), found(spark, ("k", eui("2"), "info", "x"), ("k", eui("3"), "info", "x")), T1, ["k"]).state
    slow = StateStore(spark, str(tmp_path))
    slow.version = lambda: 0  # it read the state before the other one wrote
    assert store.write(a) == 1
    with pytest.raises(RuntimeError, match="meanwhile"):
        slow.write(b)
    (tmp_path / "_claims").mkdir(exist_ok=True)
    (tmp_path / "_claims" / "2").touch()
    with pytest.raises(RuntimeError, match="another pass"):
        store.write(b)
    assert store.version() == 1 and store.opened().count() == 1
    os.utime(tmp_path / "_claims" / "2", (1, 1))  # that pass died long ago
    assert store.write(b) == 2 and store.opened().count() == 2 and not list((tmp_path / "_claims").glob("[0-9]*"))


def test_builtin_contract():
    for c in registry.load().values():
        assert registry.validated(c, c.id) and "deviceProfiles" in c.params


def test_stream(spark, tmp_path):
    from tidewatch.streaming import micro_batches as M

    s = Store()
    s.up("1", "n", 4, 10, {"a": 1})
    s.tables(spark)["event_up"].repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []
    q = M.append_then(M.uplinks(spark, str(tmp_path / "in"), 1), str(tmp_path / "store"), str(tmp_path / "cp"), lambda sp, n: seen.append(n))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4 and seen
    out = M.hourly_counts(M.uplinks(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert spark.sql("SELECT sum(uplinks) FROM hours").first()[0] == 4
