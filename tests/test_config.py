import json

import pytest

from tidewatch.cli import main
from tidewatch.functions import params as P
from tidewatch.operators import routing
from tidewatch.operators.scope import Scope
from tidewatch.plans import config as C
from tidewatch.plans import registry
from tidewatch.plans.checks.base import Check
from tidewatch.plans.scheduler import Schedule, Service
from tidewatch.plans.verify import verify
from tidewatch.sources import notify as N
from tidewatch.sources.tables import SCHEMAS

HOOK = {"destinations": {"ops": {"webhookUrl": "https://example.org/x"}}, "defaultDestination": "ops"}


def parse(env=None, **raw):
    return C.parse({"checks": [{"rule": "device-silent"}], **raw}, env or {})


@pytest.mark.parametrize("value,want", [("a.b", [("a", "b")]), (["a", "b.c"], [("a",), ("b", "c")]), ([["a.x", "b"]], [("a.x", "b")]), ("a..b", [("a", "b")])])
def test_paths(value, want):
    assert P.paths({"paths": value}) == want


@pytest.mark.parametrize("value", [None, [], "", [""], [1], {"a": 1}, [[]], [[1]]])
def test_bad_paths(value):
    with pytest.raises(P.ParamError):
        P.paths({"paths": value})


def test_coercion():
    assert P.number({"x": "2.5"}, "x") == 2.5 and P.whole({"x": 3.0}, "x") == 3 and P.rounded({"x": 2.5}, "x") == 3
    assert P.optional({"x": None}, "x") is None and P.strings({"x": "a"}, "x") == ["a"]
    for bad in ("x", None, True, float("nan"), float("inf")):
        with pytest.raises(P.ParamError):
            P.number({"x": bad}, "x")
    for call in (lambda: P.whole({"x": 2.5}, "x"), lambda: P.strings({"x": [1]}, "x"), lambda: Scope.of({"deviceNamePattern": 3}), lambda: P.flag({"x": 1}, "x")):
        with pytest.raises(P.ParamError):
            call()


def test_defaults():
    c = parse()
    assert (c.schedule, c.timezone, c.timeout_ms, c.max_checks) == ("*/15 * * * *", "UTC", 15000, 64)
    assert c.checks[0].kind == "device-silent"


@pytest.mark.parametrize(
    "raw",
    [
        {"checks": "x"},
        {"checks": [{"rule": ""}]},
        {"checks": [{"rule": "a", "as": "Bad Name"}]},
        {"checks": [{"rule": "a"}, {"rule": "a"}]},
        {"checks": [{"rule": "a", "severity": "huge"}]},
        {"checks": [{"rule": "a", "params": []}]},
        {"checks": [{"rule": "a", "enabled": "yes"}]},
        {"checks": [{"rule": "a", "notifyTo": 5}]},
        {"checks": [{"rule": "a"}, {"rule": "b"}], "maxChecksPerRun": 1},
        {"notify": {}},
        {"notify": {"destinations": {}}},
        {"notify": {**HOOK, "webhookUrl": "https://x"}},
        {"notify": {**HOOK, "defaultDestination": "nowhere"}},
        {"notify": {**HOOK, "routing": {"rumour": "ops"}}},
        {"notify": {"destinations": HOOK["destinations"]}},
        {"notify": {**HOOK, "destinations": {"ops": {"webhookUrl": "ftp://x"}}}},
        {"notify": {**HOOK, "destinations": {"ops": {"provider": "pigeon"}}}},
        {"notify": {**HOOK, "destinations": {"ops": {"provider": "twilio", "to": ["12"]}}}},
        {"notify": {**HOOK, "destinations": {"ops": {"provider": "telegram"}}}},
        {"notify": {**HOOK, "destinations": {"ops": {"webhookUrl": "https://x.y", "auth": "hmac"}}}},
    ],
)
def test_refused(raw):
    with pytest.raises(C.ConfigError):
        parse(**raw)


def test_comments_disabled_and_env():
    c = parse(checks=[{"//": "x"}, {"rule": "a", "enabled": False}, {"rule": "b"}], maxChecksPerRun=1)
    assert [x.kind for x in c.enabled] == ["b"]
    env = {"TIDEWATCH_DEST_OPS_WEBHOOK_URL": "https://other.example", "TIDEWATCH_WEBHOOK_SECRET": "s", "TIDEWATCH_DEST_OPS_SECRET": " "}
    c = parse(env, notify={**HOOK, "destinations": {"ops": {"webhookUrl": "https://x.y", "auth": "bearer"}}})
    assert c.notify.destinations["ops"].url == "https://other.example" and c.notify.destinations["ops"].secret == "s"
    assert parse(checks=[{"rule": "a", "notifyTo": "ops"}], notify={"destinations": HOOK["destinations"]}).notify is not None


def test_routing_precedence(spark):
    from pyspark.sql import functions as F

    A = routing.ABSENT
    cases = [("critical", "fact", own) for own in (A, None, "desk")] + [(s, r, A) for s in ("critical", "warning", "info") for r in ("fact", "situation", "other")]
    by_severity, by_class = {"critical": "pager", "info": None}, {"fact": "sms", "situation": None}
    for default in (A, None, "log"):
        want = [routing.destination(s, r, o, by_severity, by_class, default) for s, r, o in cases]
        df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, r string, o string")
        got = df.select("i", routing.destination_column(F.col("s"), F.col("r"), F.col("o"), by_severity, by_class, default).alias("d")).orderBy("i").collect()
        assert [r["d"] for r in got] == want
    assert routing.destination("info", "fact", A, by_severity, by_class, "log") is None


def test_delivery():
    sent = []

    def post(url, body, headers, timeout):
        sent.append((url, body, headers))
        if b"bad" in body:
            return 500, b""
        return 200, b'{"ok": true}'

    env = {"TIDEWATCH_WEBHOOK_SECRET": "s", "TIDEWATCH_TELEGRAM_BOT_TOKEN": "t", "TIDEWATCH_SIGNAL_API_URL": "https://sig", "TIDEWATCH_SIGNAL_NUMBER": "+1"}
    env |= {"TIDEWATCH_TWILIO_ACCOUNT_SID": "a", "TIDEWATCH_TWILIO_AUTH_TOKEN": "b", "TIDEWATCH_TWILIO_FROM": "+15550001111"}
    destinations = {
        "hook": {"webhookUrl": "https://x.y", "auth": "hmac"},
        "tg": {"provider": "telegram", "chatId": 5},
        "sig": {"provider": "signal", "to": ["+15550001111", "group.abc="]},
        "sms": {"provider": "twilio", "to": ["+15550001111", "+15550002222"]},
    }
    notify = parse(env, notify={"destinations": destinations, "defaultDestination": "hook"}).notify
    alert = N.test_alert() | {"id": "1", "kind": "k"}
    out = N.deliver([alert, alert | {"id": "2", "summary": "bad"}, alert | {"id": "3", "kind": "none"}], notify, {"k": ("fact", routing.ABSENT), "none": ("fact", None)}, post)
    assert (out.attempted, out.delivered, out.failed, out.unrouted, out.delivered_ids) == (2, 1, 1, 1, ["1"])
    url, body, headers = sent[0]
    import hashlib
    import hmac

    assert headers["X-Signature"] == hmac.new(b"s", headers["X-Timestamp"].encode() + b"." + body, hashlib.sha256).hexdigest()
    assert len(json.loads(body)) == 10 and json.loads(body)["schema"] == N.SCHEMA_TAG
    for name, calls in (("tg", 1), ("sig", 1), ("sms", 2)):
        sent.clear()
        assert N.deliver([alert], notify, {"k": ("fact", name)}, post).delivered == 1 and len(sent) == calls
    refuse = lambda *a: (200, b'{"ok": false}')
    assert N.deliver([alert], notify, {"k": ("fact", "tg")}, refuse).failed == 1

    def hang(*a):
        raise TimeoutError("late")

    assert N.deliver([alert], notify, {"k": ("fact", "hook")}, hang).failed == 1
    assert N.deliver([alert], None, {"k": ("fact", "hook")}, post).unrouted == 1


def test_registry(tmp_path):
    found = registry.load()
    assert len(found) == 18
    (tmp_path / "device_silent.py").write_text(
        "from tidewatch.plans.checks.base import Check\nCHECK = Check('device-silent', 'mine', 'info', {}, {'event_up': ('time',)}, lambda ctx: None)\n"
    )
    (tmp_path / "_helper.py").write_text("raise RuntimeError\n")
    assert registry.load(tmp_path)["device-silent"].description == "mine"
    (tmp_path / "other.py").write_text((tmp_path / "device_silent.py").read_text())
    with pytest.raises(registry.RegistryError):
        registry.load(tmp_path)
    (tmp_path / "other.py").write_text("CHECK = 5\n")
    with pytest.raises(registry.RegistryError):
        registry.load(tmp_path)
    bad = Check("x", "d", "huge", {}, {"t": ()}, lambda c: None)
    with pytest.raises(registry.RegistryError):
        registry.validated(bad, "here")


def test_example_of_an_own_check(spark, tmp_path):
    from tests.golden import AS_OF, Store
    from tidewatch import api

    text = api.__doc__.split("for example:\n")[1]
    (tmp_path / "my_check.py").write_text("\n".join(line[4:] for line in text.split("\n")))
    s = Store()
    s.up("1", "n", 1, 5, {"a.b": 7})
    s.up("2", "n", 1, 5, {"a.b": 3})
    found = registry.load(tmp_path)["my-check"].run(api.Context(s.tables(spark), {}, AS_OF)).collect()
    assert [(r["dev_eui"][-1], r["summary"], r["detail"]["value"]) for r in found] == [("1", "n: is at 7.0", 7.0)]


def test_verify():
    checks = registry.load()
    columns = {k: {c.split()[0] for c in v.split(", ")} for k, v in SCHEMAS.items()}
    every = parse(checks=[{"rule": r} for r in checks])
    assert verify(every, checks, columns) == []
    c = parse(checks=[{"rule": "nope"}, {"rule": "battery-low", "params": {"volts": 3, "deviceProfiles": ["x"]}}, {"rule": "device-log-error"}])
    del columns["event_log"]
    columns["event_up"].discard("object")
    messages = [(p.level, p.message) for p in verify(c, checks, columns)]
    assert len(messages) == 4 and sum(level == "error" for level, _ in messages) == 3
    assert any("volts" in m for _, m in messages)
    assert any(p.level == "error" for p in verify(c, checks, {}))
    assert [p.level for p in verify(parse(checks=[]), checks, columns)] == ["warning"]


def test_schedule():
    from datetime import datetime, timezone

    at = lambda h, m, d=1: datetime(2024, 1, d, h, m, tzinfo=timezone.utc)
    assert Schedule("*/15 * * * *").after(at(10, 7)) == at(10, 15)
    assert Schedule("0 6 * * 1-5").after(at(7, 0, 5)) == at(6, 0, 8)
    assert Schedule("30 2 13 * 5").after(at(3, 0, 5)) == at(2, 30, 12)
    for bad in ("* * * *", "61 * * * *", "a * * * *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            Schedule(bad)


def test_service_skips_overlap_and_survives():
    s = Service(Schedule("* * * * *"), lambda: 1 / 0)
    assert s.tick() and s.tick()
    s.busy.acquire()
    assert not s.tick()


def test_cli(tmp_path, capsys):
    assert main(["version"]) == 0 and main(["list"]) == 0 and main(["nonsense"]) == 2 and main(["--help"]) == 0
    assert "geofence-breach" in capsys.readouterr().out
    assert main(["test-notify"]) == 2
    (tmp_path / "c.json").write_text("{")
    assert main(["test-notify", "--config", str(tmp_path / "c.json")]) == 2
    assert main(["run"]) == 2


def test_secret_without_mode_is_sent_as_bearer():
    from tidewatch.sources import notify

    d = parse({"TIDEWATCH_WEBHOOK_SECRET": "s"}, notify={**HOOK, "destinations": {"ops": {"webhookUrl": "https://x.y"}}}).notify.destinations["ops"]
    assert notify.signed(d, b"{}", 0)["Authorization"] == "Bearer s"


def test_each_missing_column_is_reported_once():
    from tidewatch.plans.verify import verify

    config = C.parse({"checks": [{"rule": "device-silent"}, {"rule": "decode-failure"}, {"rule": "join-churn"}]}, {})
    found = verify(config, registry.load(), {"event_up": {"time", "device_name", "device_profile_name", "object"}})
    assert [p.message.split(" (")[0] for p in found] == ["table event_up has no column dev_eui", "table event_join is missing"]


def test_jdbc_round_trip(spark, tmp_path):
    """The event tables from a database, in slices of time: Derby comes with Spark."""
    from tests.golden import AS_OF, brewery
    from tidewatch.sources import tables as T

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    mine = brewery().tables(spark)
    for name, df in mine.items():
        df.coalesce(1).write.jdbc(url, name, mode="overwrite", properties={"createTableColumnTypes": "object VARCHAR(500)"} if name == "event_up" else {})
    got = T.jdbc(spark, url, until=AS_OF, hours=3, n_slices=3)
    want = mine["event_up"].filter(f"time > timestamp '{AS_OF}' - interval 3 hours")
    assert got["event_up"].rdd.getNumPartitions() == 3
    key = lambda df: sorted(r["deduplication_id"] for r in df.select("deduplication_id").collect())
    assert key(got["event_up"]) == key(want) and 0 < want.count() < mine["event_up"].count()


def test_layout_by_day_prunes_folders(spark, tmp_path):
    from tests.golden import AS_OF, fleet
    from tidewatch.operators import resolvers as R
    from tidewatch.sources import tables as T

    mine = fleet().tables(spark)
    T.lay_out(mine, str(tmp_path))
    got = T.parquet(spark, str(tmp_path))
    assert len(list((tmp_path / "event_up.parquet").glob("day=*"))) > 2
    window = R.window(got["event_up"], AS_OF, 6)
    assert window.columns == mine["event_up"].columns and window.count() == R.window(mine["event_up"], AS_OF, 6).count() > 0
    assert "PartitionFilters: [isnotnull(day" in window._jdf.queryExecution().toString()


def test_every_key_of_a_destination_counts():
    """webhookAuth, webhookTokenHeader and timeouts are read; a key that isn't read is refused."""
    env = {"TIDEWATCH_WEBHOOK_SECRET": "s"}
    ops = {"webhookUrl": "https://x.y", "webhookAuth": "hmac", "//": "a comment"}
    c = parse(env, notify={**HOOK, "timeoutMs": 1500, "destinations": {"ops": ops}})
    d = c.notify.destinations["ops"]
    assert (d.auth, d.timeout_ms) == ("hmac", 1500)
    d = parse(env, notify={**HOOK, "destinations": {"ops": {**ops, "webhookAuth": "token", "webhookTokenHeader": "X-Key", "timeoutMs": 70}}}).notify.destinations["ops"]
    assert (d.auth, d.token_header, d.timeout_ms) == ("token", "X-Key", 70)
    for bad in ({"webhookauth": "hmac"}, {"webhookAuth": "basic"}, {"auth": "hmac"}, {"timeoutMs": True}, {"webhookTokenHeader": 5}):
        with pytest.raises(C.ConfigError):
            parse(env, notify={**HOOK, "destinations": {"ops": {**ops, **bad}}})
    with pytest.raises(C.ConfigError):
        parse(env, notify={**HOOK, "destinations": {"ops": ops}, "byseverity": {}})


def test_lookback_reads_hours_as_checks_do():
    from dataclasses import replace

    from tidewatch.plans.checks import CHECKS
    from tidewatch.plans.verify import lookback

    of = lambda value, checks=CHECKS: lookback(parse({}, checks=[{"rule": "measurement-peak", "params": {"lookbackHours": value}}]), checks)
    assert of(720) == of("720") == 720 and of(3) == 3 and of("many") == 24
    own = {"measurement-peak": replace(CHECKS["measurement-peak"], reach=lambda p: 2 * float(p["lookbackHours"]))}
    assert of("50", own) == 100
