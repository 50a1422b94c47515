"""Queries over the test tables and the SQL that gives the same results.

Spark's side runs checks and resolvers on the event tables that sources.tables derives from
`events`; the SQL side restates each from the columns of `events`, without JSON.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload, table_functions
from ..operators import counters
from ..operators import findings as FF
from ..operators import reconcile as RC
from ..operators import resolvers as R
from ..operators import routing
from ..operators.scope import Scope
from ..sources import tables as T
from ..sources.daily import Daily
from ..sources.partials import Partials
from ..sources.state import StateStore, scratch
from ..streaming import silence
from .checks import CHECKS, Context

AS_OF = T.AS_OF
Query = Callable[[SparkSession, str], DataFrame]

#: Events with the derived columns, as the adapter has them; has: the payload holds fields.
_EV = """WITH ev AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id, ts, lpad(CAST(user_id AS VARCHAR), 16, '0') AS dev_eui,
    'dev-' || user_id AS device_name, 'profile-' || (user_id % 4) AS profile, user_id, event_type, value,
    CAST(value AS DECIMAL(18,2)) AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
e2 AS (SELECT *, k % 10 > 2 AS has, k % 10 <> 0 AS decoded FROM ev WHERE ts <= TIMESTAMP '2024-01-31 00:00:00')"""


def _since(hours: float) -> str:
    return f"ts > TIMESTAMP '{AS_OF}' - INTERVAL '{int(hours * 3600)} seconds'"


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up set of devices in alert: every third user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id % 3 = 0")
    return events.select(F.lpad(F.col("user_id").cast("string"), 16, "0").alias("dev_eui")).distinct()


def _check(rule: str, params: dict[str, Any], *fields: str, opened: bool = False) -> Query:
    """A check's findings: dev_eui, severity and some of its detail, flat; name:n is rounded to n places."""
    names = [f.partition(":") for f in fields]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = Context(T.test_tables(spark, sf_dir), params, AS_OF, rule, _open(spark, sf_dir) if opened else None)
        return CHECKS[rule].run(ctx).select("dev_eui", "device_name", "severity", *[F.col(f"detail.{f}").alias(f) if not n else F.round(f"detail.{f}", int(n)).alias(f) for f, _, n in names])

    run.spec = (rule, params)
    return run


def _rounded(total: str, n: str, places: int) -> str:
    """SQL for total / n (whole numbers) rounded to places, halves away from zero, in whole numbers until the last step."""
    return f"(CASE WHEN ({total}) < 0 THEN -1 ELSE 1 END * ((2 * abs({total}) * {10**places} + ({n})) // (2 * ({n}))) / CAST({10**places} AS DOUBLE))"


def _resolver(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(T.test_tables(spark, sf_dir)["event_up"])


_NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dev_eui ORDER BY ts DESC, id DESC) AS n
  FROM e2 WHERE decoded AND {since}) WHERE n = 1)"""
#: Candidates click.value, view.value, k on the newest decoded uplink.
_READING = """reading AS (SELECT dev_eui, device_name, ts,
  CASE WHEN event_type = 'click' THEN 'click.value' WHEN event_type = 'view' THEN 'view.value' ELSE 'k' END AS matched_path,
  CAST(CASE WHEN event_type IN ('click', 'view') THEN v ELSE k END AS DOUBLE) AS value FROM newest WHERE has)"""
#: Candidates purchase.value, k over a window.
_STATS = """r AS (
  SELECT dev_eui, device_name, ts, id, 0 AS ord, CAST(v AS DECIMAL(18,2)) AS num FROM e2 WHERE has AND event_type = 'purchase' AND {since}
  UNION ALL SELECT dev_eui, device_name, ts, id, 1, CAST(k AS DECIMAL(18,2)) FROM e2 WHERE has AND {since}),
won AS (SELECT dev_eui, min(ord) AS ord FROM r GROUP BY dev_eui),
s AS (SELECT dev_eui, max(device_name) AS device_name, CASE WHEN r.ord = 0 THEN 'purchase.value' ELSE 'k' END AS matched_path,
  CAST(min(num) AS DOUBLE) AS vmin, CAST(max(num) AS DOUBLE) AS vmax, {vavg} AS vavg, CAST(sum(num) AS DOUBLE) / count(*) AS mean,
  CAST(arg_min(num, (ts, id)) AS DOUBLE) AS vfirst, CAST(arg_max(num, (ts, id)) AS DOUBLE) AS vlast,
  count(*) AS samples, count(DISTINCT num) AS distinct_values, count(DISTINCT round(num, 0)) AS whole_values, min(ts) AS first_at, max(ts) AS last_at,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS span_hours
  FROM r JOIN won USING (dev_eui, ord) GROUP BY dev_eui, r.ord)"""



def _rounded4(total: str, n: str) -> str:
    """SQL for total / n in ten-thousandths, rounded: the scale that an average of whole decimals has."""
    return f"(CASE WHEN ({total}) < 0 THEN -1 ELSE 1 END * ((2 * abs({total}) * 10000 + {n}) // (2 * {n})))"


_LATEST = ["click.value", "view.value", "k"]
_WINDOW = ["purchase.value", "k"]


def _paths(names: list[str]) -> list[tuple[str, ...]]:
    return [tuple(n.split(".")) for n in names]


def _stats_sql(select: str, hours: float = 720) -> str:
    return f"{_EV}, {_STATS.format(since=_since(hours), vavg=_rounded('CAST(sum(num) * 100 AS HUGEINT)', 'count(*) * 100', 4))} {select}"


def _silent_state(spark: SparkSession, sf_dir: str) -> tuple[RC.Reconciled, DataFrame]:
    """Two passes of device-silent: four days before AS_OF, then at AS_OF."""
    tables = T.test_tables(spark, sf_dir)
    times = ("2024-01-27 00:00:00", AS_OF)
    state = spark.createDataFrame([], RC.STATE)
    for as_of in times:
        found = CHECKS["device-silent"].run(Context(tables, {"silentMinutes": 720}, as_of))
        result = RC.reconcile(state, FF.canonical(found, "device-silent", "device-silent", None, "critical"), as_of, ["device-silent"])
        state = result.state
    return result, state


def reconcile_two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, state = _silent_state(spark, sf_dir)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return state.select("kind", "dev_eui", "device_name", "severity", ntz("raised_at"), ntz("last_seen_at"), ntz("resolved_at"))


def open_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, state = _silent_state(spark, sf_dir)
    hours = (F.unix_timestamp(F.lit(AS_OF)) - F.unix_timestamp("raised_at")) / 3600
    return RC.open_alerts(state, AS_OF).select("kind", "dev_eui", hours.alias("open_hours"))


def status_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst 20 open alerts of several checks; the limit is the feature."""
    tables = T.test_tables(spark, sf_dir)
    parts = []
    for rule, params in (("device-log-error", {"lookbackHours": 720}), ("downlink-unacked", {"lookbackHours": 720}), ("status-margin-low", {"lookbackHours": 720, "minMarginDb": -10, "criticalMarginDb": -25})):
        found = CHECKS[rule].run(Context(tables, params, AS_OF))
        parts.append(FF.canonical(found, rule, rule, None, CHECKS[rule].severity))
    state = RC.reconcile(spark.createDataFrame([], RC.STATE), FF.stacked(parts), AS_OF, ["device-log-error", "downlink-unacked", "status-margin-low"]).state
    return RC.status(state, AS_OF, 20).select("severity", "kind", "dev_eui")


_BY_SEVERITY, _BY_CLASS = {"critical": "pager", "info": None}, {"fact": "sms", "situation": "mail"}


def routing_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations of made-up alerts: own target (purchases), by severity, by class, by default."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    severity = F.when(F.col("user_id") % 3 == 0, "critical").when(F.col("user_id") % 3 == 1, "warning").otherwise("info")
    klass = F.when(F.col("event_type") == "view", "situation").when(F.col("event_type") == "click", "fact").otherwise("other")
    own = F.when(F.col("event_type") == "purchase", F.lit("desk")).otherwise(F.lit(routing.ABSENT))
    return events.select("event_id", routing.destination_column(severity, klass, own, _BY_SEVERITY, _BY_CLASS, "log").alias("destination"))


def severity_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check's severity before the rule's; an escalated finding's own before both."""
    found = CHECKS["device-log-error"].run(Context(T.test_tables(spark, sf_dir), {"lookbackHours": 720, "minLevel": 1}, AS_OF))
    return FF.canonical(found, "noisy", "device-log-error", "info", "warning").select("kind", "dev_eui", "severity")


def profile_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = T.test_tables(spark, sf_dir)["event_up"]
    return up.groupBy("device_profile_name").agg(F.count("*").alias("uplinks"), F.count_distinct("dev_eui").alias("devices")).orderBy(F.col("uplinks").desc())


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, fifth percentile and greatest reading by profile."""
    up = T.test_tables(spark, sf_dir)["event_up"]
    rows = R.telemetry(up, _paths(["purchase.value"]), 720, Scope(), AS_OF, "device_profile_name")
    return rows.groupBy("device_profile_name").agg(
        F.min("num").cast("double").alias("least"),
        F.round(F.expr("percentile_cont(0.05) WITHIN GROUP (ORDER BY cast(num AS double))"), 6).alias("p05"),
        F.max("num").cast("double").alias("greatest"),
    )


#: A window with an odd start and end, so that it has edges; what partial sums cover lies between.
_EDGES = ("2024-01-30 18:20:30", 600.25)


def window_stats_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window statistics merged from stored partial sums, which three batches made; two of them come late, for hours that are summed up already."""
    up = T.test_tables(spark, sf_dir)["event_up"]
    sums = Partials(spark, scratch(spark, "partials"), _paths(_WINDOW))
    for batch in range(3):
        sums.append(up.filter(F.pmod(F.xxhash64("deduplication_id"), F.lit(3)) == batch), batch)
    return sums.stats(up, _paths(_WINDOW), _EDGES[1], Scope(), _EDGES[0])


#: How late rows of the stream may be, and the silence it watches for.
_LATE_MINUTES, _STREAM_TRIGGERS = 90, 4


def silence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices in alert after a replay of all uplinks as a stream, in some triggers; each run of the query goes on from the checkpoint of the one before."""
    up = T.test_tables(spark, sf_dir)["event_up"].select("dev_eui", "device_name", "device_profile_name", F.col("time").cast("timestamp").alias("time"))
    folder = scratch(spark, "silence")
    spark.conf.set(*silence.PROVIDER)
    ends = up.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    edges = [ends["a"] + (ends["b"] - ends["a"]) * i / _STREAM_TRIGGERS for i in range(_STREAM_TRIGGERS)][1:]
    part = sum((F.when(F.col("time") > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    arrived = up.withColumn("part", part)
    for i in range(_STREAM_TRIGGERS):
        arrived.filter(F.col("part") == i).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(up.schema).parquet(f"{folder}/in")
        events = silence.silence(stream, silent_minutes=720, late=f"{_LATE_MINUTES} minutes")
        query = events.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return silence.in_alert(spark.read.schema(silence.EVENTS).parquet(f"{folder}/out")).select("dev_eui", "device_name", ntz("last_seen"))


def churn_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_churn over tables that are laid out by device; none of its sums and joins moves a row."""
    database = f"by_device_{uuid.uuid4().hex}"
    tables = T.test_tables(spark, sf_dir)
    T.lay_out_by_device({k: tables[k] for k in ("event_up", "event_join")}, database, scratch(spark, "by-device"), buckets=8)
    rule, params = _CHURN
    found = CHECKS[rule].run(Context(T.catalog(spark, database), params, AS_OF, rule))
    return found.select("dev_eui", "device_name", "severity", *[F.col(f"detail.{f}").alias(f) for f in ("joins", "distinctDevAddrs", "uplinksInWindow", "latestJoinAt")])


def _by_sql(call: str, *columns: str) -> Query:
    """A query that calls a resolver's SQL table function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table_functions.register(spark, T.test_tables(spark, sf_dir))
        return spark.sql(f"SELECT {', '.join(columns) or '*'} FROM {call.format(at=f'TIMESTAMP{AS_OF!r}')}")

    return run


def counter_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counters advanced between neighbouring readings, and their resets inside the window."""
    up = T.test_tables(spark, sf_dir)["event_up"]
    return counters.advances(R.telemetry(up, _paths(_WINDOW), 720, Scope(), AS_OF), _paths(_WINDOW))


_CHURN = ("join-churn", {"maxJoinsPerUplinkRatio": None})
#: Days of the summaries' queries, and of the two batches that made them: they overlap.
_DAYS = ("2024-01-06", "2024-01-23")


def _daily(spark: SparkSession, sf_dir: str) -> Daily:
    up = T.test_tables(spark, sf_dir)["event_up"]
    daily = Daily(spark, scratch(spark, "daily"), _paths(["purchase.value"]))
    daily.append(up.filter(F.pmod(F.xxhash64("deduplication_id"), F.lit(5)) < 3), "first")
    daily.append(up.filter(F.pmod(F.xxhash64("deduplication_id"), F.lit(5)) >= 3), "late")
    return daily


def census_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uplinks and different devices of a range of days, by profile, from bitmaps."""
    return _daily(spark, sf_dir).census(*_DAYS)


def calibration_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a range of days by profile from sketches: number, extremes, and whether the exact rank of the sketch's fifth
    percentile is within two in a thousand of it, or within a reading."""
    up = T.test_tables(spark, sf_dir)["event_up"]
    found = _daily(spark, sf_dir).quantiles(*_DAYS, 0.05).select("device_profile_name", "n", "least", "greatest", F.col("quantiles")[0].alias("q"))
    day = F.to_date("time")
    rows = up.filter(F.col("object").isNotNull() & day.between(F.lit(_DAYS[0]), F.lit(_DAYS[1])))
    rows = payload.readings(rows, {"purchase.value": ("purchase", "value")}, "device_profile_name").withColumn("num", F.col("num").cast("double"))
    ranks = rows.join(found, "device_profile_name").groupBy("device_profile_name").agg(
        F.first("n").alias("n"), F.first("least").alias("least"), F.first("greatest").alias("greatest"),
        F.count_if(F.col("num") < F.col("q")).alias("below"), F.count_if(F.col("num") <= F.col("q")).alias("upto"),
    )
    slack = F.greatest(F.lit(1.0), F.col("n") * 0.002)
    near = (F.col("below") - slack <= F.col("n") * 0.05) & (F.col("upto") + slack >= F.col("n") * 0.05)
    return ranks.select("device_profile_name", "n", "least", "greatest", near.alias("p05_near"))


def context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameterised SQL over event tables, as a check's author may write it."""
    return spark.sql(
        "SELECT dev_eui, count(*) AS acks FROM {event_ack} WHERE acknowledged AND time > CAST(:since AS timestamp_ntz) GROUP BY dev_eui",
        args={"since": "2024-01-10 00:00:00"},
        event_ack=T.test_tables(spark, sf_dir)["event_ack"],
    )


def full_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole pass on shared scans, of every check of this catalogue under its query's name: outcome of each."""
    from . import config as C
    from .runner import run_pass

    raw = [{"rule": q.spec[0], "as": _kind(name), "params": q.spec[1]} for name, q in QUERIES.items() if hasattr(q, "spec")]
    store = StateStore(spark, scratch(spark, "pass"))
    s = run_pass(spark, C.parse({"checks": raw, "statementTimeoutMs": 900_000}, {}), CHECKS, T.test_tables(spark, sf_dir), store, AS_OF)
    rows = [(o.kind, o.status, o.findings, o.raised, o.resolved) for o in s.outcomes]
    return spark.createDataFrame(rows, "kind string, status string, findings bigint, raised bigint, resolved bigint")



def _kind(name: str) -> str:
    return name.replace("_", "-")


QUERIES: dict[str, Query] = {
    "device_silent": _check("device-silent", {"silentMinutes": 720}, "lastSeen", "silentMinutes", "uplinksInWindow"),
    "device_silent_scoped": _check("device-silent", {"silentMinutes": 720, "deviceProfiles": ["profile-1", "profile-2"], "deviceNamePattern": "dev-1%"}, "uplinksInWindow"),
    "decode_failure": _check("decode-failure", {"lookbackHours": 720, "minFailureRatio": 0.3}, "deviceProfileName", "undecodedUplinks", "totalUplinks", "lastFailureAt", "failureRatio"),
    "signal_degraded": _check("signal-degraded", {"lookbackHours": 720, "rssiThresholdDbm": -97, "minUplinks": 10}, "minRssiDbm", "uplinks", "avgRssiDbm", "avgSnrDb", "avgGatewaysPerUplink"),
    "threshold_latest": _check("measurement-threshold", {"paths": _LATEST, "lookbackHours": 168, "max": 40}, "measurement", "value", "breached", "readingAt"),
    "threshold_hysteresis": _check("measurement-threshold", {"paths": _LATEST, "lookbackHours": 168, "min": 10, "max": 60, "clearMargin": 8}, "value", "breached", opened=True),
    "battery_low": _check("battery-low", {"paths": ["k"], "raiseAtVolts": 20, "clearAtVolts": 45, "criticalAtVolts": 10, "lookbackHours": 168}, "measurement", "value", opened=True),
    "boolean_alarm": _check("boolean-alarm", {"paths": ["missing", "flag"], "lookbackHours": 720}, "measurement", "rawValue", "readingAt"),
    "geofence_box": _check("geofence-breach", {"north": 46.0, "south": 41.0, "east": -91.0, "west": -94.5, "clearMargin": 0.5, "lookbackHours": 720}, "latitude", "longitude", "outsideEdges", opened=True),
    "geofence_radius": _check("geofence-breach", {"shape": "radius", "centerLat": 45.0, "centerLon": -92.5, "radiusMetres": 400000, "clearMargin": 50000, "lookbackHours": 720}, "latitude", "longitude", "distanceMetres:3", opened=True),
    "measurement_peak": _check("measurement-peak", {"paths": _WINDOW, "threshold": 200, "lookbackHours": 720}, "measurement", "peak", "samples", "windowMin", "windowMax"),
    "measurement_rate": _check("measurement-rate", {"paths": _WINDOW, "maxRatePerHour": 0.1, "lookbackHours": 720}, "measurement", "ratePerHour", "firstValue", "lastValue", "spanHours", "samples"),
    "measurement_stuck": _check("measurement-stuck", {"paths": _WINDOW, "lookbackHours": 720, "minSamples": 3, "decimals": 0, "maxDistinctValues": 5}, "measurement", "value", "samples", "distinctValues"),
    "counter_stalled": _check("counter-stalled", {"paths": _WINDOW, "lookbackHours": 720, "minAdvance": 20}, "measurement", "reason", "firstValue", "lastValue", "samples"),
    "counter_spike": _check("counter-spike", {"paths": _WINDOW, "lookbackHours": 720, "maxRatePerHour": 0.2}, "measurement", "ratePerHour", "advance", "samples"),
    "measurement_missing": _check("measurement-missing", {"paths": ["purchase.value"], "lookbackHours": 720, "recentHours": 120, "minHistoricalSightings": 5}, "measurement", "historicalSightings", "recentUplinks", "lastSeenAt"),
    "device_log_error": _check("device-log-error", {"lookbackHours": 720}, "events", "worstLevel", "codes", "latestDescription", "latestAt", "eventsPerHour"),
    "status_battery_low": _check("status-battery-low", {}, "batteryPercent", "statusReadingsInWindow", "readingAt", opened=True),
    "status_margin_low": _check("status-margin-low", {"minMarginDb": -10, "criticalMarginDb": -25, "lookbackHours": 720}, "avgMarginDb", "minMarginDb", "latestMarginDb", "statusReadings", "latestAt"),
    "join_churn": _check("join-churn", {"maxJoinsPerUplinkRatio": None}, "joins", "distinctDevAddrs", "uplinksInWindow", "latestJoinAt"),
    "join_churn_ratio": _check("join-churn", {"maxJoins": 9, "maxJoinsPerUplinkRatio": 0.3}, "joins", "uplinksInWindow", "joinsPerUplink"),
    "downlink_unacked": _check("downlink-unacked", {"lookbackHours": 720}, "unacked", "totalConfirmedDownlinks", "unackedRatio", "latestUnackedAt", "latestFCntDown"),
    "latest_readings": _resolver(lambda up: R.latest_readings(up, _paths(_LATEST), 168, Scope(), AS_OF)),
    "latest_flags": _resolver(lambda up: R.latest_flags(up, _paths(["flag"]), 168, Scope(), ["OPEN"], AS_OF)),
    "latest_fixes": _resolver(lambda up: R.latest_fixes(up, _paths(["position.latitude"]), _paths(["gps.lon", "position.longitude"]), 168, Scope(), AS_OF)),
    "window_stats": _resolver(lambda up: R.window_stats(up, _paths(_WINDOW), 720, Scope(), AS_OF)),
    "window_stats_partials": window_stats_partials,
    "silence_stream": silence_stream,
    "path_presence": _resolver(lambda up: R.path_presence(up, _paths(["signup.value", "error.value", "k"]), 720, 120, Scope(), AS_OF)),
    "reconcile_two_passes": reconcile_two_passes,
    "open_alerts": open_alerts,
    "status_top": status_top,
    "routing_precedence": routing_precedence,
    "severity_precedence": severity_precedence,
    "profile_census": profile_census,
    "calibration": calibration,
    "counter_advance": counter_advance,
    "latest_readings_sql": _by_sql("latest_readings(array('click.value', 'view.value', 'k'), {at}, 168)"),
    "latest_fixes_sql": _by_sql("latest_fixes(array('position.latitude'), array('gps.lon', 'position.longitude'), {at}, 168)"),
    "window_stats_sql": _by_sql("window_stats(array('purchase.value', 'k'), {at}, 720)"),
    "path_presence_sql": _by_sql("path_presence(array('signup.value', 'error.value', 'k'), 120, {at}, 720)"),
    "census_of_days": census_of_days,
    "calibration_sketch": calibration_sketch,
    "join_churn_by_device": churn_by_device,
    "context_query": context_query,
    "full_pass": full_pass,
}

_SILENT = """SELECT dev_eui, max(device_name) AS device_name, max(ts) AS last, count(*) AS n FROM ev
  WHERE ts <= TIMESTAMP '{at}' AND ts > TIMESTAMP '{at}' - INTERVAL '168 hours' {more} GROUP BY dev_eui
  HAVING count(*) >= 5 AND max(ts) < TIMESTAMP '{at}' - INTERVAL '720 minutes'"""
_FIRST, _OPENED = "2024-01-27 00:00:00", "(CAST(dev_eui AS BIGINT) % 3 = 0)"
_TWO = f"""{_EV}, a AS ({_SILENT.format(at=_FIRST, more='')}), b AS ({_SILENT.format(at=AS_OF, more='')})"""

ORACLES: dict[str, str] = {
    "device_silent": f"""{_EV} SELECT dev_eui, device_name, 'critical' AS severity, last AS "lastSeen",
        CAST(round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last)) / 6e7) AS BIGINT) AS "silentMinutes", n AS "uplinksInWindow"
        FROM ({_SILENT.format(at=AS_OF, more='')})""",
    "device_silent_scoped": f"""{_EV} SELECT dev_eui, device_name, 'critical' AS severity, n AS "uplinksInWindow"
        FROM ({_SILENT.format(at=AS_OF, more="AND profile IN ('profile-1', 'profile-2') AND device_name LIKE 'dev-1%'")})""",
    "decode_failure": f"""{_EV} SELECT dev_eui, max(device_name) AS device_name, CASE WHEN count(*) FILTER (NOT has) / count(*) >= 0.99 THEN 'critical' ELSE 'warning' END AS severity,
        max(profile) AS "deviceProfileName", count(*) FILTER (NOT has) AS "undecodedUplinks", count(*) AS "totalUplinks", max(ts) FILTER (NOT has) AS "lastFailureAt", {_rounded('count(*) FILTER (NOT has)', 'count(*)', 3)} AS "failureRatio"
        FROM e2 WHERE {_since(720)} GROUP BY dev_eui HAVING count(*) FILTER (NOT has) >= 5 AND count(*) FILTER (NOT has) / count(*) >= 0.3""",
    "signal_degraded": f"""{_EV}, g AS (SELECT *, greatest(-80 - k % 50, -85 - k % 40) AS rssi, k % 12 - 6 AS snr FROM e2 WHERE k % 7 <> 0 AND {_since(720)})
        SELECT dev_eui, max(device_name) AS device_name, 'info' AS severity, CAST(min(rssi) AS DOUBLE) AS "minRssiDbm", count(*) AS uplinks,
        {_rounded('sum(rssi)', 'count(*)', 1)} AS "avgRssiDbm", {_rounded('sum(snr)', 'count(*)', 1)} AS "avgSnrDb", CAST(2 AS DOUBLE) AS "avgGatewaysPerUplink"
        FROM g GROUP BY dev_eui HAVING count(*) >= 10 AND sum(rssi) <= -97 * count(*)""",
    "threshold_latest": f"""{_EV}, {_NEWEST.format(since=_since(168))}, {_READING}
        SELECT dev_eui, device_name, 'warning' AS severity, matched_path AS measurement, value, 'max' AS breached, ts AS "readingAt" FROM reading WHERE value > 40""",
    "threshold_hysteresis": f"""{_EV}, {_NEWEST.format(since=_since(168))}, {_READING}, x AS (SELECT *, CASE WHEN {_OPENED} THEN 8.0 ELSE 0.0 END AS m FROM reading)
        SELECT dev_eui, device_name, 'warning' AS severity, value, CASE WHEN value < 10 + m THEN 'min' ELSE 'max' END AS breached FROM x WHERE value < 10 + m OR value > 60 - m""",
    "battery_low": f"""{_EV}, {_NEWEST.format(since=_since(168))} SELECT dev_eui, device_name, CASE WHEN k <= 10 THEN 'critical' ELSE 'warning' END AS severity,
        'k' AS measurement, CAST(k AS DOUBLE) AS value FROM newest WHERE has AND k <= CASE WHEN {_OPENED} THEN 45 ELSE 20 END""",
    "boolean_alarm": f"""{_EV}, {_NEWEST.format(since=_since(720))} SELECT dev_eui, device_name, 'critical' AS severity, 'flag' AS measurement, 'Open' AS "rawValue", ts AS "readingAt"
        FROM newest WHERE has AND k >= 90""",
    "geofence_box": f"""{_EV}, {_NEWEST.format(since=_since(720))}, x AS (SELECT *, CAST(CAST(k / 10 + 40 AS DECIMAL(6,1)) AS DOUBLE) AS lat, CAST(CAST(k / 20 - 95 AS DECIMAL(6,2)) AS DOUBLE) AS lon,
        CASE WHEN {_OPENED} THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS m FROM newest WHERE has),
        y AS (SELECT *, list_filter([CASE WHEN lat > 46 + m THEN 'north' END, CASE WHEN lat < 41 - m THEN 'south' END, CASE WHEN lon > -91 + m THEN 'east' END, CASE WHEN lon < -94.5 - m THEN 'west' END], lambda z: z IS NOT NULL) AS edges FROM x)
        SELECT dev_eui, device_name, 'critical' AS severity, lat AS latitude, lon AS longitude, edges AS "outsideEdges" FROM y WHERE len(edges) > 0""",
    "geofence_radius": f"""{_EV}, {_NEWEST.format(since=_since(720))}, x AS (SELECT *, CAST(CAST(k / 10 + 40 AS DECIMAL(6,1)) AS DOUBLE) AS lat, CAST(CAST(k / 20 - 95 AS DECIMAL(6,2)) AS DOUBLE) AS lon FROM newest WHERE has),
        y AS (SELECT *, 2 * 6371008.8 * asin(sqrt(least(1.0, sin(radians(lat - 45) / 2) ** 2 + cos(radians(45.0)) * cos(radians(lat)) * sin(radians(lon + 92.5) / 2) ** 2))) AS d FROM x)
        SELECT dev_eui, device_name, 'critical' AS severity, lat AS latitude, lon AS longitude, round(d, 3) AS "distanceMetres" FROM y WHERE d > CASE WHEN {_OPENED} THEN 350000 ELSE 400000 END""",
    "measurement_peak": _stats_sql("""SELECT dev_eui, device_name, 'warning' AS severity, matched_path AS measurement, vmax AS peak, samples, vmin AS "windowMin", vmax AS "windowMax"
        FROM s WHERE samples >= 3 AND vmax > 200"""),
    "measurement_rate": _stats_sql("""SELECT dev_eui, device_name, 'warning' AS severity, matched_path AS measurement, (vlast - vfirst) / span_hours AS "ratePerHour",
        vfirst AS "firstValue", vlast AS "lastValue", span_hours AS "spanHours", samples FROM s WHERE samples >= 4 AND span_hours >= 1 AND (vlast - vfirst) / span_hours < -0.1"""),
    "measurement_stuck": _stats_sql("""SELECT dev_eui, device_name, 'warning' AS severity, matched_path AS measurement, CAST(round(CAST(vlast AS DECIMAL(18,2)), 0) AS DOUBLE) AS value, samples,
        whole_values AS "distinctValues" FROM s WHERE samples >= 3 AND whole_values <= 5"""),
    "counter_stalled": _stats_sql("""SELECT dev_eui, device_name, CASE WHEN vlast < vfirst THEN 'critical' ELSE 'warning' END AS severity, matched_path AS measurement,
        CASE WHEN vlast < vfirst THEN 'decrease' ELSE 'stalled' END AS reason, vfirst AS "firstValue", vlast AS "lastValue", samples FROM s WHERE samples >= 4 AND vlast - vfirst < 20"""),
    "counter_spike": _stats_sql("""SELECT dev_eui, device_name, 'critical' AS severity, matched_path AS measurement, (vlast - vfirst) / span_hours AS "ratePerHour", vlast - vfirst AS advance, samples
        FROM s WHERE samples >= 3 AND span_hours >= 0.5 AND vlast >= vfirst AND (vlast - vfirst) / span_hours > 0.2"""),
    "measurement_missing": f"""{_EV}, p AS (SELECT dev_eui, max(device_name) AS device_name, count(*) FILTER (has AND event_type = 'purchase') AS ever,
        count(*) FILTER (has AND event_type = 'purchase' AND {_since(120)}) AS now, count(*) FILTER ({_since(120)}) AS ups, max(ts) FILTER (has AND event_type = 'purchase') AS last FROM e2 WHERE {_since(720)} GROUP BY dev_eui)
        SELECT dev_eui, device_name, 'warning' AS severity, 'purchase.value' AS measurement, ever AS "historicalSightings", ups AS "recentUplinks", last AS "lastSeenAt" FROM p WHERE ever >= 5 AND ups >= 5 AND now = 0""",
    "device_log_error": f"""{_EV} SELECT dev_eui, max(device_name) AS device_name, 'critical' AS severity, count(*) AS events, CAST(2 AS INTEGER) AS "worstLevel",
        list_sort(list(DISTINCT CAST(k % 10 AS VARCHAR))) AS codes, {_rounded('count(*)', '720', 2)} AS "eventsPerHour",
        arg_max('code ' || (k % 10), (ts, event_id)) AS "latestDescription", max(ts) AS "latestAt" FROM e2 WHERE event_type = 'error' AND k % 3 = 2 AND k % 10 <> 7 AND {_since(720)} GROUP BY dev_eui HAVING count(*) >= 3""",
    "status_battery_low": f"""{_EV}, b AS (SELECT dev_eui, arg_max(device_name, (ts, id)) AS device_name, CAST(arg_max(CAST(value AS FLOAT), (ts, id)) AS DOUBLE) AS battery, count(*) AS n, max(ts) AS seen_at
        FROM e2 WHERE event_type = 'view' AND value IS NOT NULL AND k % 7 <> 0 AND k % 5 <> 0 AND CAST(value AS FLOAT) <= 25 AND {_since(336)} GROUP BY dev_eui)
        SELECT dev_eui, device_name, CASE WHEN battery <= 10 THEN 'critical' ELSE 'warning' END AS severity, battery AS "batteryPercent", n AS "statusReadingsInWindow", seen_at AS "readingAt"
        FROM b WHERE battery <= CASE WHEN {_OPENED} THEN 25 ELSE 20 END""",
    "status_margin_low": f"""{_EV}, m AS (SELECT dev_eui, max(device_name) AS device_name, sum(k - 60) AS t, count(*) AS n, min(k - 60) AS least, arg_max(k - 60, (ts, id)) AS latest, max(ts) AS seen_at
        FROM e2 WHERE event_type = 'view' AND {_since(720)} GROUP BY dev_eui)
        SELECT dev_eui, device_name, CASE WHEN round(CAST(t AS DECIMAL(18,6)) / n, 1) <= -25 THEN 'critical' ELSE 'warning' END AS severity, {_rounded(_rounded4('t', 'n'), '10000', 1)} AS "avgMarginDb", CAST(least AS BIGINT) AS "minMarginDb", CAST(latest AS BIGINT) AS "latestMarginDb", n AS "statusReadings", seen_at AS "latestAt"
        FROM m WHERE n >= 3 AND t <= -10 * n""",
    "join_churn": f"""{_EV}, j AS (SELECT dev_eui, max(device_name) AS device_name, count(*) AS joins, count(DISTINCT k) AS addrs, max(ts) AS last FROM e2 WHERE event_type = 'signup' AND {_since(168)} GROUP BY dev_eui),
        u AS (SELECT dev_eui, count(*) AS n FROM e2 WHERE {_since(168)} GROUP BY dev_eui)
        SELECT dev_eui, device_name, CASE WHEN coalesce(n, 0) = 0 OR joins / greatest(coalesce(n, 0), 1) >= 1 THEN 'critical' ELSE 'warning' END AS severity, joins, addrs AS "distinctDevAddrs",
        coalesce(n, 0) AS "uplinksInWindow", last AS "latestJoinAt" FROM j LEFT JOIN u USING (dev_eui) WHERE joins > 3""",
    "join_churn_ratio": f"""{_EV}, j AS (SELECT dev_eui, max(device_name) AS device_name, count(*) AS joins FROM e2 WHERE event_type = 'signup' AND {_since(168)} GROUP BY dev_eui),
        u AS (SELECT dev_eui, count(*) AS n FROM e2 WHERE {_since(168)} GROUP BY dev_eui)
        SELECT dev_eui, device_name, CASE WHEN joins / n >= 1 THEN 'critical' ELSE 'warning' END AS severity, joins, n AS "uplinksInWindow", joins / n AS "joinsPerUplink"
        FROM j JOIN u USING (dev_eui) WHERE joins > 9 OR (n >= 5 AND joins / n > 0.3)""",
    "downlink_unacked": f"""{_EV}, a AS (SELECT dev_eui, max(device_name) AS device_name, count(*) FILTER (k % 5 = 0 OR k < 50) AS lost, count(*) AS n, max(ts) FILTER (k % 5 = 0 OR k < 50) AS last,
        arg_max(event_id, (ts, id)) FILTER (k % 5 = 0 OR k < 50) AS frame FROM e2 WHERE event_type = 'purchase' AND {_since(720)} GROUP BY dev_eui)
        SELECT dev_eui, device_name, 'critical' AS severity, lost AS unacked, n AS "totalConfirmedDownlinks", {_rounded('lost', 'n', 3)} AS "unackedRatio", last AS "latestUnackedAt", frame AS "latestFCntDown" FROM a WHERE lost >= 2 AND lost / n >= 0.5""",
    "latest_readings": f"{_EV}, {_NEWEST.format(since=_since(168))}, {_READING} SELECT dev_eui, device_name, matched_path, value, ts AS at FROM reading",
    "latest_flags": f"""{_EV}, {_NEWEST.format(since=_since(168))} SELECT dev_eui, device_name, 'flag' AS matched_path, CASE WHEN k >= 90 THEN 'Open' ELSE 'closed' END AS raw, k >= 90 AS value, ts AS at FROM newest WHERE has""",
    "latest_fixes": f"""{_EV}, {_NEWEST.format(since=_since(168))} SELECT dev_eui, device_name, CAST(CAST(k / 10 + 40 AS DECIMAL(6,1)) AS DOUBLE) AS lat, CAST(CAST(k / 20 - 95 AS DECIMAL(6,2)) AS DOUBLE) AS lon, ts AS at FROM newest WHERE has""",
    "window_stats": _stats_sql("SELECT dev_eui, device_name, matched_path, vmin, vmax, vavg, vfirst, vlast, samples, distinct_values, first_at, last_at, mean FROM s"),
    "window_stats_partials": _stats_sql("SELECT dev_eui, device_name, matched_path, vmin, vmax, vavg, vfirst, vlast, samples, distinct_values, first_at, last_at, mean FROM s", _EDGES[1]).replace(AS_OF, _EDGES[0]),
    # As of the watermark: the newest uplink of all, less what rows may be late, down to the second.
    "silence_stream": f"""{_EV}, clock AS (SELECT date_trunc('second', max(ts) - INTERVAL '{_LATE_MINUTES} minutes') AS now FROM ev)
        SELECT dev_eui, max(device_name) AS device_name, max(ts) AS last_seen FROM ev, clock WHERE ts <= now AND ts > now - INTERVAL '168 hours'
        GROUP BY dev_eui, now HAVING count(*) >= 5 AND max(ts) < now - INTERVAL '720 minutes'""",
    "path_presence": f"""{_EV}, p AS (SELECT dev_eui, max(device_name) AS device_name, count(*) FILTER ({_since(120)}) AS ups,
        count(*) FILTER (has AND event_type = 'signup') AS e0, count(*) FILTER (has AND event_type = 'error') AS e1, count(*) FILTER (has) AS e2c,
        count(*) FILTER (has AND event_type = 'signup' AND {_since(120)}) AS n0, count(*) FILTER (has AND event_type = 'error' AND {_since(120)}) AS n1, count(*) FILTER (has AND {_since(120)}) AS n2,
        max(ts) FILTER (has AND event_type = 'signup') AS l0, max(ts) FILTER (has AND event_type = 'error') AS l1, max(ts) FILTER (has) AS l2 FROM e2 WHERE {_since(720)} GROUP BY dev_eui)
        SELECT dev_eui, device_name, CASE WHEN e0 > 0 THEN 'signup.value' WHEN e1 > 0 THEN 'error.value' ELSE 'k' END AS matched_path, CASE WHEN e0 > 0 THEN e0 WHEN e1 > 0 THEN e1 ELSE e2c END AS ever_seen,
        CASE WHEN e0 > 0 THEN n0 WHEN e1 > 0 THEN n1 ELSE n2 END AS recent_seen, ups AS recent_uplinks, CASE WHEN e0 > 0 THEN l0 WHEN e1 > 0 THEN l1 ELSE l2 END AS last_seen_at FROM p WHERE e0 > 0 OR e1 > 0 OR e2c > 0""",
    "reconcile_two_passes": f"""{_TWO} SELECT 'device-silent' AS kind, coalesce(b.dev_eui, a.dev_eui) AS dev_eui, coalesce(b.device_name, a.device_name) AS device_name, 'critical' AS severity,
        CASE WHEN a.dev_eui IS NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{_FIRST}' END AS raised_at, CASE WHEN b.dev_eui IS NULL THEN TIMESTAMP '{_FIRST}' ELSE TIMESTAMP '{AS_OF}' END AS last_seen_at,
        CASE WHEN b.dev_eui IS NULL THEN TIMESTAMP '{AS_OF}' END AS resolved_at FROM a FULL JOIN b ON a.dev_eui = b.dev_eui""",
    "open_alerts": f"""{_TWO} SELECT 'device-silent' AS kind, b.dev_eui, CASE WHEN a.dev_eui IS NULL THEN 0.0 ELSE 96.0 END::DOUBLE AS open_hours FROM b LEFT JOIN a ON a.dev_eui = b.dev_eui""",
    "status_top": f"""{_EV}, f AS (
        SELECT 'critical' AS severity, 'device-log-error' AS kind, dev_eui FROM e2 WHERE event_type = 'error' AND k % 3 = 2 AND k % 10 <> 7 AND {_since(720)} GROUP BY dev_eui HAVING count(*) >= 3
        UNION ALL SELECT 'critical', 'downlink-unacked', dev_eui FROM e2 WHERE event_type = 'purchase' AND {_since(720)} GROUP BY dev_eui HAVING count(*) FILTER (k % 5 = 0 OR k < 50) >= 2 AND count(*) FILTER (k % 5 = 0 OR k < 50) / count(*) >= 0.5
        UNION ALL SELECT CASE WHEN round(CAST(sum(k - 60) AS DECIMAL(18,6)) / count(*), 1) <= -25 THEN 'critical' ELSE 'warning' END, 'status-margin-low', dev_eui FROM e2 WHERE event_type = 'view' AND {_since(720)} GROUP BY dev_eui HAVING count(*) >= 3 AND sum(k - 60) <= -10 * count(*))
        SELECT severity, kind, dev_eui FROM f ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, dev_eui, kind LIMIT 20""",
    "routing_precedence": """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'desk' WHEN user_id % 3 = 0 THEN 'pager' WHEN user_id % 3 = 2 THEN NULL
        WHEN event_type = 'view' THEN 'mail' WHEN event_type = 'click' THEN 'sms' ELSE 'log' END AS destination FROM events""",
    "severity_precedence": f"""{_EV} SELECT 'noisy' AS kind, dev_eui, CASE WHEN max(k % 3) >= 2 THEN 'critical' ELSE 'info' END AS severity FROM e2
        WHERE event_type = 'error' AND k % 3 >= 1 AND k % 10 <> 7 AND {_since(720)} GROUP BY dev_eui HAVING count(*) >= 3""",
    "profile_census": f"{_EV} SELECT profile AS device_profile_name, count(*) AS uplinks, count(DISTINCT dev_eui) AS devices FROM ev GROUP BY profile",
    "calibration": f"""{_EV} SELECT profile AS device_profile_name, CAST(min(v) AS DOUBLE) AS least, round(quantile_cont(CAST(v AS DOUBLE), 0.05), 6) AS p05, CAST(max(v) AS DOUBLE) AS greatest
        FROM e2 WHERE has AND event_type = 'purchase' AND {_since(720)} GROUP BY profile""",
    "counter_advance": _stats_sql("""SELECT dev_eui, CASE WHEN ord = 0 THEN 'purchase.value' ELSE 'k' END AS matched_path, count(*) AS readings,
        count(*) FILTER (num < last) AS resets, CAST(coalesce(sum(CASE WHEN num < last THEN num ELSE num - last END) FILTER (last IS NOT NULL), 0) AS DOUBLE) AS advance
        FROM (SELECT *, lag(num) OVER (PARTITION BY dev_eui, ord ORDER BY ts, id) AS last FROM r JOIN won USING (dev_eui, ord)) GROUP BY dev_eui, ord"""),
    "census_of_days": f"{_EV} SELECT profile AS device_profile_name, count(*) AS uplinks, count(DISTINCT dev_eui) AS devices FROM ev WHERE CAST(ts AS DATE) BETWEEN '{_DAYS[0]}' AND '{_DAYS[1]}' GROUP BY profile",
    "calibration_sketch": f"""{_EV} SELECT profile AS device_profile_name, count(*) AS n, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS greatest, true AS p05_near
        FROM ev WHERE k % 10 > 2 AND event_type = 'purchase' AND CAST(ts AS DATE) BETWEEN '{_DAYS[0]}' AND '{_DAYS[1]}' GROUP BY profile""",
    "context_query": f"{_EV} SELECT dev_eui, count(*) AS acks FROM ev WHERE event_type = 'purchase' AND k % 5 <> 0 AND k >= 50 AND ts > TIMESTAMP '2024-01-10 00:00:00' GROUP BY dev_eui",
}

ORACLES["join_churn_by_device"] = ORACLES["join_churn"]
ORACLES |= {f"{name}_sql": ORACLES[name] for name in ("latest_readings", "latest_fixes", "path_presence")}
ORACLES["window_stats_sql"] = ORACLES["window_stats"].replace("last_at, mean FROM s", "last_at FROM s")
#: The pass starts without alerts, so every finding is raised and none is judged by a clearing limit.
ORACLES["full_pass"] = " UNION ALL ".join(
    f"SELECT '{_kind(name)}' AS kind, 'ok' AS status, count(*) AS findings, count(*) AS raised, CAST(0 AS BIGINT) AS resolved FROM ({ORACLES[name].replace(_OPENED, 'false')})"
    for name, q in QUERIES.items()
    if hasattr(q, "spec")
)
