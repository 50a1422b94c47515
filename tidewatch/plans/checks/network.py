"""Checks on the network's own events: silence, decoding, signal, logs, status, joins and commands.

Sums over many uplinks are first grouped by device and name: Spark hashes these, while a greatest
string beside them would make it sort all rows. Only a row for each name is left for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import params as P
from ...functions import payload
from ...operators import resolvers as R
from ...operators.folds import Fold
from .base import COMMON, Check, Context, finding, graded, told

c = F.col


def _rows(ctx: Context, table: str, hours: float) -> DataFrame:
    return R.window(ctx.table(table), ctx.as_of, hours, ctx.scope)


def _silent_fold(ctx: Context) -> Fold:
    return Fold(P.whole(dict(ctx.params), "inventoryHours", 1), ctx.scope, values={"last_seen": ("max", lambda own: c("time"))})


def _silent(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    limit, least = P.number(p, "silentMinutes"), P.whole(p, "minUplinks", 1)
    if limit <= 0:
        raise P.ParamError("silentMinutes must be above 0")
    up = ctx.table("event_up")
    df = ctx.folded(_silent_fold(ctx)).groupBy("dev_eui").agg(
        F.max("device_name").alias("device_name"), F.max("last_seen").alias("last_seen"), F.sum("rows").alias("uplinks")
    )
    df = df.filter((c("uplinks") >= least) & (c("last_seen") < R.since(up, ctx.as_of, minutes=limit)))
    minutes = F.round(R.hours_between(c("last_seen"), R.moment(up, ctx.as_of)) * 60).cast("long")
    df = df.withColumn("minutes", minutes)
    ago = (
        F.when(c("minutes") >= 1440, F.format_string("%d d", F.floor(c("minutes") / 1440)))
        .when(c("minutes") >= 60, F.format_string("%d h", F.floor(c("minutes") / 60)))
        .otherwise(F.format_string("%d min", c("minutes")))
    )
    return finding(
        df,
        "critical",
        told("nothing heard for %s", ago),
        order=F.unix_micros(c("last_seen").cast("timestamp")),
        lastSeen=c("last_seen"),
        silentMinutes=c("minutes"),
        thresholdMinutes=F.lit(limit),
        uplinksInWindow=c("uplinks"),
    )


def _ratio(p: dict, key: str) -> float:
    value = P.number(p, key)
    if not 0 < value <= 1:
        raise P.ParamError(f"{key} must be above 0 and 1 at most")
    return value


def _decode_fold(ctx: Context) -> Fold:
    row = {"failed_at": lambda own: F.when(payload.is_undecoded(v=c("_v")), c("time"))}
    values = {"failed": ("count", lambda own: own("failed_at")), "last_failure": ("max", lambda own: own("failed_at"))}
    return Fold(P.whole(dict(ctx.params), "lookbackHours", 1), ctx.scope, row, values, parses=True)


def _decode_failure(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    hours, least, ratio = P.whole(p, "lookbackHours", 1), P.whole(p, "minFailures", 1), _ratio(p, "minFailureRatio")
    df = ctx.folded(_decode_fold(ctx)).groupBy("dev_eui").agg(
        F.max("device_name").alias("device_name"),
        F.max("device_profile_name").alias("profile"),
        F.sum("failed").alias("failed"),
        F.sum("rows").alias("total"),
        F.max("last_failure").alias("last_failure"),
    )
    df = df.withColumn("ratio", c("failed") / c("total")).filter((c("failed") >= least) & (c("ratio") >= ratio))
    return finding(
        df,
        graded(c("ratio") >= 0.99, "warning"),
        told("%d of %d uplinks not decoded", "failed", "total"),
        order=-c("failed"),
        deviceProfileName=c("profile"),
        undecodedUplinks=c("failed"),
        totalUplinks=c("total"),
        failureRatio=F.round("ratio", 3),
        lastFailureAt=c("last_failure"),
        lookbackHours=F.lit(hours),
    )


def _signal_fold(ctx: Context) -> Fold:
    best = lambda own, k: F.array_max(F.transform(own("heard_by"), lambda g: g[k].try_cast("decimal(12,3)")))
    row = {
        "heard_by": lambda own: F.when(F.json_array_length("rx_info") > 0, F.from_json("rx_info", "array<struct<rssi: string, snr: string>>")),
        "rssi": lambda own: best(own, "rssi"),
        "snr": lambda own: F.when(own("rssi").isNotNull(), best(own, "snr")),
        "gateways": lambda own: F.when(own("rssi").isNotNull(), F.json_array_length("rx_info")),
    }
    each = lambda k: lambda own: own(k)
    values = {"rssi": ("sum", each("rssi")), "least": ("min", each("rssi")), "n": ("count", each("rssi"))}
    values |= {"snr": ("sum", each("snr")), "n_snr": ("count", each("snr")), "gateways": ("sum", each("gateways"))}
    return Fold(P.whole(dict(ctx.params), "lookbackHours", 1), ctx.scope, row, values)


def _signal(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    hours, rssi, snr, least = P.whole(p, "lookbackHours", 1), P.number(p, "rssiThresholdDbm"), P.optional(p, "snrThresholdDb"), P.whole(p, "minUplinks", 1)
    df = ctx.folded(_signal_fold(ctx)).filter("n > 0").groupBy("dev_eui").agg(
        F.max("device_name").alias("device_name"),
        (F.sum("rssi") / F.sum("n")).alias("avg_rssi"),
        F.min("least").alias("min_rssi"),
        F.try_divide(F.sum("snr"), F.sum("n_snr")).alias("avg_snr"),
        F.sum("n").alias("uplinks"),
        (F.sum("gateways") / F.sum("n")).alias("avg_gateways"),
    )
    weak = c("avg_rssi") <= rssi
    if snr is not None:
        weak = weak | F.coalesce(c("avg_snr") <= snr, F.lit(False))
    df = df.filter((c("uplinks") >= least) & weak)
    return finding(
        df,
        "info",
        told("mean signal %.1f dBm over %d uplinks", c("avg_rssi").cast("double"), "uplinks"),
        order=c("avg_rssi") * 1_000_000,
        avgRssiDbm=F.round("avg_rssi", 1).cast("double"),
        minRssiDbm=c("min_rssi").cast("double"),
        avgSnrDb=F.round("avg_snr", 1).cast("double"),
        rssiThresholdDbm=F.lit(rssi),
        snrThresholdDb=F.lit(snr).cast("double"),
        uplinks=c("uplinks"),
        avgGatewaysPerUplink=F.round("avg_gateways", 1),
        lookbackHours=F.lit(hours),
    )


def _log_error(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    hours, level, least = P.whole(p, "lookbackHours", 1), P.whole(p, "minLevel"), P.whole(p, "minEvents", 1)
    codes = P.strings(p, "excludeCodes")
    rank = F.when(c("level").rlike(r"\A[0-9]+\z"), c("level").try_cast("int"))
    df = _rows(ctx, "event_log", hours).withColumn("rank", rank).filter(c("rank") >= level)
    if codes:
        df = df.filter(~c("code").isin(codes))  # a null code is left out as well
    df = df.groupBy("dev_eui").agg(
        F.max("device_name").alias("device_name"),
        F.count("*").alias("events"),
        F.max("rank").alias("worst"),
        F.array_sort(F.collect_set(F.coalesce("code", F.lit("")))).alias("codes"),
        F.max_by("description", F.struct("time", "id")).alias("description"),
        F.max("time").alias("latest"),
    )
    df = df.filter(c("events") >= least)
    return finding(
        df,
        graded(c("worst") >= 2, "warning"),
        told("%d errors (%s), last: %s", "events", F.array_join("codes", ","), F.substring(F.coalesce("description", F.lit("")), 1, 160)),
        order=-(c("worst") * F.lit(1_000_000_000_000) + c("events")),
        events=c("events"),
        worstLevel=c("worst"),
        codes=c("codes"),
        latestDescription=c("description"),
        latestAt=c("latest"),
        lookbackHours=F.lit(hours),
        minLevel=F.lit(level),
        excludedCodes=F.array(*[F.lit(x) for x in codes]).cast("array<string>"),
        eventsPerHour=F.round(c("events") / hours, 2),
    )


def _status_battery(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    raise_at, clear_at, critical = P.number(p, "raiseAtPercent"), P.number(p, "clearAtPercent"), P.optional(p, "criticalAtPercent")
    hours, mains, newest_first = P.rounded(p, "lookbackHours"), P.flag(p, "ignoreExternalPower"), bool(p.get("latestFirst"))
    if clear_at < raise_at:
        raise P.ParamError("clearAtPercent can't be below raiseAtPercent")
    if critical is not None and critical > raise_at:
        raise P.ParamError("criticalAtPercent can't be above raiseAtPercent")
    df = _rows(ctx, "event_status", hours).filter("battery_level is not null").filter(~F.coalesce("battery_level_unavailable", F.lit(False)))
    if mains:
        df = df.filter(~F.coalesce("external_power_source", F.lit(False)))
    low = c("battery_level") <= F.lit(clear_at).cast("float")
    if not newest_first:
        df = df.filter(low)  # a device keeps its last low reading until that leaves the window
    when = F.struct("time", "deduplication_id")
    df = df.groupBy("dev_eui").agg(
        F.max_by("device_name", when).alias("device_name"),
        F.max_by("battery_level", when).alias("battery"),
        F.count("*").alias("readings"),
        F.max("time").alias("at"),
    )
    df = ctx.with_open(df).withColumn("battery", c("battery").cast("double"))
    df = df.filter(c("battery") <= F.when(c("is_open"), clear_at).otherwise(raise_at))
    return finding(
        df,
        F.lit("warning") if critical is None else graded(c("battery") <= critical, "warning"),
        told("reports %.0f %% battery", "battery"),
        source=F.lit("event_status"),
        batteryPercent=c("battery"),
        raiseAtPercent=F.lit(raise_at),
        clearAtPercent=F.lit(clear_at),
        criticalAtPercent=F.lit(critical).cast("double"),
        statusReadingsInWindow=c("readings"),
        readingAt=c("at"),
        lookbackHours=F.lit(hours),
    )


def _status_margin(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    limit, critical = P.number(p, "minMarginDb"), P.optional(p, "criticalMarginDb")
    hours, least = P.whole(p, "lookbackHours", 1), P.whole(p, "minReadings", 1)
    when = F.struct("time", "deduplication_id")
    df = _rows(ctx, "event_status", hours).filter("margin is not null").groupBy("dev_eui").agg(
        F.max("device_name").alias("device_name"),
        F.avg(c("margin").cast("decimal(10,0)")).alias("mean"),
        F.min("margin").alias("least"),
        F.max_by("margin", when).alias("latest"),
        F.count("*").alias("readings"),
        F.max("time").alias("at"),
    )
    df = df.filter((c("readings") >= least) & (c("mean").cast("double") <= limit)).withColumn("rounded", F.round("mean", 1).cast("double"))
    return finding(
        df,
        F.lit("warning") if critical is None else graded(c("rounded") <= critical, "warning"),
        told("mean link margin %.1f dB", "rounded"),
        order=c("mean") * 1_000_000,
        source=F.lit("event_status"),
        avgMarginDb=c("rounded"),
        minMarginDb=c("least").cast("long"),
        latestMarginDb=c("latest").cast("long"),
        thresholdDb=F.lit(limit),
        criticalDb=F.lit(critical).cast("double"),
        statusReadings=c("readings"),
        latestAt=c("at"),
        lookbackHours=F.lit(hours),
    )


def _churn_fold(ctx: Context) -> Fold:
    return Fold(P.whole(dict(ctx.params), "lookbackHours", 1))  # uplinks of a device under any name


def _churn(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    hours, most = P.whole(p, "lookbackHours", 1), P.whole(p, "maxJoins", 0)
    ratio, least = P.optional(p, "maxJoinsPerUplinkRatio"), P.whole(p, "minUplinksForRatio", 1)
    joins = _rows(ctx, "event_join", hours).groupBy("dev_eui").agg(
        F.max("device_name").alias("device_name"),
        F.count("*").alias("joins"),
        F.count_distinct("dev_addr").alias("addresses"),
        F.min("time").alias("first"),
        F.max("time").alias("latest"),
    )
    uplinks = ctx.folded(_churn_fold(ctx)).groupBy(c("dev_eui").alias("up_eui")).agg(F.sum("rows").alias("uplinks"))
    df = joins.join(uplinks, joins.dev_eui == uplinks.up_eui, "left").withColumn("uplinks", F.coalesce("uplinks", F.lit(0)))
    share = c("joins") / F.greatest(c("uplinks"), F.lit(1))
    hit = c("joins") > most
    if ratio is not None:
        hit = hit | ((c("uplinks") >= least) & (share > ratio))
    return finding(
        df.filter(hit),
        graded((c("uplinks") == 0) | (share >= 1), "warning"),
        told("joined %d times, %d uplinks", "joins", "uplinks"),
        order=-c("joins"),
        joins=c("joins"),
        distinctDevAddrs=c("addresses"),
        uplinksInWindow=c("uplinks"),
        joinsPerUplink=F.when(c("uplinks") > 0, c("joins") / c("uplinks")),
        maxJoins=F.lit(most),
        maxJoinsPerUplinkRatio=F.lit(ratio).cast("double"),
        firstJoinAt=c("first"),
        latestJoinAt=c("latest"),
        lookbackHours=F.lit(hours),
    )


def _unacked(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    hours, least, ratio = P.whole(p, "lookbackHours", 1), P.whole(p, "minUnacked", 1), _ratio(p, "minUnackedRatio")
    when = F.struct("time", "queue_item_id")
    df = _rows(ctx, "event_ack", hours).withColumn("lost", ~F.coalesce("acknowledged", F.lit(False))).groupBy("dev_eui").agg(
        F.max("device_name").alias("device_name"),
        F.count_if("lost").alias("unacked"),
        F.count("*").alias("total"),
        F.max(F.when(c("lost"), c("time"))).alias("latest"),
        F.max_by(F.col("f_cnt_down"), F.when(c("lost"), when)).alias("frame"),
    )
    df = df.withColumn("ratio", c("unacked") / c("total")).filter((c("unacked") >= least) & (c("ratio") >= ratio))
    return finding(
        df,
        "critical",
        told("%d of %d commands not confirmed", "unacked", "total"),
        order=-c("unacked"),
        unacked=c("unacked"),
        totalConfirmedDownlinks=c("total"),
        unackedRatio=F.round("ratio", 3),
        minUnacked=F.lit(least),
        minUnackedRatio=F.lit(ratio),
        latestUnackedAt=c("latest"),
        latestFCntDown=c("frame"),
        lookbackHours=F.lit(hours),
    )


_STATUS = (*COMMON, "deduplication_id")

CHECKS = [
    Check(
        "device-silent",
        "A known device that sends nothing any more.",
        "critical",
        {"silentMinutes": 180, "inventoryHours": 168, "minUplinks": 5},
        {"event_up": COMMON},
        _silent,
        _silent_fold,
        routing="situation",
    ),
    Check(
        "decode-failure",
        "Uplinks without a decoded payload.",
        "warning",
        {"lookbackHours": 24, "minFailures": 5, "minFailureRatio": 0.5},
        {"event_up": (*COMMON, "object")},
        _decode_failure,
        _decode_fold,
    ),
    Check(
        "signal-degraded",
        "The best gateway's signal is weak on average.",
        "info",
        {"lookbackHours": 72, "rssiThresholdDbm": -115, "snrThresholdDb": None, "minUplinks": 20},
        {"event_up": (*COMMON, "rx_info")},
        _signal,
        _signal_fold,
    ),
    Check(
        "device-log-error",
        "Errors that the network logged for a device.",
        "warning",
        {"lookbackHours": 24, "minLevel": 2, "minEvents": 3, "excludeCodes": ["7"]},
        {"event_log": (*COMMON, "id", "level", "code", "description")},
        _log_error,
    ),
    Check(
        "status-battery-low",
        "Battery percentage that the device itself reports.",
        "warning",
        {"raiseAtPercent": 20, "clearAtPercent": 25, "criticalAtPercent": 10, "lookbackHours": 336, "ignoreExternalPower": True, "latestFirst": False},
        {"event_status": (*_STATUS, "battery_level", "battery_level_unavailable", "external_power_source")},
        _status_battery,
    ),
    Check(
        "status-margin-low",
        "Low mean link margin in the device's status.",
        "warning",
        {"minMarginDb": 5, "criticalMarginDb": 0, "lookbackHours": 336, "minReadings": 3},
        {"event_status": (*_STATUS, "margin")},
        _status_margin,
    ),
    Check(
        "join-churn",
        "A device that joins again and again.",
        "warning",
        {"lookbackHours": 168, "maxJoins": 3, "maxJoinsPerUplinkRatio": 0.1, "minUplinksForRatio": 5},
        {"event_join": (*COMMON, "dev_addr"), "event_up": ("time", "dev_eui")},
        _churn,
        _churn_fold,
        routing="situation",
    ),
    Check(
        "downlink-unacked",
        "Confirmed commands that the device doesn't acknowledge.",
        "critical",
        {"lookbackHours": 24, "minUnacked": 2, "minUnackedRatio": 0.5},
        {"event_ack": (*COMMON, "queue_item_id", "acknowledged", "f_cnt_down")},
        _unacked,
    ),
]
