"""Checks on readings over a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import params as P
from ...operators import counters
from ...operators import resolvers as R
from ...operators.folds import Fold
from .base import UPLINK, Check, Context, candidates, finding, graded, told

c = F.col


def _stats(ctx: Context, decimals: int | None = None) -> DataFrame:
    """Window statistics; a planner may have put readings or their partial sums into the context's tables already."""
    p = dict(ctx.params)
    paths = candidates(ctx)
    hours = P.whole(p, "lookbackHours", 1)
    stored = getattr(ctx.tables, "stats", None)
    df = stored(paths, hours, ctx.scope, decimals) if stored else None
    if df is None:
        df = R.stats_of(_readings(ctx), paths, decimals)
    return df.withColumn("span_hours", R.hours_between(c("first_at"), c("last_at")))


def _readings(ctx: Context) -> DataFrame:
    paths, hours = candidates(ctx), P.whole(dict(ctx.params), "lookbackHours", 1)
    shared = getattr(ctx.tables, "telemetry", None)
    return shared(paths, hours, ctx.scope) if shared else R.telemetry(ctx.table("event_up"), paths, hours, ctx.scope, ctx.as_of)


def _advance(ctx: Context) -> DataFrame:
    """Window statistics with advance and resets: from first to last reading, or with acrossResets between neighbours."""
    df = _stats(ctx)
    if not P.flag(dict(ctx.params), "acrossResets"):
        return df.withColumns({"advance": c("vlast") - c("vfirst"), "resets": F.lit(0).cast("bigint")})
    return df.join(counters.advances(_readings(ctx), candidates(ctx)).select("dev_eui", "advance", "resets"), "dev_eui")


def _ends(ctx: Context) -> dict[str, Column]:
    return {"candidatePaths": F.lit(P.label(candidates(ctx))), "firstAt": c("first_at"), "lastAt": c("last_at")}


def _unit(ctx: Context) -> Column:
    return F.lit(ctx.params.get("unit")).cast("string")


def _peak(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    direction = P.choice(p, "direction", ("max", "min"))
    default = "above" if direction == "max" else "below"
    comparison = P.choice({"comparison": p.get("comparison") or default}, "comparison", ("above", "below"))
    limit, least = P.number(p, "threshold"), P.whole(p, "minSamples", 1)
    df = _stats(ctx).withColumn("peak", c("vmax") if direction == "max" else c("vmin")).filter(c("samples") >= least)
    df = df.filter(c("peak") > limit if comparison == "above" else c("peak") < limit)
    return finding(
        df,
        "warning",
        told("%s %s of %s is %s %s", F.lit(direction), "matched_path", c("peak").cast("string"), F.lit(comparison), F.lit(str(limit))),
        measurement=c("matched_path"),
        peak=c("peak"),
        direction=F.lit(direction),
        comparison=F.lit(comparison),
        threshold=F.lit(limit),
        unit=_unit(ctx),
        windowAvg=c("vavg"),
        windowMin=c("vmin"),
        windowMax=c("vmax"),
        samples=c("samples"),
        lookbackHours=F.lit(P.whole(p, "lookbackHours")),
        **_ends(ctx),
    )


def _rate(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    direction = P.choice(p, "direction", ("falling", "rising", "either"))
    limit, least, span = P.number(p, "maxRatePerHour"), P.whole(p, "minSamples", 2), P.number(p, "minSpanHours")
    if limit < 0:
        raise P.ParamError("maxRatePerHour can't be negative")
    df = _stats(ctx).filter((c("samples") >= least) & (c("span_hours") >= span) & (c("span_hours") > 0))
    df = df.withColumn("rate", F.try_divide(c("vlast") - c("vfirst"), c("span_hours")))
    hit = {"falling": c("rate") < -limit, "rising": c("rate") > limit, "either": F.abs("rate") > limit}[direction]
    return finding(
        df.filter(hit),
        "warning",
        told("%s changes by %.2f per hour, limit %s", "matched_path", "rate", F.lit(str(limit))),
        measurement=c("matched_path"),
        ratePerHour=c("rate"),
        maxRatePerHour=F.lit(limit),
        direction=F.lit(direction),
        unit=_unit(ctx),
        firstValue=c("vfirst"),
        lastValue=c("vlast"),
        delta=c("vlast") - c("vfirst"),
        spanHours=c("span_hours"),
        samples=c("samples"),
        **_ends(ctx),
    )


def _stuck(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    least, decimals, most = P.whole(p, "minSamples", 2), P.whole(p, "decimals", 0), P.whole(p, "maxDistinctValues", 1)
    if decimals > 10:
        raise P.ParamError("decimals can be 10 at most")
    df = _stats(ctx, decimals).filter((c("samples") >= least) & (c("distinct_values") <= most))
    return finding(
        df,
        "warning",
        told("%s stays at %s over %d readings", "matched_path", c("vlast").cast("string"), "samples"),
        measurement=c("matched_path"),
        value=c("vlast"),
        samples=c("samples"),
        distinctValues=c("distinct_values"),
        comparedAtDecimals=F.lit(decimals),
        spanHours=c("span_hours"),
        **_ends(ctx),
    )


def _missing_fold(ctx: Context) -> Fold:
    p = dict(ctx.params)
    return R.presence(candidates(ctx), P.whole(p, "lookbackHours", 1), P.whole(p, "recentHours", 1), ctx.scope, ctx.table("event_up"), ctx.as_of)


def _missing(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    hours, recent = P.whole(p, "lookbackHours", 1), P.whole(p, "recentHours", 1)
    uplinks, history = P.whole(p, "minRecentUplinks", 1), P.whole(p, "minHistoricalSightings", 1)
    if recent >= hours:
        raise P.ParamError("recentHours must be below lookbackHours")
    paths = candidates(ctx)
    df = R.presence_of(ctx.folded(_missing_fold(ctx)), paths, each_path=bool(p.get("eachPath")))
    df = df.filter((c("ever_seen") >= history) & (c("recent_uplinks") >= uplinks) & (c("recent_seen") == 0))
    return finding(
        df,
        "warning",
        told("%s is gone from its last %d uplinks", "matched_path", "recent_uplinks"),
        measurement=c("matched_path"),
        historicalSightings=c("ever_seen"),
        recentSightings=c("recent_seen"),
        recentUplinks=c("recent_uplinks"),
        lastSeenAt=c("last_seen_at"),
        lookbackHours=F.lit(hours),
        recentHours=F.lit(recent),
        candidatePaths=F.lit(P.label(paths)),
    )


def _stalled(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    least, advance = P.whole(p, "minSamples", 2), P.number(p, "minAdvance")
    df = _advance(ctx).filter(c("samples") >= least)
    fell = (c("advance") < 0) | (c("resets") > 0)
    reason = F.when(fell, F.lit("decrease" if P.flag(p, "alertOnDecrease") else None)).when(c("advance") < advance, F.lit("stalled"))
    df = df.withColumn("reason", reason).filter("reason is not null")
    return finding(
        df,
        graded(c("reason") == "decrease", "warning"),
        told("%s went from %s to %s (%s)", "matched_path", c("vfirst").cast("string"), c("vlast").cast("string"), "reason"),
        measurement=c("matched_path"),
        reason=c("reason"),
        firstValue=c("vfirst"),
        lastValue=c("vlast"),
        delta=F.when(c("reason") == "decrease", c("advance")),
        advance=F.when(c("reason") == "stalled", c("advance")),
        minAdvance=F.lit(advance),
        lookbackHours=F.lit(P.whole(p, "lookbackHours")),
        samples=c("samples"),
        **_ends(ctx),
    )


def _spike(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    limit, least, span = P.number(p, "maxRatePerHour"), P.whole(p, "minSamples", 2), P.number(p, "minSpanHours")
    df = _advance(ctx).filter((c("samples") >= least) & (c("span_hours") >= span) & (c("span_hours") > 0) & (c("advance") >= 0))
    df = df.withColumn("rate", F.try_divide(c("advance"), c("span_hours"))).filter(c("rate") > limit)
    return finding(
        df,
        "critical",
        told("%s runs at %.1f per hour, limit %s", "matched_path", "rate", F.lit(str(limit))),
        measurement=c("matched_path"),
        ratePerHour=c("rate"),
        maxRatePerHour=F.lit(limit),
        advance=c("advance"),
        unit=_unit(ctx),
        firstValue=c("vfirst"),
        lastValue=c("vlast"),
        spanHours=c("span_hours"),
        samples=c("samples"),
        **_ends(ctx),
    )


_COUNTERS = ["metering.water.total", "pulse.total"]

CHECKS = [
    Check(
        "measurement-peak",
        "Greatest or least reading of a window past a limit.",
        "warning",
        {"paths": ["wind.speed"], "direction": "max", "comparison": None, "threshold": 17, "lookbackHours": 3, "minSamples": 3, "unit": " m/s"},
        UPLINK,
        _peak,
    ),
    Check(
        "measurement-rate",
        "Change per hour between a window's first and last reading past a limit.",
        "warning",
        {
            "paths": ["tank.level", "water.level", "tank.volume"], "direction": "falling", "maxRatePerHour": 5,
            "lookbackHours": 6, "minSamples": 4, "minSpanHours": 1, "unit": "%",
        },
        UPLINK,
        _rate,
    ),
    Check(
        "measurement-stuck",
        "Too few different readings in a window.",
        "warning",
        {"paths": ["soil.moisture"], "lookbackHours": 24, "minSamples": 12, "decimals": 3, "maxDistinctValues": 1},
        UPLINK,
        _stuck,
    ),
    Check(
        "measurement-missing",
        "A field that used to be there is gone from recent uplinks.",
        "warning",
        {"paths": ["soil.moisture"], "lookbackHours": 168, "recentHours": 12, "minRecentUplinks": 5, "minHistoricalSightings": 10, "eachPath": False},
        UPLINK,
        _missing,
        _missing_fold,
    ),
    Check(
        "counter-stalled",
        "A counter that doesn't advance, or goes back.",
        "warning",
        {"paths": _COUNTERS, "lookbackHours": 12, "minAdvance": 1, "minSamples": 4, "alertOnDecrease": True, "acrossResets": False},
        UPLINK,
        _stalled,
    ),
    Check(
        "counter-spike",
        "A counter that advances too fast.",
        "critical",
        {"paths": _COUNTERS, "maxRatePerHour": 500, "lookbackHours": 3, "minSamples": 3, "minSpanHours": 0.5, "unit": "L", "acrossResets": False},
        UPLINK,
        _spike,
    ),
]
