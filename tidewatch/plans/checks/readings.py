"""Checks on each device's newest decoded uplink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import geo
from ...functions import params as P
from ...operators import resolvers as R
from .base import UPLINK, Check, Context, candidates, finding, graded, told

c = F.col


def _battery_low(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    raise_at, clear_at, critical_at = P.number(p, "raiseAtVolts"), P.number(p, "clearAtVolts"), P.optional(p, "criticalAtVolts")
    if clear_at < raise_at:
        raise P.ParamError("clearAtVolts can't be below raiseAtVolts")
    if critical_at is not None and critical_at > raise_at:
        raise P.ParamError("criticalAtVolts can't be above raiseAtVolts")
    paths = candidates(ctx)
    df = ctx.with_open(R.latest_readings(ctx.table("event_up"), paths, P.rounded(p, "lookbackHours"), ctx.scope, ctx.as_of, ctx.newest()))
    df = df.filter(c("value") <= F.when(c("is_open"), clear_at).otherwise(raise_at))
    return finding(
        df,
        F.lit("warning") if critical_at is None else graded(c("value") <= critical_at, "warning"),
        told("supply at %.3f V, limit %s V", "value", F.lit(str(raise_at))),
        measurement=c("matched_path"),
        value=F.round("value", 3),
        raiseAtVolts=F.lit(raise_at),
        clearAtVolts=F.lit(clear_at),
        criticalAtVolts=F.lit(critical_at).cast("double"),
        candidatePaths=F.lit(P.label(paths)),
        readingAt=c("at"),
    )


def _threshold(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    low, high, margin = P.optional(p, "min"), P.optional(p, "max"), P.number(p, "clearMargin")
    if low is None and high is None:
        raise P.ParamError("measurement-threshold needs min, max or both")
    if low is not None and high is not None and low > high:
        raise P.ParamError("min can't be above max")
    if margin < 0:
        raise P.ParamError("clearMargin can't be negative")
    paths = candidates(ctx)
    df = ctx.with_open(R.latest_readings(ctx.table("event_up"), paths, P.whole(p, "lookbackHours", 1), ctx.scope, ctx.as_of, ctx.newest()))
    inner = F.when(c("is_open"), margin).otherwise(0.0)
    below = F.lit(False) if low is None else c("value") < F.lit(low) + inner
    above = F.lit(False) if high is None else c("value") > F.lit(high) - inner
    df = df.withColumn("breached", F.when(below, "min").when(above, "max")).filter("breached is not null")
    bound = F.when(c("breached") == "min", F.lit(low).cast("double")).otherwise(F.lit(high).cast("double"))
    return finding(
        df,
        "warning",
        told("%s at %s, %s is %s", "matched_path", c("value").cast("string"), "breached", bound.cast("string")),
        measurement=c("matched_path"),
        value=c("value"),
        unit=F.lit(p.get("unit")).cast("string"),
        min=F.lit(low).cast("double"),
        max=F.lit(high).cast("double"),
        breached=c("breached"),
        clearMargin=F.lit(margin),
        candidatePaths=F.lit(P.label(paths)),
        readingAt=c("at"),
    )


def _boolean_alarm(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    words = P.strings(p, "trueValues")
    if not words:
        raise P.ParamError("trueValues can't be empty")
    paths = candidates(ctx)
    df = R.latest_flags(ctx.table("event_up"), paths, P.whole(p, "lookbackHours", 1), ctx.scope, words, ctx.as_of, ctx.newest()).filter("value")
    return finding(
        df,
        "critical",
        told("%s (%s is %s)", F.lit(str(p.get("label"))), "matched_path", "raw"),
        measurement=c("matched_path"),
        rawValue=c("raw"),
        trueValues=F.array(*[F.lit(w) for w in words]),
        candidatePaths=F.lit(P.label(paths)),
        readingAt=c("at"),
    )


_EDGES = ("north", "south", "east", "west")


def _geofence(ctx: Context) -> DataFrame:
    p = dict(ctx.params)
    shape, margin = P.choice(p, "shape", ("box", "radius")), P.number(p, "clearMargin")
    inward = bool(p.get("inwardMargin"))
    if margin < 0:
        raise P.ParamError("clearMargin can't be negative")
    lat, lon = candidates(ctx, "latPaths"), candidates(ctx, "lonPaths")
    hours = P.whole(p, "lookbackHours", 1)
    if shape == "box":
        if any(p.get(e) is None for e in _EDGES):
            raise P.ParamError("a box fence needs north, south, east and west")
        n, s, e, w = (P.number(p, k) for k in _EDGES)
        if n <= s or e <= w:
            raise P.ParamError("north must be above south and east above west")
    else:
        if any(p.get(k) is None for k in ("centerLat", "centerLon", "radiusMetres")):
            raise P.ParamError("a radius fence needs centerLat, centerLon and radiusMetres")
        lat0, lon0, radius = (P.number(p, k) for k in ("centerLat", "centerLon", "radiusMetres"))
        if radius <= 0:
            raise P.ParamError("radiusMetres must be above 0")
    df = ctx.with_open(R.latest_fixes(ctx.table("event_up"), lat, lon, hours, ctx.scope, ctx.as_of, ctx.newest()))
    common = {"shape": F.lit(shape), "latitude": c("lat"), "longitude": c("lon"), "clearMargin": F.lit(margin), "fixAt": c("at")}
    if shape == "box":
        # An open alert widens the box by the margin; with inwardMargin it narrows it instead.
        wide = F.when(c("is_open"), -margin if inward else margin).otherwise(0.0)
        out = {"north": c("lat") > n + wide, "south": c("lat") < s - wide, "east": c("lon") > e + wide, "west": c("lon") < w - wide}
        edges = F.filter(F.array(*[F.when(hit, F.lit(k)) for k, hit in out.items()]), lambda x: x.isNotNull())
        df = df.withColumn("edges", edges).filter(F.size("edges") > 0)
        return finding(
            df,
            "critical",
            told("outside its area (%s) at %.5f, %.5f", F.array_join("edges", ", "), "lat", "lon"),
            **common,
            outsideEdges=c("edges"),
            bounds=F.struct(*[F.lit(v).alias(k) for k, v in zip(_EDGES, (n, s, e, w))]),
        )
    df = df.withColumn("metres", geo.distance(F.lit(lat0), F.lit(lon0), c("lat"), c("lon")))
    df = df.filter(c("metres") > F.when(c("is_open"), max(0.0, radius - margin)).otherwise(radius))
    return finding(
        df,
        "critical",
        told("%.0f m from its centre, allowed %.0f m", "metres", F.lit(radius)),
        **common,
        distanceMetres=c("metres"),
        radiusMetres=F.lit(radius),
        centerLat=F.lit(lat0),
        centerLon=F.lit(lon0),
    )


CHECKS = [
    Check(
        "battery-low",
        "Supply voltage of the newest decoded uplink at or below a limit; stays open up to a higher one.",
        "warning",
        {"paths": ["battery", "power.voltage"], "raiseAtVolts": 3.4, "clearAtVolts": 3.55, "criticalAtVolts": 3.2, "lookbackHours": 24},
        UPLINK,
        _battery_low,
    ),
    Check(
        "measurement-threshold",
        "Newest reading below a minimum or above a maximum; an open alert clears only past a margin.",
        "warning",
        {"paths": ["temperature", "air.temperature"], "min": None, "max": None, "clearMargin": 0, "lookbackHours": 24, "unit": ""},
        UPLINK,
        _threshold,
    ),
    Check(
        "boolean-alarm",
        "Newest state of a flag reads as true.",
        "critical",
        {"paths": ["water.leak"], "trueValues": ["true", "1", "open", "detected", "on", "yes"], "lookbackHours": 24, "label": "alarm asserted"},
        UPLINK,
        _boolean_alarm,
    ),
    Check(
        "geofence-breach",
        "Newest position outside a box or a circle.",
        "critical",
        {
            "latPaths": ["position.latitude"], "lonPaths": ["position.longitude"], "shape": "box",
            "north": None, "south": None, "east": None, "west": None,
            "centerLat": None, "centerLon": None, "radiusMetres": None, "clearMargin": 25, "lookbackHours": 24, "inwardMargin": False,
        },
        UPLINK,
        _geofence,
        routing="situation",
    ),
]
