"""Two made-up fleets: a cold chain with one device for each fault, and a brewery. Times are minutes before AS_OF."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from tidewatch.sources.tables import SCHEMAS

AS_OF = "2024-06-01 12:00:00"
_END = datetime(2024, 6, 1, 12)


def eui(tail: str) -> str:
    return tail.rjust(16, "0")


class Store:
    """Rows of the five event tables."""

    def __init__(self):
        self.rows = {name: [] for name in SCHEMAS}
        self.n = 0

    def _base(self, tail, name, minutes, profile):
        self.n += 1
        return {"time": _END - timedelta(minutes=minutes), "dev_eui": eui(tail), "device_name": name, "device_profile_name": profile}

    def up(self, tail, name, n, step, payload, start=0, profile="p", rssi=-95, snr=9.5):
        """n uplinks, g = n oldest ... the newest `step` minutes (plus start) before the end; payload(g), g = 1 newest."""
        for g in range(1, n + 1):
            body = payload(g) if callable(payload) else payload
            body = body if body is None or isinstance(body, str) else json.dumps(nest(body))
            row = self._base(tail, name, start + g * step, profile)
            self.rows["event_up"].append(row | {"deduplication_id": f"u{self.n:06d}", "f_cnt": g, "object": body, "rx_info": json.dumps([{"rssi": rssi, "snr": snr}])})

    def add(self, table, tail, name, minutes, profile="p", **fields):
        row = self._base(tail, name, minutes, profile)
        key = {"event_log": {"id": self.n}, "event_ack": {"queue_item_id": f"q{self.n}"}}.get(table, {"deduplication_id": f"d{self.n}"})
        self.rows[table].append(row | key | fields)

    def tables(self, spark):
        out = {}
        for name, schema in SCHEMAS.items():
            columns = [c.split()[0] for c in schema.split(", ")]
            out[name] = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in self.rows[name]], schema)
        return out


def nest(flat: dict) -> dict:
    out: dict = {}
    for path, value in flat.items():
        at = out
        *head, last = path.split(".")
        for p in head:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def fleet() -> Store:
    """Vans, cold rooms, tanks and meters of a dairy. Tails: 1xx network, 2xx climate, 3xx tanks, 4xx meters, 5xx vans, 9xx healthy."""
    s = Store()
    well = {"supply.volts": 3.72, "room.celsius": 4.2}
    # network
    s.up("101", "ramp-gone-quiet", 8, 25, well, start=400)
    s.up("102", "ramp-no-decoder", 9, 14, None)
    s.up("103", "ramp-null-decoder", 9, 14, "null")
    s.up("104", "ramp-far-away", 25, 30, well, rssi=-121, snr=-3)
    s.up("105", "ramp-complains", 7, 40, well)
    s.up("106", "ramp-few-decibels", 7, 40, well)
    s.up("107", "ramp-weak-cell", 7, 40, well)
    s.up("108", "ramp-rejoins", 2, 300, well)
    s.up("109", "ramp-deaf", 7, 40, well)
    for k in range(4):
        s.add("event_log", "105", "ramp-complains", 70 + 210 * k, level="3" if k == 2 else "2", code="11", description=f"frame {k} refused")
        s.add("event_log", "905", "dock-ok", 70 + 210 * k, level="2", code="7", description="sent again")
        s.add("event_log", "906", "dock-talkative", 70 + 210 * k, level="1", code="11", description="note")
        radio = {"external_power_source": False, "battery_level_unavailable": False}
        s.add("event_status", "106", "ramp-few-decibels", 400 + 900 * k, margin=(4, -1, 3, 1)[k], battery_level=77.0, **radio)
        s.add("event_status", "107", "ramp-weak-cell", 400 + 900 * k, margin=22, battery_level=6.5 + k, **radio)
        s.add("event_status", "905", "dock-ok", 400 + 900 * k, margin=19, battery_level=64.0, **radio)
        s.add("event_status", "907", "dock-on-mains", 400 + 900 * k, margin=19, battery_level=1.0, external_power_source=True, battery_level_unavailable=False)
        s.add("event_status", "908", "dock-unmeasured", 400 + 900 * k, margin=19, battery_level=1.0, external_power_source=False, battery_level_unavailable=True)
    for k in range(11):
        s.add("event_join", "108", "ramp-rejoins", 60 + 700 * k, dev_addr=f"7e{k:06x}")
    s.add("event_join", "905", "dock-ok", 5000, dev_addr="7f000000")
    for k in range(5):
        s.add("event_ack", "109", "ramp-deaf", 33 + 100 * k, acknowledged=None if k == 1 else k == 4, f_cnt_down=40 - k)
        s.add("event_ack", "905", "dock-ok", 33 + 100 * k, acknowledged=k != 3, f_cnt_down=40 - k)
    # climate
    s.up("201", "room-flat-cell", 16, 20, lambda g: {"supply.volts": 3.05 + 0.01 * g, "room.celsius": 3.9})
    s.up("202", "room-frozen", 10, 12, lambda g: {"room.celsius": -2.5 - 0.1 * (g % 4)})
    s.up("203", "probe-frozen", 10, 12, lambda g: {"celsius": -1.75})
    s.up("204", "room-warm", 10, 12, lambda g: {"room.celsius": 11.25 if g < 4 else 5})
    s.up("205", "room-chilling", 8, 30, lambda g: {"room.celsius": 3 + 2.5 * g})
    s.up("206", "room-lost-humidity", 45, 55, lambda g: {"room.humidity": 70 + g % 9}, start=1500)
    s.up("206", "room-lost-humidity", 9, 35, {"room.celsius": 4.1})
    s.up("207", "room-spiking", 14, 11, lambda g: {"room.celsius": 7.9 if g == 5 else 4 + g % 2})
    s.up("208", "room-dipping", 14, 11, lambda g: {"room.celsius": 0.25 if g == 9 else 4 + g % 2})
    s.up("209", "fan-standing", 26, 40, {"fan.rpm": 0})
    s.up("210", "room-stale-air", 9, 20, {"room.ppm": 3150, "room.celsius": 6})
    # tanks
    s.up("301", "whey-tank-leaking", 11, 35, lambda g: {"tank.percent": 22 + 6.3 * g})
    s.up("302", "milk-tank-empty", 11, 35, lambda g: {"float.percent": 12.5 + 0.4 * (g % 3)})
    s.up("303", "brine-tank-frozen-value", 22, 45, {"brine.percent": 23.75})
    s.up("304", "brine-tank-strong", 11, 45, lambda g: {"brine.percent": 28.5 + 0.3 * (g % 5)})
    # meters
    s.up("401", "main-burst", 9, 18, lambda g: {"meter.litres": 70_000 - 450 * g})
    s.up("402", "meter-standing", 10, 65, {"meter.litres": 8_125})
    s.up("403", "meter-swapped", 10, 65, lambda g: {"meter.litres": 35 - g if g < 6 else 52_000 - g})
    s.up("404", "floor-wet", 9, 25, lambda g: {"floor.wet": g in (1, 2)})
    s.up("405", "hatch-ajar", 9, 25, {"hatch.state": "AJAR"})
    # vans
    s.up("501", "van-off-site", 6, 45, {"gps.lat": 47.32, "gps.lon": 8.61})
    s.up("502", "van-off-route", 6, 45, {"route.lat": 47.9, "route.lon": 8.2})
    # healthy
    s.up("901", "room-ok", 30, 24, lambda g: {"supply.volts": 3.7, "room.celsius": 4 + 0.3 * (g % 4), "room.humidity": 71 + g % 7, "room.ppm": 620 + g})
    s.up("902", "tank-ok", 30, 24, lambda g: {"tank.percent": 55 + g % 5, "brine.percent": 23 + 0.5 * (g % 3), "fan.rpm": 900 + g})
    s.up("903", "meter-ok", 14, 60, lambda g: {"meter.litres": 4_400 - 35 * g, "floor.wet": "false", "hatch.state": "shut"})
    s.up("904", "van-ok", 9, 40, {"gps.lat": 47.05, "gps.lon": 8.31, "route.lat": 47.1, "route.lon": 8.25})
    for tail, name in (("905", "dock-ok"), ("906", "dock-talkative"), ("907", "dock-on-mains"), ("908", "dock-unmeasured")):
        s.up(tail, name, 24, 40, well)
    return s


EXPECTED = {
    ("device-silent", "0101"), ("decode-failure", "0102"), ("decode-failure", "0103"), ("signal-degraded", "0104"), ("complaints", "0105"),
    ("thin-margin", "0106"), ("cell-by-status", "0107"), ("rejoins", "0108"), ("deaf-to-commands", "0109"), ("flat-cell", "0201"),
    ("room-below-zero", "0202"), ("room-below-zero", "0203"), ("room-too-warm", "0204"), ("cooling-too-fast", "0205"), ("humidity-gone", "0206"),
    ("warm-spike", "0207"), ("cold-dip", "0208"), ("fan-stopped", "0209"), ("stale-air", "0210"), ("tank-leaks", "0301"), ("tank-nearly-empty", "0302"),
    ("brine-probe-stuck", "0303"), ("brine-strong", "0304"), ("burst-pipe", "0401"), ("meter-stopped", "0402"), ("meter-stopped", "0403"),
    ("wet-floor", "0404"), ("hatch-open", "0405"), ("van-left-yard", "0501"), ("van-left-circle", "0502"),
    # the same causes seen by a second check
    ("cold-dip", "0202"), ("warm-spike", "0204"), ("warm-spike", "0205"),
}


def _t(kind, paths, low=None, high=None, margin=0, hours=24, severity=None):
    return {"rule": "measurement-threshold", "as": kind, "severity": severity, "params": {"paths": paths, "min": low, "max": high, "clearMargin": margin, "lookbackHours": hours}}


def _r(rule, kind, **params):
    return {"rule": rule, "as": kind, "params": params}


CONFIG = {
    "statementTimeoutMs": 300_000,
    "checks": [
        {"// climate": "rooms"},
        _t("room-below-zero", ["room.celsius", "celsius"], low=0, margin=0.5, hours=8, severity="critical"),
        _t("room-too-warm", ["room.celsius"], high=9, margin=1, hours=8),
        _r("measurement-rate", "cooling-too-fast", paths=["room.celsius"], maxRatePerHour=4, lookbackHours=6, minSpanHours=1),
        _r("measurement-missing", "humidity-gone", paths=["room.humidity"]),
        _r("measurement-peak", "warm-spike", paths=["room.celsius"], threshold=7, lookbackHours=4),
        _r("measurement-peak", "cold-dip", paths=["room.celsius"], direction="min", threshold=0.5, lookbackHours=4),
        _r("measurement-stuck", "fan-stopped", paths=["fan.rpm"], minSamples=20, decimals=0),
        _t("stale-air", ["room.ppm"], high=2500, margin=100),
        _r("battery-low", "flat-cell", paths=["supply.volts"]),
        {"// tanks": "and meters"},
        {**_r("measurement-rate", "tank-leaks", paths=["tank.percent"], maxRatePerHour=7, lookbackHours=8), "severity": "critical"},
        _t("tank-nearly-empty", ["tank.percent", "float.percent"], low=15, margin=3),
        _r("measurement-stuck", "brine-probe-stuck", paths=["brine.percent"], decimals=2),
        _t("brine-strong", ["brine.percent"], high=26, margin=0.5),
        _r("counter-spike", "burst-pipe", paths=["meter.litres"], maxRatePerHour=900, lookbackHours=5),
        _r("counter-stalled", "meter-stopped", paths=["meter.litres"]),
        _r("boolean-alarm", "wet-floor", paths=["floor.wet"], trueValues=["true", "wet"]),
        _r("boolean-alarm", "hatch-open", paths=["hatch.state"], trueValues=["open", "ajar"]),
        {"// vans": "and the network"},
        _r("geofence-breach", "van-left-yard", latPaths=["gps.lat"], lonPaths=["gps.lon"], north=47.2, south=46.9, east=8.5, west=8.1, clearMargin=0.01),
        _r("geofence-breach", "van-left-circle", latPaths=["route.lat"], lonPaths=["route.lon"], shape="radius", centerLat=47.1, centerLon=8.3, radiusMetres=30_000),
        {"rule": "device-silent"},
        {"rule": "decode-failure"},
        {"rule": "signal-degraded"},
        {"rule": "device-log-error", "as": "complaints"},
        {"rule": "status-margin-low", "as": "thin-margin"},
        {"rule": "status-battery-low", "as": "cell-by-status"},
        {"rule": "join-churn", "as": "rejoins"},
        {"rule": "downlink-unacked", "as": "deaf-to-commands"},
    ]
}


def brewery() -> Store:
    """Three families of hardware, each with its own limits: fermenters, kegs and a boiler's gauges."""
    s = Store()
    s.up("a1", "fermenter-ok", 18, 40, lambda g: {"cell": 3.61, "wort.celsius": 19 + 0.4 * (g % 4), "wort.ph": 4.4}, profile="fermenter")
    s.up("a2", "fermenter-hot", 18, 40, lambda g: {"cell": 3.6, "wort.celsius": 26.5 + 0.2 * (g % 4), "wort.ph": 3.1}, profile="fermenter")
    s.up("b1", "keg-ok", 18, 40, lambda g: {"cell": 2.93, "keg.litres": 31 - 0.1 * (18 - g)}, profile="keg")
    s.up("b2", "keg-flat-cell", 18, 40, lambda g: {"cell": 2.71, "keg.litres": 24 - 0.1 * (18 - g)}, profile="keg")
    s.up("b3", "keg-stuck", 18, 40, {"cell": 2.95, "keg.litres": 17.5}, profile="keg")
    s.up("c1", "boiler-ok", 18, 10, lambda g: {"cell": 3.4, "steam.bar": 6 + 0.2 * (g % 3)}, profile="boiler")
    s.up("c2", "boiler-surging", 18, 10, lambda g: {"cell": 3.4, "steam.bar": 9.6 if g == 6 else 6.1 - 0.1 * (g % 3)}, profile="boiler")
    s.up("c3", "boiler-failing", 14, 10, lambda g: {"cell": 3.4, "steam.bar": 1.2 + 0.35 * g}, profile="boiler")
    return s


BREWERY_EXPECTED = {
    ("wort-warm", "00a2"), ("wort-sour", "00a2"), ("keg-cell", "00b2"), ("keg-scale-stuck", "00b3"), ("steam-surge", "00c2"), ("steam-drops", "00c3"), ("steam-low", "00c3"),
}


def _cell(kind, profile, raise_at):
    return _r("battery-low", kind, paths=["cell"], raiseAtVolts=raise_at, clearAtVolts=raise_at + 0.1, criticalAtVolts=raise_at - 0.2, deviceProfiles=[profile])


BREWERY = {
    "statementTimeoutMs": 300_000,
    "checks": [
        _t("wort-warm", ["wort.celsius"], high=24, margin=1),
        _t("wort-sour", ["wort.ph"], low=3.6, high=5.5, margin=0.1),
        _r("measurement-stuck", "keg-scale-stuck", paths=["keg.litres"], decimals=1),
        _r("measurement-peak", "steam-surge", paths=["steam.bar"], threshold=9, lookbackHours=6),
        _r("measurement-rate", "steam-drops", paths=["steam.bar"], maxRatePerHour=1.5, lookbackHours=4),
        _t("steam-low", ["steam.bar"], low=3, margin=0.5, severity="critical"),
        _cell("fermenter-cell", "fermenter", 3.3),
        _cell("keg-cell", "keg", 2.8),
        _cell("boiler-cell", "boiler", 3.0),
    ]
}
