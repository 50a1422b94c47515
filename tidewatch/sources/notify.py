"""Delivery of newly raised alerts over HTTP, one after the other, from the driver, which holds one partition of them at a time."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from ..operators.routing import destination
from ..plans.config import Destination, Notify

#: Version of the payload.
SCHEMA_TAG = "tidewatch.alert.v1"

Post = Callable[[str, bytes, dict[str, str], float], tuple[int, bytes]]


@dataclass
class Delivery:
    attempted: int = 0
    delivered: int = 0
    failed: int = 0
    unrouted: int = 0
    errors: list[str] = field(default_factory=list)
    delivered_ids: list[str] = field(default_factory=list)


def http_post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, headers, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.status, answer.read()


def line(alert: dict[str, Any]) -> str:
    return f"[{str(alert['severity']).upper()}] {alert['kind']} - {alert['summary']}"


def payload(alert: dict[str, Any]) -> dict[str, Any]:
    detail = alert.get("detail")
    return {
        "schema": SCHEMA_TAG,
        "id": alert["id"],
        "rule": alert["rule_id"],
        "kind": alert["kind"],
        "devEui": alert["dev_eui"],
        "deviceName": alert.get("device_name"),
        "severity": alert["severity"],
        "summary": alert["summary"],
        "detail": json.loads(detail) if isinstance(detail, str) else detail or {},
        "raisedAt": str(alert["raised_at"]),
    }


def signed(d: Destination, body: bytes, now: float) -> dict[str, str]:
    """Headers that prove who sends; hmac signs the time and the exact bytes."""
    headers = {"Content-Type": "application/json"}
    if d.auth == "hmac":
        ts = str(int(now))
        headers |= {"X-Timestamp": ts, "X-Signature": hmac.new(d.secret.encode(), ts.encode() + b"." + body, hashlib.sha256).hexdigest()}
    elif d.auth == "token":
        headers[d.token_header] = d.secret
    elif d.secret:  # bearer, also where no mode is set
        headers["Authorization"] = f"Bearer {d.secret}"
    return headers


def _send(d: Destination, alert: dict[str, Any], post: Post) -> None:
    def ok(url: str, body: bytes, headers: dict[str, str]) -> bytes:
        status, answer = post(url, body, headers, d.timeout_ms / 1000)
        if not 200 <= status < 300:
            raise RuntimeError(f"{d.name} answered {status}")
        return answer

    as_json = {"Content-Type": "application/json"}
    c = d.credentials
    if d.provider == "webhook":
        body = json.dumps(payload(alert), sort_keys=True).encode()
        ok(d.url, body, signed(d, body, time.time()))
    elif d.provider == "twilio":
        login = base64.b64encode(f"{c['TWILIO_ACCOUNT_SID']}:{c['TWILIO_AUTH_TOKEN']}".encode()).decode()
        headers = {"Content-Type": "application/x-www-form-urlencoded", "Authorization": f"Basic {login}"}
        failed = []
        for to in d.to:
            form = urllib.parse.urlencode({"From": c["TWILIO_FROM"], "To": to, "Body": line(alert)}).encode()
            try:
                ok(f"https://api.twilio.com/2010-04-01/Accounts/{c['TWILIO_ACCOUNT_SID']}/Messages.json", form, headers)
            except Exception as e:  # noqa: BLE001
                failed.append(f"{to}: {e}")
        if failed:
            raise RuntimeError("; ".join(failed))
    elif d.provider == "telegram":
        body = json.dumps({"chat_id": d.chat_id, "text": line(alert)}).encode()
        answer = ok(f"https://api.telegram.org/bot{c['TELEGRAM_BOT_TOKEN']}/sendMessage", body, as_json)
        if json.loads(answer or b"{}").get("ok") is False:
            raise RuntimeError(f"{d.name} refused the message")
    else:
        body = json.dumps({"message": line(alert), "number": c["SIGNAL_NUMBER"], "recipients": list(d.to)}).encode()
        ok(c["SIGNAL_API_URL"].rstrip("/") + "/v2/send", body, as_json)


def send_all(alerts: Iterable[dict[str, Any]], destinations: dict[str, Destination], post: Post = http_post) -> Delivery:
    """Send each alert to its destination, in order; one failure doesn't stop the others."""
    out = Delivery()
    for alert in alerts:
        out.attempted += 1
        try:
            _send(destinations[alert["destination"]], alert, post)
        except Exception as e:  # noqa: BLE001
            out.failed += 1
            out.errors.append(f"{alert['destination']}: {alert['kind']} {alert['dev_eui']}: {e}")
        else:
            out.delivered += 1
            out.delivered_ids.append(alert["id"])
    return out


def deliver(alerts: list[dict[str, Any]], notify: Notify | None, routes: dict[str, tuple[str, Any]], post: Post = http_post) -> Delivery:
    """Route alerts at hand and send them. routes: kind to (class, notifyTo)."""
    routed, unrouted = [], 0
    for alert in alerts:
        routing, own = routes[alert["kind"]]
        target = destination(alert["severity"], routing, own, notify.by_severity, notify.routing, notify.default) if notify else None
        if target is None:
            unrouted += 1
        else:
            routed.append(alert | {"destination": target})
    out = send_all(routed, notify.destinations if notify else {}, post)
    out.unrouted = unrouted
    return out


def test_alert(kind: str = "test", severity: str = "info") -> dict[str, Any]:
    """A made-up alert for trying a destination."""
    return {
        "id": "test", "rule_id": "test", "kind": kind, "dev_eui": "0" * 16, "device_name": "test device", "severity": severity,
        "summary": "test of this destination", "detail": "{}", "raised_at": time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime()),
    }
