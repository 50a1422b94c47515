"""Configuration: which checks run with which parameters, and where alerts go.

A JSON object with schedule, timezone, statementTimeoutMs, maxChecksPerRun, checks and notify.
Objects all of whose keys start with // are comments.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .checks.base import ROUTINGS, SEVERITIES

PROVIDERS = ("webhook", "twilio", "telegram", "signal")
ENV = "TIDEWATCH_"
_KIND = re.compile(r"[a-z0-9][a-z0-9-]*")
_E164 = re.compile(r"\+[1-9][0-9]{6,14}")
_SIGNAL_GROUP = re.compile(r"group\.[A-Za-z0-9+/=_-]+")
#: Keys of other ways to describe delivery, which are refused rather than ignored.
_DEAD = ("webhookUrl", "provider", "to", "url")

#: A route that isn't there, as opposed to one that is null (record only).
ABSENT = "\0absent"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class CheckConfig:
    rule: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    severity: str | None = None
    notify_to: Any = ABSENT


@dataclass(frozen=True)
class Destination:
    name: str
    provider: str = "webhook"
    url: str | None = None
    to: tuple[str, ...] = ()
    chat_id: str | None = None
    auth: str | None = None
    token_header: str = "X-Token"
    secret: str | None = None
    timeout_ms: int = 5000
    credentials: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Notify:
    destinations: dict[str, Destination]
    routing: dict[str, str | None] = field(default_factory=dict)
    by_severity: dict[str, str | None] = field(default_factory=dict)
    default: Any = ABSENT


@dataclass(frozen=True)
class Config:
    checks: list[CheckConfig]
    schedule: str = "*/15 * * * *"
    timezone: str = "UTC"
    timeout_ms: int = 15_000
    max_checks: int = 64
    notify: Notify | None = None

    @property
    def enabled(self) -> list[CheckConfig]:
        return [c for c in self.checks if c.enabled]


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _is_comment(x: Any) -> bool:
    return isinstance(x, dict) and all(k.startswith("//") for k in x)


def _whole(raw: dict, key: str, default: int) -> int:
    value = raw.get(key, default)
    _need(isinstance(value, int) and not isinstance(value, bool) and value > 0, f"{key} must be a whole number above 0")
    return value


def _check(raw: Any, at: str, seen: set[str]) -> CheckConfig:
    _need(isinstance(raw, dict), f"{at} must be an object")
    _need(isinstance(raw.get("rule"), str) and bool(raw["rule"]), f"{at}.rule must name a rule")
    kind = raw.get("as", raw["rule"])
    _need(isinstance(kind, str) and bool(_KIND.fullmatch(kind)), f"{at}.as must be lower-case letters, digits and dashes, not {kind!r}")
    _need(kind not in seen, f"{at}: two checks are called {kind}; give one another name with `as`")
    seen.add(kind)
    _need(isinstance(raw.get("params", {}), dict), f"{at}.params must be an object")
    _need(isinstance(raw.get("enabled", True), bool), f"{at}.enabled must be true or false")
    _need(raw.get("severity") is None or raw["severity"] in SEVERITIES, f"{at}.severity must be one of {', '.join(SEVERITIES)}")
    to = raw.get("notifyTo", ABSENT)
    _need(to is None or isinstance(to, str), f"{at}.notifyTo must be a destination's name or null")
    params = {k: v for k, v in raw.get("params", {}).items() if not k.startswith("//")}
    return CheckConfig(raw["rule"], kind, params, raw.get("enabled", True), raw.get("severity"), to)


def _env(env: Mapping[str, str], key: str) -> str | None:
    """An environment value; blank counts as unset."""
    value = env.get(ENV + key, "").strip()
    return value or None


#: Keys that are read; the last two are short for webhookAuth and webhookTokenHeader.
_DESTINATION = ("provider", "to", "chatId", "webhookUrl", "webhookAuth", "webhookTokenHeader", "timeoutMs", "auth", "tokenHeader")
_NOTIFY = ("destinations", "routing", "bySeverity", "defaultDestination", "timeoutMs")


def _known(raw: dict, allowed: tuple[str, ...], at: str) -> None:
    """No key passes unread; those that begin with // are comments."""
    unknown = sorted(k for k in raw if k not in allowed and not k.startswith("//"))
    _need(not unknown, f"{at} has {', '.join(unknown)}, which isn't read; its keys are {', '.join(allowed)}")


def _milliseconds(raw: dict, at: str, default: int) -> int:
    value = raw.get("timeoutMs", default)
    _need(isinstance(value, int) and not isinstance(value, bool) and value > 0, f"{at}.timeoutMs must be a whole number above 0")
    return value


def _destination(name: str, raw: Any, env: Mapping[str, str], timeout_ms: int) -> Destination:
    at = f"notify.destinations.{name}"
    _need(isinstance(raw, dict), f"{at} must be an object")
    _known(raw, _DESTINATION, at)
    for short, key in (("auth", "webhookAuth"), ("tokenHeader", "webhookTokenHeader")):
        _need(not (short in raw and key in raw), f"{at} has both {short} and {key}")
    own = "DEST_" + re.sub(r"[^A-Za-z0-9]", "_", name).upper()
    provider = _env(env, f"{own}_PROVIDER") or raw.get("provider", "webhook")
    _need(provider in PROVIDERS, f"{at}.provider must be one of {', '.join(PROVIDERS)}, not {provider!r}")
    to = _env(env, f"{own}_TO")
    to = [x.strip() for x in to.split(",") if x.strip()] if to else raw.get("to", [])
    to = [to] if isinstance(to, str) else to
    _need(isinstance(to, list) and all(isinstance(x, str) for x in to), f"{at}.to must be a list of recipients")
    chat = _env(env, f"{own}_CHAT_ID") or raw.get("chatId")
    url = _env(env, f"{own}_WEBHOOK_URL") or raw.get("webhookUrl")
    secret = _env(env, f"{own}_SECRET") or _env(env, "WEBHOOK_SECRET")
    auth, header = raw.get("webhookAuth", raw.get("auth")), raw.get("webhookTokenHeader", raw.get("tokenHeader", "X-Token"))
    _need(isinstance(header, str) and bool(header), f"{at}.webhookTokenHeader must be the name of a header")
    credentials: dict[str, str] = {}
    if provider in ("twilio", "signal"):
        _need(bool(to), f"{at}: {provider} needs at least one recipient in `to`")
        for x in to:
            good = _E164.fullmatch(x) or (provider == "signal" and _SIGNAL_GROUP.fullmatch(x))
            _need(bool(good), f"{at}.to has {x!r}, which is not a number in international form" + (" or a group id" if provider == "signal" else ""))
    if provider == "telegram":
        _need(chat is not None and str(chat).strip() != "", f"{at}: telegram needs chatId")
    if provider == "webhook":
        _need(isinstance(url, str) and bool(re.fullmatch(r"https?://\S+", url)), f"{at}.webhookUrl must be an http or https address")
        _need(auth in (None, "hmac", "token", "bearer"), f"{at}.webhookAuth must be hmac, token or bearer")
        _need(auth is None or secret is not None, f"{at}: auth {auth} needs a secret in {ENV}{own}_SECRET or {ENV}WEBHOOK_SECRET")
    wanted = {"twilio": ("TWILIO_ACCOUNT_SID", "TWILIO_AUTH_TOKEN", "TWILIO_FROM"), "telegram": ("TELEGRAM_BOT_TOKEN",), "signal": ("SIGNAL_API_URL", "SIGNAL_NUMBER")}
    for key in wanted.get(provider, ()):
        value = _env(env, key)
        _need(value is not None, f"{at}: {provider} needs {ENV}{key}")
        credentials[key] = value
    return Destination(name, provider, url, tuple(to), str(chat) if chat is not None else None, auth, header, secret, _milliseconds(raw, at, timeout_ms), credentials)


def _notify(raw: Any, checks: list[CheckConfig], env: Mapping[str, str]) -> Notify:
    _need(isinstance(raw, dict), "notify must be an object")
    for key in _DEAD:
        _need(key not in raw, f"notify.{key} isn't read; put it into notify.destinations.<name>")
    _need("destinations" in raw, "notify.destinations is missing; leave notify out to record alerts only")
    named = raw["destinations"]
    _need(isinstance(named, dict), "notify.destinations must be an object")
    _known(raw, _NOTIFY, "notify")
    timeout_ms = _milliseconds(raw, "notify", 5000)
    found = {k: _destination(k, v, env, timeout_ms) for k, v in named.items() if not k.startswith("//")}
    _need(bool(found), "notify.destinations is empty; leave notify out to record alerts only")

    def target(value: Any, at: str) -> str | None:
        _need(value is None or value in found, f"{at} names {value!r}, which isn't among notify.destinations")
        return value

    routes = {}
    for key, allowed in (("routing", ROUTINGS), ("bySeverity", SEVERITIES)):
        part = raw.get(key, {})
        _need(isinstance(part, dict), f"notify.{key} must be an object")
        for k in part:
            _need(k in allowed or k.startswith("//"), f"notify.{key} has {k!r}; its keys are {', '.join(allowed)}")
        routes[key] = {k: target(v, f"notify.{key}.{k}") for k, v in part.items() if not k.startswith("//")}
    default = target(raw["defaultDestination"], "notify.defaultDestination") if "defaultDestination" in raw else ABSENT
    for c in checks:
        if isinstance(c.notify_to, str) and c.notify_to != ABSENT:
            target(c.notify_to, f"check {c.kind}: notifyTo")
    some = any(isinstance(v, str) and v != ABSENT for v in [*routes["routing"].values(), *routes["bySeverity"].values(), default, *(c.notify_to for c in checks)])
    _need(some, "notify has destinations, but nothing leads to them: set routing, bySeverity, defaultDestination or a check's notifyTo")
    return Notify(found, routes["routing"], routes["bySeverity"], default)


def parse(raw: Any, env: Mapping[str, str] | None = None) -> Config:
    """A validated configuration from parsed JSON."""
    env = os.environ if env is None else env
    _need(isinstance(raw, dict), "the configuration must be an object")
    _need(isinstance(raw.get("checks"), list), "checks must be a list")
    seen: set[str] = set()
    checks = [_check(x, f"checks[{i}]", seen) for i, x in enumerate(raw["checks"]) if not _is_comment(x)]
    for key in ("schedule", "timezone"):
        _need(isinstance(raw.get(key, "x"), str), f"{key} must be a string")
    limit = _whole(raw, "maxChecksPerRun", Config.max_checks)
    n = sum(c.enabled for c in checks)
    _need(n <= limit, f"{n} checks are enabled, maxChecksPerRun is {limit}")
    notify = _notify(raw["notify"], checks, env) if raw.get("notify") is not None else None
    return Config(
        checks, raw.get("schedule", Config.schedule), raw.get("timezone", Config.timezone), _whole(raw, "statementTimeoutMs", Config.timeout_ms), limit, notify
    )


def load(path: str | Path, env: Mapping[str, str] | None = None) -> Config:
    try:
        raw = json.loads(Path(path).read_text())
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e.strerror}") from e
    except ValueError as e:
        raise ConfigError(f"{path} isn't JSON: {e}") from e
    return parse(raw, env)
