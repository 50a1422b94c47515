"""Coercion of check parameters. Every error names the parameter."""

from __future__ import annotations

from typing import Any


class ParamError(ValueError):
    """A parameter that a check can't run with."""


def number(params: dict[str, Any], key: str) -> float:
    value = params.get(key)
    if isinstance(value, str):
        try:
            value = float(value)
        except ValueError:
            value = None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or abs(value) == float("inf"):
        raise ParamError(f"{key} must be a finite number, not {params.get(key)!r}")
    return float(value)


def whole(params: dict[str, Any], key: str, least: int | None = None) -> int:
    value = number(params, key)
    if value != int(value):
        raise ParamError(f"{key} must be a whole number, not {params.get(key)!r}")
    if least is not None and value < least:
        raise ParamError(f"{key} must be at least {least}")
    return int(value)


def rounded(params: dict[str, Any], key: str) -> int:
    """A number, rounded to a whole one (halves up)."""
    import math

    return math.floor(number(params, key) + 0.5)


def optional(params: dict[str, Any], key: str) -> float | None:
    return None if params.get(key) is None else number(params, key)


def text(params: dict[str, Any], key: str) -> str:
    value = params.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ParamError(f"{key} must be a non-empty string, not {value!r}")
    return value


def flag(params: dict[str, Any], key: str) -> bool:
    value = params.get(key)
    if not isinstance(value, bool):
        raise ParamError(f"{key} must be true or false, not {value!r}")
    return value


def choice(params: dict[str, Any], key: str, of: tuple[str, ...]) -> str:
    value = params.get(key)
    if value not in of:
        raise ParamError(f"{key} must be one of {', '.join(of)}, not {value!r}")
    return value


def strings(params: dict[str, Any], key: str) -> list[str]:
    """A list of strings; one string is a list of one, null an empty list."""
    value = params.get(key)
    if value is None:
        return []
    if isinstance(value, str):
        return [value] if value else []
    if isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
        return [x for x in value if x]
    raise ParamError(f"{key} must be a string or a list of strings, not {value!r}")


def paths(params: dict[str, Any], key: str = "paths") -> list[tuple[str, ...]]:
    """Candidate paths in order: a dotted string, a list of them, or a list of lists of segments."""
    value = params.get(key)
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, (list, tuple)) or not value:
        raise ParamError(f"{key} must name at least one path, not {value!r}")
    found = []
    for item in value:
        if isinstance(item, str):
            item = item.split(".")
        if not isinstance(item, (list, tuple)) or not all(isinstance(x, str) for x in item):
            raise ParamError(f"{key} has a path that is neither a dotted string nor a list of segments: {item!r}")
        segments = tuple(x.strip() for x in item if x.strip())
        if not segments:
            raise ParamError(f"{key} has an empty path")
        found.append(segments)
    return found


def label(candidates: list[tuple[str, ...]]) -> str:
    return ", ".join(".".join(p) for p in candidates)
