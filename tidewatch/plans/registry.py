"""Checks by id: the built-in ones, and modules of a folder, which may replace them."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from .checks import CHECKS, Check
from .checks.base import ROUTINGS, SEVERITIES


class RegistryError(ValueError):
    pass


def validated(check: object, where: str) -> Check:
    """A check that keeps the contract, or an error that says what is wrong with it."""
    if not isinstance(check, Check):
        raise RegistryError(f"{where} must define CHECK, a Check")
    wrong = [
        name
        for name, ok in {
            "id": isinstance(check.id, str) and bool(check.id),
            "description": isinstance(check.description, str) and bool(check.description),
            "severity": check.severity in SEVERITIES,
            "routing": check.routing in ROUTINGS,
            "defaults": isinstance(check.defaults, dict),
            "requires": isinstance(check.requires, dict) and bool(check.requires),
            "find": callable(check.find),
        }.items()
        if not ok
    ]
    if wrong:
        raise RegistryError(f"{where}: {', '.join(wrong)} of its check isn't valid")
    return check


def load(folder: str | Path | None = None) -> dict[str, Check]:
    """Built-in checks and those of folder; a module's name is its check's id with _ for -."""
    found = dict(CHECKS)
    for path in sorted(Path(folder).glob("*.py")) if folder else ():
        if path.name.startswith("_"):
            continue
        spec = importlib.util.spec_from_file_location(f"tidewatch_check_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(module)
        except Exception as e:
            raise RegistryError(f"{path} can't be loaded: {e}") from e
        check = validated(getattr(module, "CHECK", None), str(path))
        if check.id != path.stem.replace("_", "-"):
            raise RegistryError(f"{path} holds check {check.id}; the names must agree")
        found[check.id] = check
    return found
