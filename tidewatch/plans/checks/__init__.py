"""The built-in checks, by id."""

from . import network, readings, windows
from .base import Check, Context

CHECKS: dict[str, Check] = {c.id: c for m in (network, readings, windows) for c in m.CHECKS}

__all__ = ["CHECKS", "Check", "Context"]
