"""Which devices a check looks at: by profile and by name."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params as P

#: Parameters that every scoped check takes.
DEFAULTS: dict[str, Any] = {"deviceProfiles": [], "deviceNamePattern": None}


@dataclass(frozen=True)
class Scope:
    """No profiles: every profile. No pattern: every name. Otherwise null profiles and names are left out."""

    profiles: list[str] = field(default_factory=list)
    name_like: str | None = None

    @classmethod
    def of(cls, params: dict[str, Any]) -> Scope:
        pattern = params.get("deviceNamePattern")
        if pattern is not None and not isinstance(pattern, str):
            raise P.ParamError(f"deviceNamePattern must be a string, not {pattern!r}")
        return cls(P.strings(params, "deviceProfiles"), pattern or None)

    def matches(self) -> Column:
        """True for rows of the scope; otherwise false or null."""
        out = F.lit(True)
        if self.profiles:
            out = out & F.col("device_profile_name").isin(self.profiles)
        if self.name_like is not None:
            out = out & F.col("device_name").like(self.name_like)
        return out

    def apply(self, events: DataFrame) -> DataFrame:
        return events if self == Scope() else events.filter(self.matches())
