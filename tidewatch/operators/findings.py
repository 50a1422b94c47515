"""Findings of many checks as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "kind string, rule_id string, ordinal bigint, dev_eui string, device_name string, severity string, summary string, detail string"


def severity_of(found: Column, check: str | None, rule: str) -> Column:
    """The check's severity comes before the rule's; a finding's own before both."""
    return F.coalesce(found, F.lit(check), F.lit(rule))


def canonical(df: DataFrame, kind: str, rule_id: str, severity: str | None, default: str, escalates: bool = True) -> DataFrame:
    """A check's findings in the common form; rows without a device or a summary are dropped.

    severity: the check's, if it sets one. A finding's own severity counts before it only where the
    rule escalates, that is where it differs from the rule's default.
    """
    own = F.col("severity")
    if severity is not None:
        own = F.when(own != default, own) if escalates else F.lit(None).cast("string")
    detail = F.to_json("detail") if "detail" in df.columns else F.lit("{}")
    ordinal = F.col("ordinal").cast("bigint") if "ordinal" in df.columns else F.lit(0).cast("bigint")
    rows = df.select(
        F.lit(kind).alias("kind"),
        F.lit(rule_id).alias("rule_id"),
        ordinal.alias("ordinal"),
        F.col("dev_eui").cast("string").alias("dev_eui"),
        F.col("device_name").cast("string").alias("device_name"),
        severity_of(own, severity, default).alias("severity"),
        F.col("summary").cast("string").alias("summary"),
        detail.alias("detail"),
    )
    return rows.filter((F.length("dev_eui") > 0) & (F.length("summary") > 0))


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
