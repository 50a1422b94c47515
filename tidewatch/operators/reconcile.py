"""The alert lifecycle as one keyed merge: raise, touch, resolve.

State is a table of alert episodes; at most one row per (dev_eui, kind) is open (resolved_at is
null). Only open rows and findings meet, by one full outer join on the key; closed rows pass by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = (
    "id string, rule_id string, kind string, dev_eui string, device_name string, severity string, summary string, detail string, "
    "raised_at timestamp, last_seen_at timestamp, resolved_at timestamp, notified_at timestamp"
)
KEY = ["dev_eui", "kind"]


@dataclass
class Reconciled:
    """state: all episodes afterwards; raised, touched, resolved: rows of this pass."""

    state: DataFrame
    raised: DataFrame
    touched: DataFrame
    resolved: DataFrame
    counts: DataFrame


def one_per_device(findings: DataFrame) -> DataFrame:
    """A device found several times by one check: the last finding is stored, the first is announced. One pass of partial sums."""
    order = F.struct("ordinal", "summary", "detail")
    rest = [c for c in findings.columns if c not in KEY]
    found = findings.groupBy(*KEY).agg(
        F.max_by(F.struct(*rest), order).alias("_last"),
        F.min_by(F.struct("severity", "summary", "detail"), order).alias("announced"),
        F.count("*").alias("times"),
    )
    return found.select(*KEY, *[F.col(f"_last.{c}").alias(c) for c in rest], "announced", "times")


def merge(state: DataFrame, findings: DataFrame, as_of: str, kinds: list[str]) -> DataFrame:
    """Open rows and findings side by side, with what happens to each: raise, touch, resolve or keep.

    kinds: checks that ran to their end. Open alerts of other kinds are kept as they are.
    """
    now = F.lit(as_of).cast("timestamp")
    found = one_per_device(findings.filter(F.col("kind").isin(kinds))).select(
        *KEY, F.struct("rule_id", "ordinal", "device_name", "severity", "summary", "detail", "announced", "times").alias("f")
    )
    open_rows = state.filter("resolved_at is null").select(*KEY, F.struct(*[c for c in state.columns if c not in KEY]).alias("s"))
    both = open_rows.join(found, KEY, "full_outer")
    action = (
        F.when(F.col("s").isNull(), "raise")
        .when(F.col("f").isNotNull(), "touch")
        .when(F.col("kind").isin(kinds), "resolve")
        .otherwise("keep")
    )
    both = both.withColumn("action", action)
    hit = F.col("f").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"f.{c}")).otherwise(F.col(f"s.{c}"))
    return both.select(
        "action",
        F.coalesce("s.id", F.sha1(F.concat_ws("|", *KEY, now.cast("string")))).alias("id"),
        F.coalesce("s.rule_id", "f.rule_id").alias("rule_id"),
        "kind",
        "dev_eui",
        F.coalesce("f.device_name", "s.device_name").alias("device_name"),
        *[pick(c).alias(c) for c in ("severity", "summary", "detail")],
        F.coalesce("s.raised_at", now).alias("raised_at"),
        F.when(hit, now).otherwise(F.col("s.last_seen_at")).alias("last_seen_at"),
        F.when(F.col("action") == "resolve", now).alias("resolved_at"),
        F.col("s.notified_at").alias("notified_at"),
        F.coalesce("f.times", F.lit(0)).alias("times"),
        F.col("f.announced").alias("announced"),
        F.col("f.ordinal").alias("ordinal"),
    )


def counted(merged: DataFrame) -> DataFrame:
    """kind, findings, raised, touched, resolved: what merge() did for each check."""
    return merged.groupBy("kind").agg(
        F.sum("times").alias("findings"),
        F.count_if(F.col("action") == "raise").alias("raised"),
        (F.sum("times") - F.count_if(F.col("action") == "raise")).alias("touched"),
        F.count_if(F.col("action") == "resolve").alias("resolved"),
    )


def reconcile(state: DataFrame, findings: DataFrame, as_of: str, kinds: list[str]) -> Reconciled:
    """The state after a pass, and what changed. Lazy; write state before using the others repeatedly."""
    merged = merge(state, findings, as_of, kinds)
    columns = state.columns
    after = state.filter("resolved_at is not null").unionByName(merged.select(*columns))
    part = lambda a: merged.filter(F.col("action") == a)
    return Reconciled(after, part("raise"), part("touch"), part("resolve"), counted(merged))


def open_alerts(state: DataFrame, as_of: str) -> DataFrame:
    """Unresolved rows and how long each has been open."""
    return state.filter("resolved_at is null").withColumn("open_for", F.lit(as_of).cast("timestamp") - F.col("raised_at"))


def open_devices(state: DataFrame, kind: str) -> DataFrame:
    return state.filter((F.col("kind") == kind) & F.col("resolved_at").isNull()).select("dev_eui").distinct()


def status(state: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """The worst open alerts: by severity, then newest first."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return open_alerts(state, as_of).withColumn("_rank", rank).orderBy("_rank", F.col("raised_at").desc(), "dev_eui", "kind").limit(limit).drop("_rank")


def orphans(state: DataFrame, kinds: list[str]) -> DataFrame:
    """Open alerts of checks that the configuration no longer runs: nothing will resolve them."""
    return state.filter("resolved_at is null").filter(~F.col("kind").isin(kinds))


def mark_notified(state: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Stamps the rows of ids that have no stamp yet."""
    known = ids.select(F.col("id").alias("_id")).distinct()
    stamped = F.when(F.col("_id").isNotNull(), F.coalesce("notified_at", F.lit(at).cast("timestamp"))).otherwise(F.col("notified_at"))
    return state.join(known, state.id == known["_id"], "left").withColumn("notified_at", stamped).drop("_id").select(*state.columns)
