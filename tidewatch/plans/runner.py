"""One pass: run every enabled check, merge findings into the state, keep the ledger, notify.

Each check is a job of its own, some at a time, with its own time limit; a check that fails is
recorded and resolves nothing while the others count. Checks over the same uplinks share one scan.
Findings are merged with the open alerts in one job, whose result is written once: counts, alerts to
send and the new state are read from there.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as FF
from ..operators import reconcile as RC
from ..operators import routing as RT
from ..sources.notify import Delivery, Post, http_post, send_all
from ..sources.partials import Partials
from ..sources.state import StateStore
from . import planner
from .checks.base import Check, Context
from .config import CheckConfig, Config

#: Checks that run at a time.
AT_A_TIME = 4


@dataclass
class Outcome:
    kind: str
    rule_id: str
    status: str
    findings: int = 0
    raised: int = 0
    resolved: int = 0
    error: str | None = None
    duration_ms: int = 0
    started: datetime | None = None


@dataclass
class Summary:
    outcomes: list[Outcome] = field(default_factory=list)
    delivery: Delivery = field(default_factory=Delivery)

    @property
    def raised(self) -> int:
        return sum(o.raised for o in self.outcomes)

    @property
    def resolved(self) -> int:
        return sum(o.resolved for o in self.outcomes)

    @property
    def errors(self) -> list[Outcome]:
        return [o for o in self.outcomes if o.status == "error"]


class Timeout(RuntimeError):
    pass


def within(spark: SparkSession, timeout_ms: int, job):
    """job(), its Spark jobs cancelled after timeout_ms."""
    sc, tag, late = spark.sparkContext, f"pass-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_ms / 1000, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return job()
    except Exception as e:
        if late.is_set():
            raise Timeout(f"stopped after {timeout_ms} ms") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def plan(c: CheckConfig, check: Check, tables: Mapping[str, DataFrame], state: DataFrame | None, as_of: str) -> DataFrame:
    """A check's findings in the common form; wrong parameters and missing tables raise here, before any job."""
    opened = RC.open_devices(state, c.kind) if state is not None else None
    found = check.run(Context(tables, c.params, as_of, c.kind, opened))
    return FF.canonical(found, c.kind, check.id, c.severity, check.severity)


def run_pass(
    spark: SparkSession,
    config: Config,
    checks: Mapping[str, Check],
    tables: Mapping[str, DataFrame],
    store: StateStore,
    as_of: str | None = None,
    dry_run: bool = False,
    fuse: bool = True,
    retry_pending: bool = False,
    post: Post = http_post,
    partials: Partials | None = None,
) -> Summary:
    """Run the enabled checks as of a time (now by default). A dry run counts findings and changes nothing.

    retry_pending: send open alerts again whose delivery failed in a pass before; without it each
    alert is sent once, when it is raised. partials: stored sums of readings, which window checks
    read instead of raw uplinks.
    """
    as_of = as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    state = store.opened()
    known = [(c, checks[c.rule]) for c in config.enabled if c.rule in checks]
    shared = _shared(spark, config, tables, known, as_of, partials) if fuse and "event_up" in tables else tables

    def one(c: CheckConfig) -> tuple[Outcome, DataFrame | None]:
        outcome, began, rows = Outcome(c.kind, c.rule, "ok", started=datetime.now(timezone.utc).replace(tzinfo=None)), time.monotonic(), None
        try:
            if c.rule not in checks:
                raise LookupError(f"there is no rule {c.rule}")
            found = plan(c, checks[c.rule], shared, None if dry_run else state, as_of)
            rows = within(spark, config.timeout_ms, lambda: store.keep(found, "findings"))
        except Exception as e:  # noqa: BLE001
            outcome.status, outcome.error = "error", str(e).strip().split("\n")[0][:500]
        outcome.duration_ms = int((time.monotonic() - began) * 1000)
        return outcome, rows

    summary = Summary()
    try:
        with ThreadPoolExecutor(AT_A_TIME) as pool:
            results = list(pool.map(one, config.enabled))
        summary.outcomes = [o for o, _ in results]
        done = {o.kind: (o, rows) for o, rows in results if rows is not None}
        if done:
            found = FF.stacked([rows for _, rows in done.values()])
            if dry_run:
                for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect():
                    done[r["kind"]][0].findings = r["n"]
            else:
                _merge(spark, config, checks, store, state, found, {k: o for k, (o, _) in done.items()}, as_of, retry_pending, post, summary)
            store.discard(*[rows for _, rows in done.values()])
    finally:
        planner.release(shared)
    if not dry_run:
        store.record(
            [
                {
                    "id": uuid.uuid4().hex, "rule_id": o.rule_id, "kind": o.kind, "started_at": o.started,
                    "finished_at": o.started + timedelta(milliseconds=o.duration_ms), "duration_ms": o.duration_ms,
                    "status": o.status, "findings": o.findings, "raised": o.raised, "resolved": o.resolved, "error": o.error,
                }
                for o in summary.outcomes
            ]
        )
        store.prune()
    return summary


def _shared(spark: SparkSession, config: Config, tables: Mapping[str, DataFrame], known: list, as_of: str, partials: Partials | None) -> Mapping[str, DataFrame]:
    """Tables with what checks share; without it if that can't be made, so that each check meets its own failure."""
    shared = None
    try:
        shared = planner.shared(tables, known, as_of, partials)
        if shared is not None:
            within(spark, config.timeout_ms * len(known), shared.fill)
    except Exception:  # noqa: BLE001
        planner.release(shared or tables)
        shared = None
    return shared or tables


def _routed(merged: DataFrame, config: Config, checks: Mapping[str, Check], retry_pending: bool) -> DataFrame:
    """Alerts to announce and the destination of each; null: to be recorded only."""
    # What is announced is the first finding of a device.
    fresh = F.col("action") == "raise"
    own = lambda k: F.when(fresh, F.col(f"announced.{k}")).otherwise(F.col(k)).alias(k)
    wanted = fresh | ((F.col("action") == "touch") & F.col("notified_at").isNull()) if retry_pending else fresh
    alerts = merged.filter(wanted).select("action", "id", "rule_id", "kind", "dev_eui", "device_name", *map(own, ("severity", "summary", "detail")), "raised_at", "ordinal")
    if config.notify is None:
        return alerts.withColumn("destination", F.lit(None).cast("string"))
    n, per_kind = config.notify, {c.kind: c for c in config.enabled if c.rule in checks}

    def of_kind(value) -> Any:
        out = F.lit(RT.ABSENT)
        for kind, c in per_kind.items():
            out = F.when(F.col("kind") == kind, F.lit(value(c))).otherwise(out)
        return out

    to = RT.destination_column(F.col("severity"), of_kind(lambda c: checks[c.rule].routing), of_kind(lambda c: c.notify_to), n.by_severity, n.routing, n.default)
    return alerts.withColumn("destination", to)


def _merge(spark, config, checks, store, state, found, outcomes, as_of, retry_pending, post, summary) -> None:
    kinds = list(outcomes)
    merged = store.keep(RC.merge(state, found, as_of, kinds), "merged")
    for r in RC.counted(merged).collect():
        if o := outcomes.get(r["kind"]):
            o.findings, o.raised, o.resolved = r["findings"], r["raised"], r["resolved"]
    opened = merged.filter("action <> 'resolve'").select(*state.columns)
    closed = merged.filter("action = 'resolve'").select(*state.columns)
    store.write(opened, closed if summary.resolved else None)
    alerts = _routed(merged, config, checks, retry_pending)
    unrouted = alerts.filter("destination is null and action = 'raise'").count()
    if config.notify is None:
        summary.delivery.unrouted = unrouted
    else:
        rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
        worst_first = alerts.filter("destination is not null").orderBy(rank, "kind", "ordinal", "dev_eui")
        rows: Iterator[dict[str, Any]] = (r.asDict() for r in worst_first.toLocalIterator())  # one partition is held at a time
        summary.delivery = send_all(rows, config.notify.destinations, post)
        summary.delivery.unrouted = unrouted
        if summary.delivery.delivered_ids:
            ids = spark.createDataFrame([(i,) for i in summary.delivery.delivered_ids], "id string")
            store.write(RC.mark_notified(store.opened(), ids, as_of))
    store.discard(merged)
