"""Command line: list, verify, run, serve, status, init, test-notify, version.

Exit codes: 0 well, 1 a check failed or a problem was found, 2 wrong usage or configuration.
"""

from __future__ import annotations

import argparse
import signal
import sys

from .log import Log
from .plans import config as C
from .plans import registry
from .plans.verify import lookback, verify

VERSION = "0.1.0"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewatch", description=__doc__.split("\n")[0])
    p.add_argument("command", choices=["list", "verify", "run", "serve", "status", "init", "test-notify", "version"])
    p.add_argument("--config", help="configuration file (JSON)")
    p.add_argument("--events", help="folder of the event tables")
    p.add_argument("--jdbc", help="address of the database that has the event tables, instead of --events; its driver's jar must be on Spark's class path")
    p.add_argument("--retry-pending", action="store_true", help="send open alerts again whose delivery failed before")
    p.add_argument("--state", help="folder of alert state and ledger")
    p.add_argument("--checks", help="folder of further checks")
    p.add_argument("--as-of", help="time of the pass, YYYY-MM-DD HH:MM:SS (now)")
    p.add_argument("--dry-run", action="store_true", help="evaluate, write nothing")
    p.add_argument("--limit", type=int, default=100, help="rows of status")
    p.add_argument("--destination", help="destination for test-notify (all)")
    p.add_argument("--log", choices=["json", "text"], default="text")
    return p


def _need(args: argparse.Namespace, *names: str) -> None:
    for n in names:
        if getattr(args, n) is None:
            raise C.ConfigError(f"--{n} is needed for {args.command}")


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    log = Log(args.log)
    try:
        return _run(args, log, spark)
    except (C.ConfigError, registry.RegistryError) as e:
        log.error(str(e))
        return 2


def _run(args: argparse.Namespace, log: Log, spark) -> int:
    if args.command == "version":
        print(VERSION)
        return 0
    checks = registry.load(args.checks)
    if args.command == "list":
        for c in checks.values():
            print(f"{c.id:24} {c.severity:9} {c.routing:10} {c.description}")
        return 0
    if args.command == "test-notify":
        from .sources.notify import deliver, test_alert

        _need(args, "config")
        config = C.load(args.config)
        if config.notify is None:
            raise C.ConfigError("the configuration has no notify")
        names = [args.destination] if args.destination else list(config.notify.destinations)
        for name in names:
            if name not in config.notify.destinations:
                raise C.ConfigError(f"there is no destination {name}")
        results = [deliver([test_alert()], config.notify, {"test": ("fact", name)}) for name in names]
        for name, r in zip(names, results):
            (log.error if r.failed else log.info)("test sent" if not r.failed else "test failed", destination=name, errors=r.errors)
        return int(any(r.failed for r in results))

    from pyspark.sql import SparkSession

    from .operators import reconcile as RC
    from .plans.runner import run_pass
    from .plans.scheduler import Schedule, Service
    from .sources import tables as T
    from .sources.state import StateStore

    _need(args, "state")
    spark = spark or SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = StateStore(spark, args.state)
    if args.command == "init":
        store.initialise()
        return 0
    if args.command == "status":
        as_of = args.as_of or spark.sql("SELECT string(current_timestamp())").first()[0]
        for r in RC.status(store.read(), as_of, args.limit).collect():
            print(f"{r['severity']:9} {r['kind']:24} {r['dev_eui']}  {r['summary']}  since {r['raised_at']}")
        if args.config:
            n = RC.orphans(store.read(), [c.kind for c in C.load(args.config).enabled]).count()
            if n:
                log.warning("open alerts of checks that no longer run", alerts=n)
        return 0
    _need(args, "config", *([] if args.jdbc else ["events"]))
    config = C.load(args.config)

    def events():
        if not args.jdbc:
            return T.parquet(spark, args.events)
        return T.jdbc(spark, args.jdbc, until=args.as_of, hours=lookback(config, checks), timeout_ms=config.timeout_ms)

    tables = events()
    problems = verify(config, checks, T.columns(tables), store)
    if args.command in ("verify", "serve"):
        for p in problems:
            (log.error if p.level == "error" else log.warning)(p.message)
        bad = any(p.level == "error" for p in problems)
        if args.command == "verify" or bad:
            return int(bad)

    def once():
        s = run_pass(spark, config, checks, events(), store, args.as_of, args.dry_run, retry_pending=args.retry_pending)
        for o in s.outcomes:
            (log.error if o.status == "error" else log.info)("check", kind=o.kind, status=o.status, findings=o.findings, raised=o.raised, resolved=o.resolved, error=o.error)
        log.info("pass", raised=s.raised, resolved=s.resolved, errors=len(s.errors), delivered=s.delivery.delivered, failed=s.delivery.failed)
        return s

    if args.command == "run":
        return int(bool(once().errors))
    service = Service(Schedule(config.schedule, config.timezone), once, log)
    for name in (signal.SIGTERM, signal.SIGINT):
        signal.signal(name, lambda *_: service.stop())
    service.serve(run_on_start=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
