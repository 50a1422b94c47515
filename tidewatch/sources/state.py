"""Alert state and run ledger in a folder: versioned snapshots, no table format needed.

A pass writes open/v=N, the open alerts, and closed/pass=N, those that it resolved, and then a marker
in _current that names N. Readers take the newest marker, so a pass is seen whole or not at all; a
version being read is never overwritten. Of two passes at once the first to claim the version writes it; the other fails. Closed alerts are written once and never read by a pass, so
a pass costs what is open, however long the history. Paths are any file system that Spark knows.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import STATE

RUN = (
    "id string, rule_id string, kind string, started_at timestamp, finished_at timestamp, duration_ms bigint, status string, "
    "findings bigint, raised bigint, resolved bigint, error string"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that executors and driver share: under spark.checkpoint.dir. Where that is unset: a local one, on one machine; else an error."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
    return f"{(place or tempfile.mkdtemp(prefix='tidewatch-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: A claim older than this is one of a pass that died.
CLAIM_SECONDS = 3600


class StateStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def version(self) -> int:
        """The newest complete version; 0 before the first."""
        fs, p = self._fs("_current")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0)

    def exists(self) -> bool:
        fs, p = self._fs("_current")
        return fs.exists(p)

    def initialise(self) -> None:
        """Make the folders; harmless if they are there."""
        for name in ("_current", "runs"):
            fs, p = self._fs(name)
            fs.mkdirs(p)

    def opened(self) -> DataFrame:
        """The open alerts."""
        n = self.version()
        if n == 0:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/open/v={n}")

    def closed(self) -> DataFrame:
        """The resolved alerts of all complete passes."""
        fs, p = self._fs("closed")
        if not fs.exists(p):
            return self.spark.createDataFrame([], STATE)
        rows = self.spark.read.schema(f"{STATE}, pass bigint").parquet(f"{self.folder}/closed")
        return rows.filter(F.col("pass") <= self.version()).drop("pass")

    def read(self) -> DataFrame:
        """All alerts, open and resolved."""
        return self.opened().unionByName(self.closed())

    def write(self, opened: DataFrame, closed: DataFrame | None = None) -> int:
        """A new version: the alerts that are open now, and those that this pass resolved."""
        n = self.version() + 1
        fs, p = self._fs(f"_claims/{n}")
        if not fs.createNewFile(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 < CLAIM_SECONDS:
            raise RuntimeError(f"version {n} is being written by another pass")
        try:
            return self._write(n, opened, closed)
        finally:
            fs.delete(p, False)

    def _write(self, n: int, opened: DataFrame, closed: DataFrame | None) -> int:
        fs, p = self._fs(f"_current/{n}")
        if fs.exists(p):
            raise RuntimeError(f"version {n} was written by another pass meanwhile")
        opened.write.mode("overwrite").parquet(f"{self.folder}/open/v={n}")
        self._delete(f"closed/pass={n}")  # of a pass that didn't end
        if closed is not None:
            closed.write.mode("overwrite").parquet(f"{self.folder}/closed/pass={n}")
        fs.create(p, False).close()
        return n

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written beside the state and read back; discard() takes it away again."""
        path = f"{self.folder}/work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, *frames: DataFrame) -> None:
        """Delete what keep() wrote."""
        for folder in {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in frames for f in df.inputFiles()}:
            self._delete(f"work/{folder}")

    def prune(self, keep: int = 3) -> None:
        """Delete versions of the open alerts older than the last few; closed alerts stay."""
        fs, p = self._fs("open")
        old = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        for n in sorted(int(x[2:]) for x in old if x.startswith("v=")):
            if n <= self.version() - keep:
                self._delete(f"open/v={n}")
                self._delete(f"_current/{n}")

    def record(self, runs: list[dict]) -> bool:
        """Append to the run ledger. A ledger that can't be written doesn't fail a pass."""
        if not runs:
            return True
        try:
            self.spark.createDataFrame(runs, RUN).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        except Exception:  # noqa: BLE001
            return False
        return True

    def ledger(self) -> DataFrame:
        fs, p = self._fs("runs")
        if not fs.exists(p) or not fs.listStatus(p):
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(f"{self.folder}/runs")

    def duplicates(self) -> DataFrame:
        """Keys with more than one open alert; empty if all is well."""
        return self.opened().groupBy("dev_eui", "kind").agg(F.count("*").alias("n")).filter("n > 1")
