"""Tables between jobs, kept where every executor and the driver can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's own setting: shuffle files of a job go when it ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's limit to what a task hands Python at once, and ours: batches of 10,000 rows of text are several times as large.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in batches of BATCH_BYTES, unless it was given a limit: a task then
    holds a few MB of them in each process, whatever the texts' lengths. A longer text is a batch of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: a new one, on one machine (tests); else an error."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        place = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table() that nothing reads any more."""
    spark = df.sparkSession
    place = re.sub(r"^file:/+", "/", shared_dir(spark).rstrip("/"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.sub(r"^file:/+", "/", folder).startswith(f"{place}/"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def placed(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with place: 0, 1, ... within each group (null is one), in order. Rows are sorted in range partitions, and only
    their counts are summed by group, so a group of any size is dealt to many tasks. Equal rows get different places."""
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = table(rows, "ordered").withColumn("_p", F.shiftright("_at", 33))
    before = Window.partitionBy("_group").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(F.col(group).alias("_group"), F.col("_p").alias("_q")).agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # over a row for each range partition
    rows = rows.join(cells, rows[group].eqNullSafe(cells["_group"]) & (rows["_p"] == cells["_q"]))
    return rows.withColumn("place", F.col("_before") + F.col("_at") - F.col("_start")).select(*df.columns, "place")
