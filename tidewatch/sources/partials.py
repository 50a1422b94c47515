"""Stored partial sums of readings: any window's statistics without its raw rows.

append() sums up a batch of uplinks by device, name, profile, path and hour (the hour's start excluded, its end included, as in
windows) and writes two tables, a folder for each batch and in it one for each day: values, a row for each different value
with its count and its first and last reading; and hours, a row for each hour with count, total, extremes, first and last.
Partial sums merge: an hour that gets late rows gets rows of another batch, and nothing written is changed. A batch that is tried again
replaces its own.

stats() merges the hours that lie wholly in a window and reads raw uplinks of its edges only, an hour at each
end at most. Values are read where their number or rounding counts, hours where not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import payload
from ..operators import resolvers as R
from ..operators.scope import Scope

HOUR = 3_600_000_000
_KEY = ("dev_eui", "device_name", "device_profile_name", "path", "hour")


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _end(f, at: str) -> Column:
    return f(F.struct(f"{at}.time", f"{at}.deduplication_id", F.col("num")))


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,12)")


class Partials:
    """Partial sums in a folder, of the readings of certain paths. paths: names by which checks call them, with dots."""

    def __init__(self, spark: SparkSession, folder: str, paths: R.Paths):
        self.spark, self.folder, self.paths = spark, folder.rstrip("/"), {".".join(p): tuple(p) for p in paths}

    def has(self, paths: R.Paths) -> bool:
        """Whether the readings of all these paths are summed up here."""
        return all(".".join(p) in self.paths for p in paths)

    def values_of(self, uplinks: DataFrame) -> DataFrame:
        """Uplinks summed up by hour and value."""
        hour = F.floor((_micros(F.col("time")) - 1) / HOUR).cast("bigint")
        rows = uplinks.filter(F.col("object").isNotNull()).withColumn("hour", hour)
        found = payload.readings(rows, self.paths, "dev_eui", "device_name", "device_profile_name", "hour", "time", "deduplication_id")
        when = F.struct("time", "deduplication_id")
        return found.groupBy(*_KEY, "num").agg(F.count("*").alias("n"), F.min(when).alias("lo"), F.max(when).alias("hi"))

    @staticmethod
    def hours_of(values: DataFrame) -> DataFrame:
        """Values summed up by hour."""
        return values.groupBy(*_KEY).agg(
            F.sum("n").alias("n"), F.sum(_wide(F.col("num") * F.col("n"))).alias("total"), F.min("num").alias("vmin"), F.max("num").alias("vmax"),
            _end(F.min, "lo").alias("lo"), _end(F.max, "hi").alias("hi"),
        )

    def append(self, uplinks: DataFrame, batch: int | str) -> None:
        """Sum up a batch of new uplinks, of any time; a batch of the same name is replaced."""
        day = F.floor(F.col("hour") / 24).cast("int")
        to = lambda name: f"{self.folder}/{name}/batch={batch}"
        values = self.values_of(uplinks)
        values.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(to("values"))
        written = self.spark.read.schema(values.schema).parquet(to("values"))
        self.hours_of(written).withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(to("hours"))

    def _read(self, name: str, like: DataFrame, first: int, last: int) -> DataFrame:
        """Stored rows of hours first to last - 1."""
        schema = StructType([*like.schema.fields, StructField("batch", StringType()), StructField("day", IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        rows = rows.filter((F.col("day") >= first // 24) & (F.col("day") <= (last - 1) // 24))
        return rows.filter((F.col("hour") >= first) & (F.col("hour") < last)).select(*like.columns)

    def stats(self, up: DataFrame, paths: R.Paths, hours: float, scope: Scope, as_of: str, decimals: int | None = None, distinct: bool = True) -> DataFrame:
        """resolvers.window_stats; without distinct the number of different values is null and no value but extremes and ends is read."""
        if not self.has(paths):
            raise LookupError(f"paths that aren't stored: {[p for p in paths if '.'.join(p) not in self.paths]}")
        ends = self.spark.sql("SELECT 1").select(_micros(R.since(up, as_of, hours)), _micros(R.moment(up, as_of))).first()
        first, last = -(-ends[0] // HOUR), ends[1] // HOUR
        at = lambda hour: F.timestamp_micros(F.lit(hour * HOUR)).cast(up.schema["time"].dataType)
        edges = R.window(up, as_of, hours)
        if first < last:
            edges = edges.filter((F.col("time") <= at(first)) | (F.col("time") > at(last)))
        names = [".".join(p) for p in paths]
        order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path")) - 1
        mine = lambda rows: scope.apply(rows.filter(F.col("path").isin(names))).withColumn("ord", order.cast("int"))
        values = self.values_of(edges)
        if distinct or decimals is not None:
            whole = values.unionByName(self._read("values", values, first, last)) if first < last else values
            ends_of = (F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("device_name").alias("device_name"))
            found = R.rounded(mine(whole), decimals).groupBy("dev_eui", "ord", "num").agg(F.sum("n").alias("n"), *ends_of)
            return R.stats_of_values(found, paths)
        sums = self.hours_of(values)
        whole = sums.unionByName(self._read("hours", sums, first, last)) if first < last else sums
        merged = mine(whole).groupBy("dev_eui", "ord").agg(
            F.max("device_name").alias("device_name"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.sum("total").alias("total"),
            F.sum("n").alias("samples"), F.lit(None).cast("bigint").alias("distinct_values"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        )
        return R.winners(merged, paths)
