"""Event tables: schemas, readers and the adapter for the test tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMON = "time timestamp, dev_eui string, device_name string, device_profile_name string"

SCHEMAS = {
    "event_up": f"deduplication_id string, {_COMMON}, f_cnt bigint, object string, rx_info string",
    "event_join": f"deduplication_id string, {_COMMON}, dev_addr string",
    "event_status": f"deduplication_id string, {_COMMON}, margin smallint, external_power_source boolean, battery_level_unavailable boolean, battery_level float",
    "event_log": f"id bigint, {_COMMON}, level string, code string, description string, context string",
    "event_ack": f"queue_item_id string, {_COMMON}, acknowledged boolean, f_cnt_down bigint",
}

#: Time of the queries over the test tables, after every event.
AS_OF = "2024-01-31 00:00:00"


def parquet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The event tables as Parquet folders. Those that lay_out() wrote have a column day, by which windows prune folders."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in SCHEMAS}


def lay_out(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Append event tables to folder, a subfolder for each day and in it files by device: what a window or a device's newest
    row needs lies together. A day of any size is split into files of Spark's advisory size."""
    for name, df in tables.items():
        rows = df.withColumn("day", F.to_date("time")).hint("rebalance", "day").sortWithinPartitions("day", "dev_eui", "time")
        rows.write.mode("append").partitionBy("day").parquet(f"{folder}/{name}.parquet")


def hottest_share(events: DataFrame) -> float:
    """The share of rows that the device with most of them has; 0 without rows."""
    counts = events.groupBy("dev_eui").agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("share")).first()["share"] or 0.0


def lay_out_by_device(tables: Mapping[str, DataFrame], database: str, folder: str, buckets: int = 64, uneven: float = 8.0) -> None:
    """Append event tables to a database of the catalogue (made in folder, if it isn't there): a subfolder for each day, in it a file for
    each of some buckets of devices, sorted by device and time, with a Bloom filter on the device (Parquet leaves it out where a dictionary has all of a file's devices).

    Windows prune days, and whatever groups, ranks or joins by device finds its rows together, without an exchange. A bucket is
    one task's, so a table in which a device has more than `uneven` buckets' share of the rows is refused: lay_out() splits such days. Read them with catalog(spark, database).
    """
    for name, df in tables.items():
        share = hottest_share(df)
        if share > uneven / buckets:
            raise ValueError(f"{name}: one device has {share:.0%} of the rows, more than {uneven:g} of {buckets} buckets; lay it out by day alone")
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}'")
    for name, df in tables.items():
        rows = df.withColumn("day", F.to_date("time")).repartition(buckets, "dev_eui")
        writer = rows.write.mode("append").partitionBy("day").bucketBy(buckets, "dev_eui").sortBy("dev_eui", "time")
        writer.option("parquet.bloom.filter.enabled#dev_eui", "true").saveAsTable(f"{database}.{name}")


def slices(until: datetime, hours: float, n: int) -> list[str]:
    """SQL conditions that part the time from hours before until, excluded, up to it."""
    edges = [until - timedelta(hours=hours * (n - k) / n) for k in range(n + 1)]
    at = lambda t: f"CAST('{t:%Y-%m-%d %H:%M:%S.%f}' AS TIMESTAMP)"
    return [f'"time" > {at(a)} AND "time" <= {at(b)}' for a, b in zip(edges, edges[1:])]


def jdbc(
    spark: SparkSession, url: str, until: str | None = None, hours: float = 720, n_slices: int = 8, timeout_ms: int = 15_000, fetch: int = 10_000, **properties: str
) -> dict[str, DataFrame]:
    """The event tables of a database, in slices of the time before until (now by default); every statement has the time limit.

    The driver's jar must be on Spark's class path. Spark hands filters and columns on to the database.
    """
    end = datetime.fromisoformat(until) if until else datetime.now(timezone.utc).replace(tzinfo=None)
    properties = {"queryTimeout": str(-(-timeout_ms // 1000)), "fetchsize": str(fetch), **properties}
    return {name: spark.read.jdbc(url, name, predicates=slices(end, hours, n_slices), properties=properties) for name in SCHEMAS}


def catalog(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Event tables that the session's catalogue has."""
    names = {t.name for t in spark.catalog.listTables(database)}
    return {name: spark.table(f"{database}.{name}" if database else name) for name in SCHEMAS if name in names}


def columns(tables: dict[str, DataFrame]) -> dict[str, set[str]]:
    return {name: set(df.columns) for name, df in tables.items()}


def probe(spark: SparkSession) -> dict[str, str]:
    """Who and what the session is, without reading data."""
    row = spark.sql("SELECT current_user() AS u, current_database() AS d").first()
    return {"version": spark.version, "user": row["u"], "database": row["d"]}


def from_events(events: DataFrame) -> dict[str, DataFrame]:
    """The five event tables from the test table events(event_id, ts, user_id, event_type, value, props)."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id").cast("string")
    base = events.select(
        F.col("event_id").cast("string").alias("deduplication_id"),
        F.col("ts").alias("time"),
        F.lpad(user, 16, "0").alias("dev_eui"),
        F.concat(F.lit("dev-"), user).alias("device_name"),
        F.concat(F.lit("profile-"), (F.col("user_id") % 4).cast("string")).alias("device_profile_name"),
        "event_id",
        "event_type",
        "value",
        k.alias("k"),
    )
    common = ["time", "dev_eui", "device_name", "device_profile_name"]
    reading = F.format_string(
        '{"%s":{"value":%s},"k":%d,"position":{"latitude":%s,"longitude":%s},"flag":"%s"}',
        "event_type",
        F.col("value").cast("decimal(18,2)").cast("string"),
        "k",
        (F.col("k") / 10 + 40).cast("decimal(6,1)").cast("string"),
        (F.col("k") / 20 - 95).cast("decimal(6,2)").cast("string"),
        F.when(F.col("k") >= 90, "Open").otherwise("closed"),
    )
    obj = F.when(F.col("k") % 10 == 0, F.lit(None)).when(F.col("k") % 10 == 1, "null").when(F.col("k") % 10 == 2, "{}").otherwise(reading)
    rx = F.when(
        F.col("k") % 7 != 0, F.format_string('[{"rssi":%d,"snr":%d},{"rssi":%d}]', -80 - F.col("k") % 50, F.col("k") % 12 - 6, -85 - F.col("k") % 40)
    )
    kind = lambda name: base.filter(F.col("event_type") == name)
    return {
        "event_up": base.select("deduplication_id", *common, F.col("event_id").alias("f_cnt"), obj.alias("object"), rx.alias("rx_info")),
        "event_join": kind("signup").select("deduplication_id", *common, F.lower(F.hex("k")).alias("dev_addr")),
        "event_status": kind("view").select(
            "deduplication_id",
            *common,
            (F.col("k") - 60).cast("smallint").alias("margin"),
            (F.col("k") % 5 == 0).alias("external_power_source"),
            (F.col("k") % 7 == 0).alias("battery_level_unavailable"),
            F.col("value").cast("float").alias("battery_level"),
        ),
        "event_log": kind("error").select(
            F.col("event_id").alias("id"),
            *common,
            (F.col("k") % 3).cast("string").alias("level"),
            (F.col("k") % 10).cast("string").alias("code"),
            F.concat(F.lit("code "), (F.col("k") % 10).cast("string")).alias("description"),
            F.lit(None).cast("string").alias("context"),
        ),
        "event_ack": kind("purchase").select(
            F.col("deduplication_id").alias("queue_item_id"),
            *common,
            F.when(F.col("k") % 5 == 0, F.lit(None)).otherwise(F.col("k") >= 50).alias("acknowledged"),
            F.col("event_id").alias("f_cnt_down"),
        ),
    }


def test_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
