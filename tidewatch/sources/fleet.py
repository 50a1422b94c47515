"""Made-up fleets of any size, as DataFrames: uplinks by range and arithmetic, with planted faults whose findings are known beforehand.

Device d has fault number d % len(FAULTS); the others' uplinks come at even steps up to the fleet's end. One device (number 0, which has no fault)
may send a share of all rows, for tests of skew. No row passes Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is wrong with a device, by its number modulo their count; the first ones are healthy.
FAULTS = ("healthy", "healthy", "silent", "undecoded", "frozen", "hot-peak", "weak", "gone", "falls-back", "healthy")


@dataclass(frozen=True)
class Fleet:
    """devices with `steps` uplinks each, `minutes` apart; hot_share of all rows are further ones of device 0. Faults show in the last `late` uplinks."""

    devices: int
    steps: int
    minutes: int = 10
    hot_share: float = 0.0
    end: str = "2024-06-01 12:00:00"
    late: int = 12

    @property
    def rows(self) -> int:
        return self.devices * self.steps - self.of("silent") * self.late + self.more

    @property
    def more(self) -> int:
        return round(self.devices * self.steps * self.hot_share / (1 - self.hot_share))

    def of(self, fault: str) -> int:
        """How many devices have a fault."""
        kinds = [i for i, f in enumerate(FAULTS) if f == fault]
        return sum(max(0, -(-(self.devices - i) // len(FAULTS))) for i in kinds)

    def uplinks(self, spark: SparkSession) -> DataFrame:
        """event_up."""
        even = spark.range(self.devices * self.steps).select((F.col("id") % self.devices).alias("d"), F.floor(F.col("id") / self.devices).alias("g"), F.lit(0).cast("bigint").alias("place"), F.lit("e").alias("part"))
        hot = spark.range(self.more).select(F.lit(0).cast("bigint").alias("d"), (F.col("id") % self.steps).alias("g"), (1 + F.floor(F.col("id") / self.steps)).alias("place"), F.lit("h").alias("part"))
        rows = even.union(hot).withColumn("fault", F.element_at(F.array(*[F.lit(f) for f in FAULTS]), (F.col("d") % len(FAULTS) + 1).cast("int")))
        late = F.col("g") < self.late  # g counts back from the end
        is_ = lambda f: F.col("fault") == f
        rows = rows.filter(~(is_("silent") & late))
        forward = self.steps - F.col("g")
        reading = F.named_struct(
            F.lit("temp"), F.when(is_("frozen"), 20.5).when(is_("hot-peak") & late, 99.0).otherwise(20 + F.col("g") % 7),
            F.lit("total"), F.when(is_("falls-back") & (F.col("g") == 0), 0).otherwise(forward * 3),
            F.lit("level"), F.when(is_("gone") & late, F.lit(None)).otherwise(F.col("g") % 5),
        )
        rssi = F.when(is_("weak"), -120).otherwise(-80)
        text = F.col("d").cast("string")
        return rows.select(
            F.concat("part", F.lit("-"), text, F.lit("-"), F.lpad(forward.cast("string"), 9, "0"), F.lit("-"), F.col("place").cast("string")).alias("deduplication_id"),
            (F.lit(self.end).cast("timestamp") - F.make_dt_interval(mins=(F.col("g") * self.minutes).cast("int")) - F.make_dt_interval(secs=F.col("place") / 1000)).alias("time"),
            F.lpad(text, 16, "0").alias("dev_eui"),
            F.concat(F.lit("dev-"), text).alias("device_name"),
            F.concat(F.lit("profile-"), (F.col("d") % 3).cast("string")).alias("device_profile_name"),
            forward.alias("f_cnt"),
            F.when(is_("undecoded"), F.lit("{}")).otherwise(F.to_json(reading)).alias("object"),
            F.to_json(F.array(F.named_struct(F.lit("rssi"), rssi, F.lit("snr"), F.lit(5)))).alias("rx_info"),
        )

    def checks(self) -> list[tuple[dict, int]]:
        """Checks, and how many devices each finds."""
        hours = self.steps * self.minutes / 60 + 1
        window = {"lookbackHours": int(hours) + 1}
        return [
            ({"rule": "device-silent", "params": {"silentMinutes": (self.late - 1) * self.minutes + self.minutes // 2, "inventoryHours": int(hours) + 1}}, self.of("silent")),
            ({"rule": "decode-failure", "params": {**window, "minFailureRatio": 0.9}}, self.of("undecoded")),
            ({"rule": "signal-degraded", "params": {**window, "rssiThresholdDbm": -110, "minUplinks": 5}}, self.of("weak")),
            ({"rule": "measurement-stuck", "params": {**window, "paths": ["temp"], "minSamples": 5}}, self.of("frozen")),
            ({"rule": "measurement-peak", "params": {**window, "paths": ["temp"], "threshold": 90}}, self.of("hot-peak")),
            ({"rule": "measurement-missing", "params": {**window, "paths": ["level"], "recentHours": max(1, self.late * self.minutes // 60 - 1), "minRecentUplinks": 2}}, self.of("gone")),
            ({"rule": "counter-stalled", "params": {**window, "paths": ["total"], "minSamples": 3}}, self.of("falls-back")),
        ]
