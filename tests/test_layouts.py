"""Tables by device and daily summaries: fewer exchanges and no second reading, with the same rows."""

import glob

import pytest
from pyspark.sql import functions as F

from tests.golden import AS_OF, Store
from tests.test_shared_sums import fleet, rows
from tidewatch.operators import resolvers as R
from tidewatch.operators.scope import Scope
from tidewatch.plans.checks import CHECKS, Context
from tidewatch.sources import tables as T
from tidewatch.sources.daily import Daily


def even_fleet(n=40):
    s = Store()
    for i in range(n):
        s.up(f"{i:x}", f"n{i}", 12, 37 + i, lambda g: {"a": g}, start=i * 20)
        s.add("event_join", f"{i:x}", f"n{i}", i * 3, dev_addr="a")
        s.add("event_join", f"{i:x}", f"n{i}", i * 5, dev_addr=f"{i % 3}")
    return s


def plan_of(df):
    df.collect()  # the plan that ran, after adaptive changes
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("by-device"))
    tables = {k: even_fleet().tables(spark)[k] for k in ("event_up", "event_join")}
    for _ in range(2):  # two appends: several files in a bucket
        part = {k: df.filter(F.pmod(F.xxhash64("deduplication_id"), F.lit(2)) == _) for k, df in tables.items()}
        T.lay_out_by_device(part, "fleet_by_device", folder, buckets=8, uneven=4)
    return tables, T.catalog(spark, "fleet_by_device"), folder


@pytest.mark.parametrize("rule, params", [("device-silent", {"silentMinutes": 60, "minUplinks": 1}), ("join-churn", {"maxJoins": 1}), ("decode-failure", {"minFailures": 1, "minFailureRatio": 0.001})])
def test_checks_by_device_move_no_row(laid_out, rule, params):
    plain, by_device, _ = laid_out
    found = CHECKS[rule].run(Context(by_device, params, AS_OF))
    assert "hashpartitioning(dev_eui" not in plan_of(found)
    assert rows(found) == rows(CHECKS[rule].run(Context(plain, params, AS_OF)))


def test_newest_by_device_moves_no_row(laid_out):
    plain, by_device, _ = laid_out
    newest = lambda t: R.newest_decoded(t["event_up"], 48, Scope(), AS_OF)
    plan = plan_of(newest(by_device))
    assert "hashpartitioning" not in plan and "SelectedBucketsCount: 8 out of 8" in plan
    assert rows(newest(by_device)) == rows(newest(plain)) and "hashpartitioning(dev_eui" in plan_of(newest(plain))


def test_files_have_bloom_filters(spark, tmp_path):
    """Parquet writes them where no dictionary holds all devices of a file; here dictionaries are off."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.enable.dictionary", "false")
    try:
        T.lay_out_by_device({"event_up": even_fleet(8).tables(spark)["event_up"]}, "bloom_by_device", str(tmp_path), buckets=2, uneven=1.5)
    finally:
        conf.unset("parquet.enable.dictionary")
    path = jvm.org.apache.hadoop.fs.Path(glob.glob(f"{tmp_path}/event_up/day=*/*.parquet")[0])
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
    offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in reader.getFooter().getBlocks().get(0).getColumns()}
    reader.close()
    assert offsets["dev_eui"] > 0 > offsets["device_name"]


def test_a_hot_device_is_refused(spark, tmp_path):
    tables = {"event_up": fleet().tables(spark)["event_up"]}
    assert 0.25 < T.hottest_share(tables["event_up"]) < 0.5
    with pytest.raises(ValueError, match="event_up"):
        T.lay_out_by_device(tables, "hot_by_device", str(tmp_path), buckets=64)
    assert T.hottest_share(tables["event_up"].limit(0)) == 0


# -- Daily summaries -------------------------------------------------------------------------------


def test_census_is_exact_over_any_days(spark, tmp_path):
    """Devices that come in several batches and profiles are counted once; a batch that is written again changes nothing."""
    up = fleet(5, 1200).tables(spark)["event_up"]
    daily = Daily(spark, str(tmp_path), [("a",)])
    part = F.pmod(F.xxhash64("deduplication_id"), F.lit(3))
    for b in (0, 1, 1, 2, 0):
        daily.append(up.filter(part == b), b)
    day = F.to_date("time")
    for first, last in (("2024-05-30", "2024-06-01"), ("2024-05-31", "2024-05-31"), ("2030-01-01", "2030-01-02")):
        some = up.filter(day.between(F.lit(first), F.lit(last)))
        counts = (F.count("*").alias("uplinks"), F.count_distinct("dev_eui").alias("devices"))
        assert rows(daily.census(first, last)) == rows(some.groupBy("device_profile_name").agg(*counts))
        whole = daily.census(first, last, by_profile=False).collect()
        assert [tuple(r) for r in whole] == [tuple(r) for r in some.agg(*counts).collect()]
    numbers = [r["number"] for r in spark.read.parquet(f"{tmp_path}/numbers").collect()]
    assert sorted(numbers) == list(range(1, up.select("dev_eui").distinct().count() + 1))


def test_sketches_stay_within_their_bound(spark, tmp_path):
    """A million readings in four batches: the rank of each answer is within the sketches' bound."""
    n = 1_000_000
    base = spark.range(0, n, 1, 8).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(1_000_003)))
    up = base.select(
        F.lit("e").alias("dev_eui"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("device_profile_name"), F.timestamp_seconds(F.lit(1717200000) + F.col("id") % 200_000).alias("time"),
        F.format_string('{"a":%d}', "x").alias("object"), "id", "x",
    )
    daily = Daily(spark, str(tmp_path), [("a",)])
    for b in range(4):
        daily.append(up.filter(F.col("id") % 4 == b), b)
    shares = (0.0, 0.05, 0.5, 0.95, 1.0)
    found = {r["device_profile_name"]: r for r in daily.quantiles("2024-06-01", "2024-06-03", *shares).collect()}
    assert sum(r["n"] for r in found.values()) == n
    for profile, r in found.items():
        own = up.filter(F.col("device_profile_name") == profile)
        counts = own.agg(*[F.count_if(F.col("x") <= q).alias(f"c{i}") for i, q in enumerate(r["quantiles"])], F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        assert all(abs(counts[f"c{i}"] / r["n"] - s) < 0.002 for i, s in enumerate(shares))
        assert (r["least"], r["greatest"]) == (counts["lo"], counts["hi"])


def test_empty(spark, tmp_path):
    daily = Daily(spark, str(tmp_path), [("a",)])
    assert daily.census("2024-01-01", "2024-01-02").count() == 0
    daily.append(fleet().tables(spark)["event_up"].limit(0), 0)
    assert daily.census("2024-01-01", "2024-01-02").count() == 0 and daily.quantiles("2024-01-01", "2024-01-02", 0.5).count() == 0
