"""Shards by rendezvous hashing, with gapless slots.

Each shard bids for each key: a hash of key and shard, as a fraction u between 0 and 1, gives weight / -ln(u), and the
highest bid wins. A shard's share is proportional to its weight; a shard that is added takes the keys for which it bids highest and
moves no other, and one that is removed gives away its own keys only. Nothing but key, shard number and weight decides:
neither the order nor the number of rows, nor other keys. The hash is MD5, so any engine finds the same shard.

Slots number a shard's rows by key. Rows are sorted in range partitions of (shard, key), of which one shard has many, and
only counts are summed by shard; equal keys are told apart by text, and equal rows by a hash of their place, so that no key's
rows need to fit into one task.

Defined results: rows without a key have the empty key, and so one shard; null text has size 16 and the checksum of
empty text; repeated rows stay together (one key), each with a slot of its own; a table without rows gives none; extra columns don't
matter, or come back in the struct `row`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, placed, table

#: Hexadecimal digits of MD5 that make a fraction: 52 bits, which a double holds.
DIGITS = 13
#: Bytes that a row takes besides its text.
OVERHEAD = 16


def bids(key: Column, weights: Sequence[float]) -> Column:
    """Array of each shard's bid for a key (string)."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard's weight must be above 0")

    def bid(weight: Column, shard: Column) -> Column:
        digest = F.md5(F.concat_ws(":", key, shard.cast("string")).cast("binary"))
        u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
        return weight / -F.log(u)

    return F.transform(F.array(*[F.lit(float(w)) for w in weights]), bid)


def winner(found: Column) -> Column:
    """The number of the highest bid; of equal ones the first."""
    return (F.array_position(found, F.array_max(found)) - 1).cast("int")


def assign(
    docs: DataFrame,
    weights: Sequence[float],
    grown: float | None = None,
    key: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard and, with carry, row) of each row; grown is the weight of one more
    shard, whose keys' grown_shard is its number."""
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    source = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        bids(own, [*weights, *([] if grown is None else [grown])]).alias("bids"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    now = winner(F.slice("bids", 1, len(weights))).alias("shard")
    then = (winner(F.col("bids")) if grown is not None else F.lit(None).cast("int")).alias("grown_shard")
    rest = ["row"] if carry else []
    keyed = table(source.select("key", "size", "text_crc32", now, then, *rest), "keyed")
    salted = keyed.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    numbered = placed(salted, "shard", "key", "text_crc32", "size", "salt")
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", "shard", F.col("place").alias("slot"), "grown_shard", *rest)


def write(docs: DataFrame, folder: str, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> None:
    """Write all columns of docs as Parquet, a folder for each shard (shard=N), its rows in files by slot."""
    found = assign(docs, weights, key=key, text=text, carry=docs.columns)
    found = found.select("row", "slot", "shard").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    found.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
