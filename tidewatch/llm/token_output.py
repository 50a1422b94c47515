"""Token ids in training order: fixed-stride binary shards.

Every document becomes sequences of `length` token ids: its ids and an end mark, cut into pieces of
`length`, the last one filled up with end marks. Sequences are numbered 0 to n - 1 in order of
doc_id: texts are sorted in range partitions and encoded there, so that a number is the partition's
first one and a position in it, and no join brings it to the ids. A keyed Feistel permutation with cycle walking (values past n are permuted again) maps the number to its
global slot in training order: each sequence has its slot from its number alone, no shuffle decides
it, and the key reproduces it. Ranges of `per_shard` slots are the shards: slots are dense, so the
bounds of the range partitions are known without a sample; PASSES ranges of slots are shuffled one after
the other, which bounds the disk that shuffles take; each partition sorts its slots and writes its shards, each one binary file without a header, under a temporary name that is renamed when the
file is whole (a task that runs again replaces it by the same bytes). A slot's bytes start at
(slot mod per_shard) * stride, so that a reader can seek to any slot and resume there.

Defined results: null and empty texts give one sequence of end marks only; documents of equal doc_id
and nulls (they come first) are ordered by a hash of their text; repeated rows are numbered each;
extra columns don't matter; an empty table has no sequences and no shards.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

ROUNDS = 6
#: Shards that one task writes at most, where there are more tasks to have than shuffle partitions.
SHARDS_A_TASK = 16
#: Slot ranges that are shuffled and written one after the other, so that only this part of all ids is in shuffle files at once.
PASSES = 4
#: How a pattern may end. This part tells where white space ends that is followed by white space; elsewhere its last alternative does the same.
AHEAD = r"\s+(?!\S)|\s+"
_RUN = re.compile(r"\s\s").search


def _round_keys(key: int) -> list[int]:
    raw = hashlib.sha256(f"order-{key}".encode()).digest()
    return [int.from_bytes(raw[4 * i : 4 * i + 4], "little") for i in range(ROUNDS)]


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number below n: a bijection of 0 to n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(k) for k in _round_keys(key)]

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


@cache
def _encoding(path: str, pattern: str):
    """The public tokenizer of a rank file; once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids don't fit in two bytes")
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a text. A pattern that looks ahead takes half as long again as one that doesn't, and only white space
    followed by white space needs it: other texts' ids come by the pattern without it."""
    if not pattern.endswith(f"|{AHEAD}"):
        return _encoding(path, pattern).encode_ordinary
    plain = _encoding(path, pattern.removesuffix(AHEAD) + r"\s+").encode_ordinary
    return lambda text: _encoding(path, pattern).encode_ordinary(text) if _RUN(text) else plain(text)


def _stored(docs: DataFrame, path: str, pattern: str, end_id: int, length: int) -> DataFrame:
    """(p, i, doc_id, part, n_ids, ids) of each sequence, as a table: texts are range-partitioned by (doc_id, tie) and
    encoded in that order; i counts the sequences of range partition p. ids are length little-endian two-byte ids."""

    def run(batches):
        encode = _encoder(path, pattern)
        stride, end, at = 2 * length, int(end_id).to_bytes(2, "little"), 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["p", "i", "doc_id", "part", "n_ids", "ids"],
            )

        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for p, d, text in zip(b.column("p").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                raw = np.array(encode(text.as_py() or ""), "<u2").tobytes() + end
                for k, x in enumerate(range(0, len(raw), stride)):
                    piece = raw[x : x + stride]
                    for column, value in zip(out, (p, at, d, k, len(piece) // 2, piece + end * ((stride - len(piece)) // 2))):
                        column.append(value)
                    at += 1
                if len(out[0]) >= 4096:
                    yield batch()
                    out = ([], [], [], [], [], [])
            yield batch()

    text = F.col("text").cast("string")
    # Equal rows are alike, so they may be parted: a third of all rows with one id and text aren't one task's work.
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = source.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    rows = ordered.select(F.spark_partition_id().alias("p"), "doc_id", "text").mapInArrow(run, "p int, i long, doc_id long, part int, n_ids int, ids binary")
    return table(rows, "sequences")


def materialise(
    docs: DataFrame, path: str, pattern: str, end_id: int, length: int = 512, key: int = 20240131
) -> DataFrame:
    """(doc_id, part, n_ids, number, slot, ids) of every sequence of docs.

    The slot comes from the number by permute(); numbers are dense in order of (doc_id, tie, part).
    """
    return numbered(docs, path, pattern, end_id, length, key)[0]


def numbered(docs: DataFrame, path: str, pattern: str, end_id: int, length: int = 512, key: int = 20240131) -> tuple[DataFrame, int]:
    """What materialise() returns, and the number of its rows."""
    stored = _stored(docs, path, pattern, end_id, length)
    sizes = {r["p"]: r["n"] for r in stored.groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row for each range partition
    starts, n = np.zeros(max(sizes, default=0) + 1, np.int64), 0
    for p in sorted(sizes):
        starts[p], n = n, n + sizes[p]

    @F.pandas_udf("long")
    def slot(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, key))

    first = F.element_at(F.lit(starts), F.col("p") + 1)  # one literal, so that Python gets one column and one call a row
    rows = stored.withColumn("number", first + F.col("i")).withColumn("slot", slot("number"))
    return rows.select("doc_id", "part", "n_ids", "number", "slot", "ids"), n


def _open(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(re.sub(r"^file:/+", "/", folder).rstrip("/"))


def _file(place: str, shard: int) -> str:
    return f"{place}/shard-{shard:08d}.bin"


def shards(sequences: DataFrame, folder: str, length: int, per_shard: int = 4096, n: int | None = None) -> DataFrame:
    """Write the shards of sequences (n rows) into folder; returns every sequence's doc_id, part, n_ids, number, slot, shard,
    offset (the byte of the shard's file at which it starts) and digest (of the bytes written there). sequences is
    read once for each pass, so it should come from a stored table, as numbered() gives it."""
    spark, stride = sequences.sparkSession, 2 * length
    n = sequences.count() if n is None else n
    n_shards = -(-n // per_shard)
    fs, place = _open(folder)
    fs.create_dir(place, recursive=True)
    with fs.open_output_stream(f"{place}/layout.json") as f:
        f.write(json.dumps({"length": length, "per_shard": per_shard, "sequences": n}).encode())

    def write(batches):
        fs, place = _open(folder)
        out, name, due = None, None, None
        for b in batches:
            slots, ids = b.column("slot").to_pylist(), b.column("ids").to_pylist()
            for slot, raw in zip(slots, ids):
                if out is None:
                    due = slot // per_shard * per_shard
                    name = f"{place}/.{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(name)
                if slot != due or len(raw) != stride:
                    raise ValueError(f"slot {slot} of {len(raw)} bytes where {due} of {stride} bytes is due")
                out.write(raw)
                due += 1
                if due % per_shard == 0 or due == n:
                    out.close()
                    fs.move(name, _file(place, slot // per_shard))
                    out = None
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(k) for k in ("doc_id", "part", "n_ids", "number", "slot")],
                    pa.array([s // per_shard for s in slots], pa.int64()),
                    pa.array([s % per_shard * stride for s in slots], pa.int64()),
                    pa.array([hashlib.sha256(x).digest() for x in ids], pa.binary()),
                ],
                ["doc_id", "part", "n_ids", "number", "slot", "shard", "offset", "digest"],
            )
        if out is not None:
            raise ValueError(f"slot {due} is missing")

    done = []
    edges = [n_shards * k // PASSES for k in range(PASSES + 1)]
    for first, last in [(a, b) for a, b in zip(edges, edges[1:]) if a < b] or [(0, 0)]:
        parts = max(1, min(last - first, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(last - first) // SHARDS_A_TASK))))
        own = sequences.filter((F.col("slot") >= first * per_shard) & (F.col("slot") < last * per_shard))
        rows = own.repartitionById(parts, F.expr(f"cast((slot DIV {per_shard} - {first}) * {parts} DIV {max(1, last - first)} AS int)"))
        rows = rows.sortWithinPartitions("slot").mapInArrow(
            write, "doc_id long, part int, n_ids int, number long, slot long, shard long, offset long, digest binary"
        )
        done.append(table(rows, "shards"))
    return reduce(DataFrame.union, done)


def write_shards(sequences: DataFrame, folder: str, length: int, per_shard: int = 4096) -> DataFrame:
    """Write each shard as one file of folder, sequences of length ids in slot order; returns shard, rows, first_slot."""
    rows = shards(sequences, folder, length, per_shard)
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.min("slot").alias("first_slot"))


def read_from(spark, folder: str, slot: int, count: int, per_shard: int = 4096) -> DataFrame:
    """(slot, ids) of slots slot to slot + count - 1, in order: each shard's file is read from the first slot's byte on."""
    fs, place = _open(folder)
    with fs.open_input_stream(f"{place}/layout.json") as f:
        layout = json.loads(f.read())
    if layout["per_shard"] != per_shard:
        raise ValueError(f"the shards have {layout['per_shard']} sequences")
    stride, end = 2 * layout["length"], min(slot + count, layout["sequences"])
    first, last = slot // per_shard, -(-end // per_shard)

    def read(batches):
        fs, place = _open(folder)
        for b in batches:
            for shard in b.column("id").to_pylist():
                at, to = max(slot, shard * per_shard), min(end, (shard + 1) * per_shard)
                with fs.open_input_file(_file(place, shard)) as f:
                    f.seek(at % per_shard * stride)
                    while at < to:
                        k = min(1024, to - at)
                        raw = f.read(k * stride)
                        ids = [raw[i : i + stride] for i in range(0, k * stride, stride)]
                        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + k), pa.int64()), pa.array(ids, pa.binary())], ["slot", "ids"])
                        at += k

    return spark.range(first, max(first, last), 1, max(1, last - first)).mapInArrow(read, "slot long, ids binary")
