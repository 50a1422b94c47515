"""Rendezvous shards against a plain loop, their moves when shards come and go, slots, and written shards."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

from tidewatch.llm import sharding


def wins(key, weights):
    bids = [w / -math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) for s, w in enumerate(weights)]
    return bids.index(max(bids))


def test_against_brute_force(docs, corpus):
    got = sharding.assign(docs, [1.0, 2.0, 0.5], grown=1.5).collect()
    size = lambda t: len((t or "").encode())
    want = Counter()
    for i, t in corpus:
        key = "" if i is None else i
        want[i, size(t) + 16, zlib.crc32((t or "").encode()), wins(key, [1, 2, 0.5]), wins(key, [1, 2, 0.5, 1.5])] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want


def test_slots_are_gapless_and_by_key(spark):
    """A third of the rows has no key, another third one text and key."""
    rows = [(None, f"t{i % 5}") for i in range(300)] + [(7, "same")] * 300 + [(i, f"t{i}") for i in range(300)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), [1.0] * 4).collect()
    assert len(got) == 900
    for s in range(4):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in own]
        assert keys == sorted(keys)
    assert len({r.shard for r in got if r.doc_id is None}) == 1


def test_shares_and_moves(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    weights = [1.0, 1.0, 2.0, 4.0]
    got = sharding.assign(docs, weights, grown=2.0).collect()
    shares = Counter(r.shard for r in got)
    assert all(abs(shares[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate(weights))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {4} and abs(len(moved) / 20_000 - 0.2) < 0.02
    fewer = {r.doc_id: r.shard for r in sharding.assign(docs, weights[:3]).collect()}
    assert all(fewer[r.doc_id] == r.shard for r in got if r.shard != 3)


def test_written_shards(spark, docs, tmp_path):
    out = str(tmp_path / "shards")
    sharding.write(docs, out, [1.0] * 3)
    back = spark.read.parquet(out)
    assert back.select("row.*").exceptAll(docs).count() == docs.exceptAll(back.select("row.*")).count() == 0
    where = {(r.doc_id, r.text_crc32): r.shard for r in sharding.assign(docs, [1.0] * 3).collect()}
    assert all(where[r.row.doc_id, zlib.crc32((r.row.text or "").encode())] == r.shard for r in back.collect())


def test_odd(spark, nothing):
    assert sharding.assign(nothing, [1.0] * 4).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(nothing, [1.0, 0.0])
