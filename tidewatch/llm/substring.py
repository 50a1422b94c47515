"""Removal of word sequences that an earlier document has: fixed-block anchors.

Index: the non-overlapping reference blocks of BLOCK words of every document. Probes: every
rolling window of BLOCK words. A repeat of at least `window` = 13 words contains a whole reference
block of either document (13 >= 2 * BLOCK - 1), so each repeat has an anchor: a position whose
BLOCK words are a reference block elsewhere.

Anchors are found without moving a row for each probe: hashes of reference blocks go into a Bloom
filter of fixed size (BITS bits, 32 MB, whatever the input), probes that hit it mark their hash in a
second one; a reference block whose hash is marked, by another one or by a probe, is an anchor. A
repeated window holds a reference block of its own document, which is a reference block or a probe of
the other one, so only reference blocks need be looked up there: a probe's false hit marks its own
hash, but no reference block's. The filters are tables in the shared folder that workers read; they
don't pass through the driver. They have false hits only, never misses. Beyond some 10^8 blocks they let more places through, and the grouping then carries up to a
row for each word; results stay the same. Documents without an anchor are final after that pass and
never move.

Extension: a hit isn't extended against each document that has its block, which would be all pairs
of a group of copies. Each anchor is extended to both sides by its whole windows of `window` words,
and equal windows of all documents meet by their hashes: partial sums give each window's first
document, and where that is an earlier one, the window is a repeat. Neighbouring repeats join, which
makes them the maximal exact repeats of the document in earlier ones.

Of equal windows of one document only the first is grouped, so a sequence has at most one row for
each document. Copies of whole word sequences are set aside: only the first document of each sequence takes part
in the grouping, the others are repeats from end to end.

Defined results: null and empty texts and texts of separators have no words; texts shorter than a
window keep everything; a repeat within one document alone isn't removed; of rows with one doc_id
none counts as earlier than another; a null doc_id is later than all others; extra columns don't
matter. Equality of words, windows and sequences is equality of 64-bit hashes. Rows are told apart by
doc_id and text together, so rows of one doc_id may have different texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, table
from .words import Chunk, Pieces, chunks, mix, ngrams, signed

#: Bits of the filters of blocks and of sequences, in slices of SLICE bits; bits that one block sets.
BITS, SEQ_BITS, SLICE, HASHES = 1 << 28, 1 << 24, 1 << 16, 3
#: Parts of the windows that are grouped one after the other, so that shuffles hold one part at a time.
PASSES = 3

_U = np.uint64
_LAST = (1 << 63) - 1
_SLICES = BITS // SLICE
#: Kinds of marks: reference blocks, whole sequences, probes that hit.
_BLOCK, _SEQ, _PROBE = 0, 1, 2
#: Files that a table of filters is stored in.
FILES = 4


def _bits(h: np.ndarray) -> np.ndarray:
    """The HASHES bits of each hash, in rows."""
    return np.stack([(mix(h + _U(k)) >> _U(8)).astype(np.int64) % BITS for k in range(HASHES)])


def _seq_bits(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(8)).astype(np.int64) % SEQ_BITS)[None, :]


def _packed(kind: int, bits: np.ndarray, twice: bool) -> list[tuple[int, bytes, bool]]:
    at = bits // SLICE
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    low = (bits % SLICE).astype("<u2")
    stop = np.append(edge[1:], len(bits))
    return [(int(at[a]) + kind * _SLICES, low[a:b].tobytes(), twice) for a, b in zip(edge, stop)]


def _marks(kind: int, bits: np.ndarray) -> list[tuple[int, bytes, bool]]:
    """(slice, offsets in it, whether they were there at least twice)."""
    bits = np.sort(bits, axis=None)
    again = bits[1:] == bits[:-1]
    twice = np.unique(bits[1:][again])
    return _packed(kind, np.unique(bits), False) + _packed(kind, twice, True)


def _mark_batch(rows: list[tuple[int, bytes, bool]]) -> pa.RecordBatch:
    s, b, t = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(s, pa.int32()), pa.array(b, pa.binary()), pa.array(t, pa.bool_())], ["slice", "bits", "twice"]
    )


_MARK = "slice int, bits binary, twice boolean"


def _bitmaps(marks: DataFrame, wanted: dict[int, tuple[bool, bool]]) -> DataFrame:
    """A table of slices: the bits marked, and those marked at least twice, by kind as far as wanted. Tasks stream a
    slice's marks past an array of fixed size; the table has SLICE / 8 bytes for each slice in use and each bitmap wanted."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, seen = None, np.zeros(SLICE, np.uint8)

        def done():
            own = [np.packbits(seen > k).tobytes() if wanted[now // _SLICES][k] else None for k in (0, 1)]
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), *[pa.array([x], pa.binary()) for x in own]], ["slice", "once", "twice"]
            )

        for b in batches:
            for s, x, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if s != now:
                    if now is not None:
                        yield done()
                        seen[:] = 0
                    now = s
                at = np.frombuffer(x, "<u2")
                seen[at] = 2 if t else np.minimum(seen[at] + 1, 2)
        if now is not None:
            yield done()

    rows = marks.repartition("slice").sortWithinPartitions("slice", "twice").mapInArrow(run, "slice int, once binary, twice binary")
    return table(rows.repartition(FILES), "filter")


def _source(bitmaps: DataFrame, kind: int, k: int) -> tuple[tuple[str, ...], int, int]:
    """What _filter() needs to read a bitmap of _bitmaps(): k is 0, or 1 for the bits marked at least twice."""
    return tuple(re.sub(r"^file:/+", "/", f) for f in bitmaps.inputFiles()), kind, k


@lru_cache(maxsize=2)
def _filter(*sources: tuple[tuple[str, ...], int, int]) -> np.ndarray | None:
    """All bits of some bitmaps of one size, read by a worker and kept for its next tasks; None: there are none."""
    out, size = None, SLICE // 8
    for files, kind, k in sources:
        for name in files:
            fs, place = FileSystem.from_uri(name)
            for b in pq.read_table(place, filesystem=fs, columns=["slice", ("once", "twice")[k]]).to_batches():
                for s, bits in zip(b.column(0).to_pylist(), b.column(1)):
                    if s // _SLICES == kind:
                        if out is None:
                            out = np.zeros((SEQ_BITS if kind == _SEQ else BITS) // 8, np.uint8)
                        at = s % _SLICES * size
                        out[at : at + size] |= np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def _has(bitmap: np.ndarray | None, bits: np.ndarray) -> np.ndarray:
    """Whether all bits of each column are set."""
    out = np.full(bits.shape[1], bitmap is not None)
    for bit in bits if bitmap is not None else ():
        out &= (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
    return out


def _rolling(w: Pieces, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of every window of n words."""
    if len(w.hash) < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(w.doc[: len(w.hash) - n + 1] == w.doc[n - 1 :])
    return at, ngrams(w, n)[1]


def _is_reference(w: Pieces, at: np.ndarray, block: int) -> np.ndarray:
    return (at - w.first[w.doc[at]]) % block == 0


def _sequences(w: Pieces) -> np.ndarray:
    place = (np.arange(len(w.hash)) - w.first[w.doc]).astype(_U)
    total = np.zeros(w.n_docs, _U)
    np.add.at(total, w.doc, mix(w.hash + mix(place)))
    return mix(total + w.per_doc.astype(_U))


def _candidates(w: Pieces, shared: np.ndarray | None, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of the windows that hold an anchor: a reference block of their document whose hash is marked."""
    at, h = _rolling(w, block)
    own = _is_reference(w, at, block)
    at, h = at[own], h[own]
    hit = np.zeros(len(w.hash) + 1, np.int64)
    hit[at[_has(shared, _bits(h))]] = 1
    total = np.concatenate([[0], np.cumsum(hit)])
    at, g = _rolling(w, window)
    some = total[at + window - block + 1] > total[at]
    return at[some], g[some]


def _in_document(w: Pieces, at: np.ndarray, g: np.ndarray) -> np.ndarray:
    return mix(g + mix(w.doc[at].astype(_U)))


def _first_of_each(w: Pieces, at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's first window of each word sequence: the verdict on one holds for all of them."""
    first = np.sort(np.unique(_in_document(w, at, g), return_index=True)[1])
    return at[first], g[first]


def _all_like(w: Pieces, at: np.ndarray, window: int) -> np.ndarray:
    """All windows of the documents that are equal to those that start at some places."""
    every, g = _rolling(w, window)
    key = _in_document(w, every, g)
    return every[np.isin(key, key[np.searchsorted(every, at)])]


def _joined(c: Chunk, w: Pieces, keep: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    k = np.flatnonzero(keep)
    length, doc = (w.end - w.start)[k], w.doc[k]
    last = np.append(doc[1:] != doc[:-1], True)[: len(k)]
    place = np.concatenate([[0], np.cumsum(length + ~last)])
    before = np.cumsum(length) - length
    byte = np.arange(length.sum())
    out = np.full(place[-1], 0x20, np.uint8)
    out[np.repeat(place[:-1] - before, length) + byte] = c.buf[np.repeat(w.start[k] - before, length) + byte]
    edge = place[np.searchsorted(doc, np.arange(c.n + 1))]
    return [out[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (null: nothing was removed), kept_sha256 of every row of docs (doc_id, text)."""
    block = (window + 1) // 2
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    # key: the same only for rows of one doc_id (or none) and one text; doc_id alone doesn't tell rows apart.
    docs = docs.select(id_.alias("doc_id"), text.alias("text"), F.xxhash64(id_.isNull(), id_, text).alias("key"))

    def index(batches):
        for b in batches:
            for c in chunks(b.column("text")):
                w = Pieces(c)
                at, h = _rolling(w, block)
                yield _mark_batch(
                    _marks(_BLOCK, _bits(h[_is_reference(w, at, block)])) + _marks(_SEQ, _seq_bits(_sequences(w)[w.per_doc > 0]))
                )

    found = _bitmaps(docs.select("text").mapInArrow(index, _MARK), {_BLOCK: (True, True), _SEQ: (False, True)})
    blocks, copied = _source(found, _BLOCK, 0), _source(found, _SEQ, 1)

    def probe(batches):
        for b in batches:
            for c in chunks(b.column("text")):
                w = Pieces(c)
                at, h = _rolling(w, block)
                bit = _bits(h[~_is_reference(w, at, block)])
                yield _mark_batch(_packed(_PROBE, np.unique(bit[:, _has(_filter(blocks), bit)]), False))

    hits = _bitmaps(docs.select("text").mapInArrow(probe, _MARK), {_PROBE: (True, False)})
    shared = _source(found, _BLOCK, 1), _source(hits, _PROBE, 0)

    def split(batches):
        """Final rows of documents that can't hold a repeat; texts of the others."""
        for b in batches:
            for c in chunks(b.column("text")):
                w = Pieces(c)
                at, _ = _candidates(w, _filter(*shared), window, block)
                seq = _sequences(w)
                again = _has(_filter(copied), _seq_bits(seq)) & (w.per_doc > 0)
                hard = again | (np.bincount(w.doc[at], minlength=c.n) > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(c.row, c.n),
                        b.column("key").slice(c.row, c.n),
                        pa.array(w.per_doc.astype(np.int64)),
                        pa.array([_digest(x) for x in _joined(c, w, np.ones(len(w.start), bool))], pa.string()),
                        pa.array(signed(seq)),
                        pa.array(again),
                        pa.array([c.text_bytes(i).decode() if hard[i] else None for i in range(c.n)], pa.string()),
                    ],
                    ["doc_id", "key", "n_words", "sha", "seq", "again", "text"],
                )

    rows = table(docs.mapInArrow(split, "doc_id long, key long, n_words long, sha string, seq long, again boolean, text string"), "split")
    easy = rows.filter("text is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"), F.col("sha").alias("kept_sha256")
    )
    hard = rows.filter("text is not null").withColumn("order", F.coalesce("doc_id", F.lit(_LAST)))
    twice = hard.filter("again")  # only these can be copies
    firsts = twice.groupBy("seq").agg(F.min("order").alias("first"))
    later = twice.select("seq", "order", "doc_id", "n_words", "sha").join(firsts, "seq").filter("order > first")
    later = table(later.drop("first"), "copies")
    long = F.col("n_words") >= window
    copies = later.select(
        "doc_id",
        "n_words",
        F.when(long, F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(long, F.lit("")).alias("kept_text"),
        F.when(long, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    columns = ["doc_id", "order", "key", "n_words", "sha", "text"]
    firsts = twice.join(later.select("order", "seq").distinct(), ["order", "seq"], "left_anti")
    own = hard.filter("not again").select(*columns).union(firsts.select(*columns))

    def windows(batches):
        for b in batches:
            order, key = b.column("order").to_numpy(), b.column("key").to_numpy()
            for c in chunks(b.column("text")):
                w = Pieces(c)
                at, g = _candidates(w, _filter(*shared), window, block)
                at, g = _first_of_each(w, at, g)
                doc = w.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(g)), pa.array(order[c.row + doc]), pa.array(key[c.row + doc]), pa.array((at - w.first[doc]).astype(np.int32))],
                    ["g", "order", "key", "start"],
                )

    grams = table(own.select("order", "key", "text").mapInArrow(windows, "g long, order long, key long, start int"), "windows")
    forget(found)
    forget(hits)
    # The first document of each window comes from partial sums, and a join brings it back: Spark can split a common window's rows.
    repeats = []
    for k in range(PASSES):
        part = grams.filter(F.pmod("g", F.lit(PASSES)) == k)
        shared_by = part.groupBy("g").agg(F.min("order").alias("low"), F.max("order").alias("high")).filter("low < high").select("g", "low")
        repeats.append(table(part.join(shared_by, "g").filter("order > low").select("key", "start"), "repeats"))
    forget(grams)
    starts = table(reduce(DataFrame.union, repeats).groupBy("key").agg(F.collect_set("start").alias("starts")), "starts")
    for part in repeats:
        forget(part)

    def mark(batches):
        for b in batches:
            yield _mark_batch(_marks(_SEQ, _seq_bits(mix(b.column("key").to_numpy().view(_U)))))

    touched = _source(_bitmaps(starts.select("key").mapInArrow(mark, _MARK), {_SEQ: (True, False)}), _SEQ, 0)

    @F.pandas_udf("boolean")
    def may_change(key: pd.Series) -> pd.Series:
        return pd.Series(_has(_filter(touched), _seq_bits(mix(key.to_numpy().view(_U)))))

    def cut(batches):
        for b in batches:
            starts = b.column("starts").to_pylist()
            n, gone, kept, sha = [], [], [], []
            for c in chunks(b.column("text")):
                w = Pieces(c)
                own = [np.array(starts[c.row + i] or [], np.int64) + w.first[i] for i in range(c.n)]
                at = _all_like(w, np.concatenate(own), window)
                covered = np.zeros(len(w.start) + window, bool)
                for j in range(window):
                    covered[at + j] = True
                covered = covered[: len(w.start)]
                less = np.bincount(w.doc[covered], minlength=c.n)
                n += w.per_doc.tolist()
                gone += less.tolist()
                for text, cut_some in zip(_joined(c, w, ~covered), less > 0):
                    kept.append(text.decode() if cut_some else None)
                    sha.append(_digest(text))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    own = own.withColumn("changes", may_change("key"))  # false: surely not, and its text needn't move
    same = own.filter("not changes").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"), F.col("sha").alias("kept_sha256")
    )
    changed = own.filter("changes").join(starts, "key", "left").select("doc_id", "text", "starts")
    changed = changed.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return easy.union(copies).union(same).union(changed)
