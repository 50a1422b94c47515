"""Word, n-gram and line hashing over whole Arrow text columns.

All functions work on the UTF-8 bytes of many documents at once with numpy; the
separators (space and the control characters 9 to 13) are single bytes, so bytes
can be split without decoding. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW = _powers(_BASE, 1 << 16)
_HIGH = _powers(pow(_BASE, 1 << 16, 1 << 64), 1 << 12)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def _power(at: np.ndarray) -> np.ndarray:
    if len(at) == 0 or at.max() < 1 << 16:
        return _LOW[at]
    return _LOW[at & 0xFFFF] * _HIGH[at >> 16]


class Chunk:
    """Some whole documents of a column: row range, byte buffer and offsets from 0."""

    def __init__(self, row: int, buf: np.ndarray, offsets: np.ndarray):
        self.row, self.buf, self.offsets = row, buf, offsets
        self.n = len(offsets) - 1

    def text_bytes(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into runs of documents of about max_bytes; a longer document is a run of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(col):
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(max(end, row + 1), len(col))
        yield Chunk(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


class Pieces:
    """Maximal runs of bytes that aren't separators: byte spans, document of each, hash of each."""

    def __init__(self, chunk: Chunk, separator: np.ndarray = SEPARATOR, lower: bool = False):
        buf, offsets = chunk.buf, chunk.offsets
        inside = ~separator[buf]
        first = np.zeros(len(buf) + 1, bool)
        first[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside
        ends[:-1] = inside[:-1] & (separator[buf[1:]] | first[1:-1])
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n_docs = chunk.n
        self.per_doc = np.bincount(self.doc, minlength=chunk.n)
        self.first = np.concatenate([[0], np.cumsum(self.per_doc)])
        table = np.where(separator, _U(0), _BYTE_LOWER if lower else _BYTE)
        self.hash = segment_hash(buf, self.start, table)


def segment_hash(buf: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to the next start; bytes that table maps to 0 don't count."""
    if not len(starts):
        return np.zeros(0, _U)
    at = np.arange(len(buf), dtype=np.int64)
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(buf))))
    at[: starts[0]] = 0
    return mix(np.add.reduceat(table[buf] * _power(at), starts))


def byte_table() -> np.ndarray:
    return _BYTE


_STEP = [pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(64)]


def ngrams(words: Pieces, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n consecutive words of a document; with short, a document
    with fewer words gives its whole sequence as one."""
    count = len(words.hash)
    if count >= n:
        h = np.zeros(count - n + 1, _U)
        for j in range(n):
            h += words.hash[j : count - n + 1 + j] * _U(_STEP[j])
        ok = words.doc[: count - n + 1] == words.doc[n - 1 :]
        doc, h = words.doc[: count - n + 1][ok], mix(h[ok])
    else:
        doc, h = np.zeros(0, np.int64), np.zeros(0, _U)
    if short:
        few = np.flatnonzero((words.per_doc > 0) & (words.per_doc < n))
        if len(few):
            s = words.per_doc[few].astype(_U) * _U(0xA0761D6478BD642F)
            for j in range(n - 1):
                has = words.per_doc[few] > j
                s[has] += words.hash[words.first[few[has]] + j] * _U(_STEP[j + 1])
            doc, h = np.concatenate([doc, few]), np.concatenate([h, mix(s)])
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
    return doc, h


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, sorted by both."""
    if not len(h):
        return doc, h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
