"""Byte-level BPE encoding and decoding as a tree reduction.

Encodings of byte strings under concatenation form a monoid whose product is "join and
re-encode what the seam can change". A piece of text is encoded by halves, recursively; to
join two encodings, a window of tokens on both sides of the seam is encoded anew and grown
until its outer neighbours provably stay as they are.

Why that is provable: a token sequence is the BPE encoding of its bytes exactly if each
neighbouring pair is, by itself, the encoding of its own bytes (merging proceeds by lowest
rank, so a merge across the pair's border happens in the whole string if and only if it
happens in the pair alone). Hence a window is wide enough as soon as its first and last
tokens form stable pairs with the tokens outside; everything farther out was stable already.

Pieces are the matches of the vocabulary's pattern, each encoded separately; encodings of
whole texts concatenate, and so do decodings: decoding maps each id to its bytes and concatenates
up a tree of halves. Texts are cut at single spaces between other characters, where the pattern
always starts a new match, and encodings of short parts are kept in a table that is bounded in
entries and in the length of each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Strings up to this many bytes are encoded directly; encodings of strings up to twice as long are kept.
LEAF_BYTES = 5
#: Bytes from which neighbours are kept in a heap.
LONG_LEAF = 100
#: Bytes from which the first half's last tokens are encoded again with the second half, and how many of them.
LONG_PIECE, CARRIED = 4096, 8
#: Entries of a worker's tables: encodings of texts' parts, of pairs of tokens, of short strings.
PARTS_KEPT, PAIRS_KEPT, SHORT_KEPT = 220_000, 150_000, 100_000
#: Characters of the longest part whose encoding is kept; tokens that one leaf of the decoding tree joins.
PART_CHARS, LEAF_TOKENS = 32, 1024
#: A space before white space, where a cut could differ from the pattern's.
_UNSAFE = re.compile(r" \s").search


class _Kept(dict):
    """A table that makes what it is asked for. When it is full it becomes the older half, from which
    what is asked for again moves back: what is in use stays, and size is bounded by twice the limit."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        found = self.older.pop(key, None) if self.older else None
        if found is None:
            found = self.make(key)
            if len(key) > PART_CHARS:  # seldom seen twice, and of any length
                return found
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Codec:
    """Encoder and decoder for a rank file; ranks: bytes to id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self._own = {b: b for b in ranks}  # one object for each token, whoever cuts it out
        self._text = {b: str(i) for b, i in ranks.items()}
        self._token = {str(i): b for b, i in ranks.items()}
        self._pairs = _Kept(lambda pair: self._leaf(pair[0] + pair[1]), PAIRS_KEPT)
        self._short = _Kept(self._halves, SHORT_KEPT)
        self._texts = _Kept(self.part_text, PARTS_KEPT)

    def forget(self) -> None:
        """Empty the tables of encodings. A worker outlives its task, and other operators' tasks need the memory."""
        for kept in (self._pairs, self._short, self._texts):
            kept.forget()

    # -- bytes of one piece -----------------------------------------------------------------

    def _leaf(self, data: bytes) -> list[bytes]:
        """Merge the neighbours of lowest rank, first ones first, until none has a rank."""
        if data in self.ranks:
            return [data]
        if len(data) > LONG_LEAF:
            return self._long_leaf(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        scores = [ranks.get(data[i : i + 2], 1 << 60) for i in range(len(data) - 1)]
        while scores:
            low = min(scores)
            if low == 1 << 60:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [self._own[p] for p in parts]

    def _long_leaf(self, data: bytes) -> list[bytes]:
        """_leaf of many bytes: neighbours in a heap by rank and place, parts in a linked list."""
        rank, n = self.ranks.get, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place; 0: none does
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle == n or end[middle] != stop:
                continue  # one of the two was merged since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := rank(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return [self._own[data[i:e]] for i, e in enumerate(end) if e]

    def _stable(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens' bytes are encoded as these two."""
        return self._pairs[a, b] == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the two encodings' bytes together."""
        if not left or not right:
            return left or right
        a, b, window = 1, 1, self._pairs[left[-1], right[0]]
        if len(window) == 2 and window[0] == left[-1]:
            return left + right
        while True:
            grow_left = a < len(left) and not self._stable(left[-a - 1], window[0])
            grow_right = b < len(right) and not self._stable(window[-1], right[b])
            if not grow_left and not grow_right:
                return left[: len(left) - a] + window + right[b:]
            if grow_left:
                a = min(len(left), 2 * a)
            if grow_right:
                b = min(len(right), 2 * b)
            window = self._leaf(b"".join(left[len(left) - a :]) + b"".join(right[:b]))

    def _halves(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF_BYTES:
            return self._leaf(data)
        half = len(data) // 2
        if len(data) > LONG_LEAF:  # a power of two: in long runs of one character most tokens' lengths divide it
            half = 1 << ((len(data) - 1).bit_length() - 1)
        left = self.encode_bytes(data[:half])
        if len(data) > LONG_PIECE and len(left) > CARRIED:
            # The second half begins where a token does, so that a run out of step with the halves is in step again.
            left = left[:-CARRIED]
            half = sum(map(len, left))
        return self.join(left, self.encode_bytes(data[half:]))

    def encode_bytes(self, data: bytes) -> list[bytes]:
        """Tokens of one piece, by halves."""
        if len(data) <= 2 * LEAF_BYTES:
            return self._short[data]
        return [data] if data in self.ranks else self._halves(data)

    # -- texts --------------------------------------------------------------------------------

    def part_text(self, part: str) -> str:
        """Ids of a part of a text. Parts of several pieces are put together from their pieces."""
        if not (part[0] == " " and part[1:].isalpha()):
            pieces = self.find(part)
            if len(pieces) > 1:
                return " ".join([self._texts[p] for p in pieces])
        return " ".join([self._text[t] for t in self.encode_bytes(part.encode())])

    def ids_text(self, text: str) -> str:
        """Ids of a text in decimal, joined by one space."""
        if not text:
            return ""
        if text[-1] == " " or _UNSAFE(text):
            pieces = self.find(text)
        else:
            head, *rest = text.split(" ")
            pieces = [" " + x for x in rest]
            if head:
                pieces.insert(0, head)
        return " ".join(map(self._texts.__getitem__, pieces))

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.ids_text(text or "").split()]

    def decode_text(self, ids: str) -> bytes:
        """The bytes of ids in decimal."""
        return self._joined(list(map(self._token.__getitem__, ids.split())))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        return self._joined(list(map(self.tokens.__getitem__, ids)))

    def _joined(self, tokens: list[bytes]) -> bytes:
        """The product of tokens' bytes, up the tree."""
        if len(tokens) <= LEAF_TOKENS:
            return b"".join(tokens)
        half = len(tokens) // 2
        return self._joined(tokens[:half]) + self._joined(tokens[half:])


@cache
def load(path: str, pattern: str) -> Codec:
    """The codec of a rank file; once per worker."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def token_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Defined results: a null text counts as empty, an empty one has no tokens and the digest of
    nothing; repeated rows give repeated results; extra columns don't matter. path names a file
    that every executor has (the vocabulary is installed with the library that describes it).
    """

    def run(batches):
        codec = load(path, pattern)
        try:
            for b in batches:
                n, ids, back = [], [], []
                for text in b.column("text").to_pylist():
                    found = codec.ids_text(text or "")
                    n.append(found.count(" ") + 1 if found else 0)
                    ids.append(hashlib.sha256(found.encode()).hexdigest())
                    back.append(hashlib.sha256(codec.decode_text(found)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:
            codec.forget()

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs and a column of token ids (array of int) of text_col; a column that is named ids_col already is replaced."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = load(path, pattern)
        return texts.map(lambda t: codec.encode(t) if isinstance(t, str) else [])

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode_ids(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs and a column of the text whose token ids are in ids_col; a column that is named text_col already is replaced."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        codec = load(path, pattern)
        return ids.map(lambda x: codec.decode(list(x) if x is not None else []).decode("utf-8", "replace"))

    return docs.withColumn(text_col, text(F.col(ids_col)))
