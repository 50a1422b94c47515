"""Exact similarity self-join of documents on sets of word shingles.

Method. Two sets with Jaccard similarity of at least t differ in at most H tokens,
where H follows from the smaller size. Sizes fall into bands; a band's join hashes the
token universe into m = H + 1 + slack segments, so that two similar sets agree on at least
1 + slack of them (pigeonhole). A segment's subset is indexed by one 64-bit signature.
Allocation by cost: a set may leave out as many segments as there is slack, and leaves out
those that cost most, the empty ones (they agree with everything) and those whose posting
list is long. Sets for which slack doesn't suffice also index the one-deletion neighbourhoods
of their segments, which makes a segment worth two; a pair is found if the allocation of
either of its sets finds it. Candidates are verified exactly on whole shingle sets.

Work is done on classes (sets of equal shingles): texts are read once for sets and signatures, and
one row of each class goes on, so copies are neither paired nor posted. Posting lists
give pairs with one centre each; pairs of a list that are still in different components
afterwards are compared by parity sketches in blocks of bounded size, and only those that the
sketches can't rule out are verified. The links' components are those of the full link graph.
Lists' lengths and centres come from partial sums that a join brings back, and blocks are numbered
in range partitions, so no list of any length is one task's work.

Defined results: null or empty texts and texts of separators only have no shingles, link with
nothing and are their own component; with fewer words than shingle_words the whole word
sequence is the one shingle; rows with equal id count as one document (the texts' sets are
both kept, and their components merge); a null id is a document of its own with a null
component; extra columns don't matter. Equality of tokens is equality of 64-bit hashes. Rows are
told apart by a key of id and text, so ids that are null or repeated hide no class.
keep_one judges rows rather than ids: of a group's rows the one with the smallest (id, key) stays,
of rows alike in id and text one stays, and rows of one id whose texts aren't near copies all stay;
rows without an id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import forget, placed, small_batches, table
from .words import Pieces, chunks, distinct, mix, ngrams, signed

#: A posting list of more classes than this is costly.
COSTLY = 64
#: Classes compared with each other in one group, at most twice this.
BLOCK = 512
#: Clusters of overlapping lists up to this many classes are compared as one list; larger ones list by list.
CLUSTER = 16_384
#: Parts of the signatures that are grouped one after the other, so that shuffles hold one part's entries at a time.
PASSES = 3
#: Members verified against one centre by one task.
CENTRE_ROWS = 4096

_U = np.uint64


class Plan:
    """Bands and segments for a threshold of percent / 100."""

    def __init__(self, percent: int):
        if not 34 <= percent <= 100:
            raise ValueError("percent must be from 34 to 100")
        self.percent = percent
        ratio = max(1.5, 130 / percent)
        low, self.low, self.high = 1, [], []
        while low < 1 << 34:
            high = max(low, int(low * ratio))
            self.low.append(low)
            self.high.append(high)
            low = high + 1
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.differ = self.high * (100 - percent) // percent
        # Room for the empty segments that the band's smallest sets have to expect.
        few = np.exp(-self.low / np.maximum(1, 1.15 * (self.differ + 1))) * (self.differ + 1)
        self.slack = 2 + np.ceil((self.differ + 1) / 50 + few + 2 * np.sqrt(few)).astype(np.int64)
        self.m = np.where(self.differ > 0, self.differ + 1 + self.slack, 0)
        self.reach = self.high * 100 // percent  # the largest partner

    def bands(self, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which sets, band): the bands whose join each set takes part in."""
        own = np.searchsorted(self.high, size)
        for back in range(0, 4):
            band = own - back
            take = (size > 0) & (band >= 0)
            band = np.maximum(band, 0)
            take &= (size <= self.reach[band]) & (self.m[band] > 0)
            if take.any():
                yield np.flatnonzero(take), band[take]


def _sets(col: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents: first row, count, token document, token hash, set sizes, class of each."""
    for c in chunks(col):
        doc, h = distinct(*ngrams(Pieces(c, lower=True), words, short=True))
        size = np.bincount(doc, minlength=c.n)
        total = np.zeros(c.n, _U)
        np.add.at(total, doc, mix(h ^ _U(0x5851F42D4C957F2D)))
        yield c.row, c.n, doc, h, size, mix(total + size.astype(_U))


def _entries(plan: Plan, n: int, doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, signature, band, free) of the index entries of a run's sets, by document. free: how many more segments it may leave out."""
    out = []
    for which, band in plan.bands(size):
        pick = np.zeros(n, np.int64) - 1
        pick[which] = np.arange(len(which))
        tok = np.flatnonzero(pick[doc] >= 0)
        owner = pick[doc[tok]]
        m = plan.m[band]
        cell0 = np.concatenate([[0], np.cumsum(m)])
        value = mix(h[tok] ^ _U(0xC2B2AE3D27D4EB4F))
        cell = cell0[owner] + (mix(h[tok] + _U(0x165667B19E3779F9)) % m[owner].astype(_U)).astype(np.int64)
        count = np.bincount(cell, minlength=cell0[-1])
        total = np.zeros(cell0[-1], _U)
        np.add.at(total, cell, value)
        cell_set = np.repeat(np.arange(len(which)), m)
        salt = mix(band[cell_set].astype(_U) * _U(0x100000001B3) + (np.arange(cell0[-1]) - cell0[cell_set]).astype(_U))
        empty = np.bincount(cell_set, weights=count == 0, minlength=len(which)).astype(np.int64)
        free = plan.slack[band] - empty
        found = [(mix(total + salt), cell_set, count > 0)]
        if (free < 0).any():
            short = free < 0
            two = np.bincount(cell_set, weights=count > 1, minlength=len(which))
            hard = short & (two < -free)
            found.append((mix(total + salt), cell_set, (count == 0) & hard[cell_set]))
            dels = short[owner] & ((count[cell] > 1) | hard[owner])
            found.append((mix(total[cell] - value + salt[cell]), owner, dels))
        own = np.concatenate([o[k] for _, o, k in found])
        out.append((which[own], np.concatenate([x[k] for x, _, k in found]), band[own], np.clip(free[own], -1, 32767)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, _U, np.int64, np.int64))
    owner, *rest = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(owner, kind="stable")
    return (owner[order], *(x[order] for x in rest))


CLASSES = "id long, key long, set_class long, n_shingles long, sketch binary, entries array<struct<sig: long, band: short, free: short>>"


def classes(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, set_class, n_shingles, sketch, entries) of every row; set_class is null without shingles.

    sketch: parities of the tokens' counts in 1024 buckets, or in four times the set's size rounded
    up to a power of two. entries: the index entries of the set.
    """

    def run(batches):
        plan = Plan(percent)
        for b in batches:
            for row, n, doc, h, size, cls in _sets(b.column("text"), words):
                wide = 1 << np.maximum(10, np.ceil(np.log2(np.maximum(4 * size, 1)))).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(wide // 8)])
                bit = (mix(h + _U(0x27D4EB2F165667C5)) & (wide[doc] - 1).astype(_U)).astype(np.int64)
                sketch = np.zeros(edge[-1], np.uint8)
                np.bitwise_xor.at(sketch, edge[doc] + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
                sketch = pa.Array.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(sketch)]
                )
                owner, sig, band, free = _entries(plan, n, doc, h, size)
                entries = pa.StructArray.from_arrays(
                    [pa.array(signed(sig)), pa.array(band.astype(np.int16)), pa.array(free.astype(np.int16))], ["sig", "band", "free"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").slice(row, n),
                        b.column("key").slice(row, n),
                        pa.array(signed(cls), mask=size == 0),
                        pa.array(size, pa.int64()),
                        sketch.cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), entries),
                    ],
                    ["id", "key", "set_class", "n_shingles", "sketch", "entries"],
                )

    small_batches(docs.sparkSession)
    return _source(docs, id_col, text_col).mapInArrow(run, CLASSES)


def _lists(rows: DataFrame) -> DataFrame:
    """rows (sig, cls, ...) of signatures of two classes or more, with k, their number, and centre, the smallest of them."""
    lists = rows.groupBy("sig").agg(F.count("*").alias("k"), F.min("cls").alias("centre"), F.max("cls").alias("last"))
    return rows.join(lists.filter("centre < last").drop("last"), "sig")


def _postings(first: DataFrame) -> DataFrame:
    """(sig, cls, centre, k): lists of two classes or more, after the allocation by cost."""
    entries = first.select("cls", F.inline("entries"))
    parts = [table(_lists(entries.filter(F.pmod("sig", F.lit(PASSES)) == k)), "postings") for k in range(PASSES)]
    listed = reduce(DataFrame.union, parts)
    light = listed.filter(F.col("k") <= COSTLY).select("sig", "cls", "centre", "k")
    heavy = listed.filter(F.col("k") > COSTLY).drop("k", "centre").distinct()
    costly = heavy.groupBy("cls", "band").agg(F.count("*").alias("h"))
    kept = table(heavy.join(costly, ["cls", "band"]).filter("h > free").select("sig", "cls"), "heavy")
    lists = table(light.union(_lists(kept).select("sig", "cls", "centre", "k")), "lists")
    for used in (*parts, kept):
        forget(used)
    return lists


def _members(col: pa.Array, words: int) -> Iterator[np.ndarray]:
    for _, n, doc, h, size, _ in _sets(col, words):
        edge = np.concatenate([[0], np.cumsum(size)])
        for i in range(n):
            yield h[edge[i] : edge[i + 1]]


def _verify_centres(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(src, dst) of the pairs (centre, cls) that link. Streams a centre's members past it; hot centres are dealt to many tasks."""
    n = pairs.groupBy("centre").agg(F.ceil(F.count("*") / CENTRE_ROWS).cast("int").alias("parts"))
    heads = n.join(texts, n.centre == texts.cls).select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("cls"), "text"
    )
    rows = (
        pairs.join(n, "centre")
        .join(texts, "cls")
        .select("centre", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), "cls", "text")
    )

    def run(batches):
        centre, base = None, None
        for b in batches:
            src, dst = [], []
            at, cls = b.column("centre").to_pylist(), b.column("cls").to_pylist()
            for i, own in enumerate(_members(b.column("text"), words)):
                if cls[i] is None:
                    centre, base = at[i], own
                elif centre != at[i]:
                    raise RuntimeError(f"the text of class {at[i]} is missing")
                else:
                    x, y = (base, own) if len(base) <= len(own) else (own, base)
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        src.append(centre)
                        dst.append(cls[i])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return (
        heads.union(rows)
        .repartition("centre", "part")
        .sortWithinPartitions("centre", "part", F.col("cls").asc_nulls_first())
        .select("centre", "cls", "text")
        .mapInArrow(run, "src long, dst long")
    )


def may_link(bits: np.ndarray, size: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of different labels that sizes and parity sketches (0/1 rows) don't rule out.

    Every token that only one set has flips one bit, so sketches differ in at most as many bits
    as the sets differ in tokens.
    """
    same = np.zeros((len(bits), len(bits)), np.float32)
    for at in range(0, bits.shape[1], 8192):  # long sketches, a part at a time
        sign = 1 - 2 * bits[:, at : at + 8192].astype(np.float32)
        same += sign @ sign.T
    differ = (bits.shape[1] - same) / 2
    both = size[:, None] + size[None, :]
    ok = differ * (100 + percent) <= (100 - percent) * both
    ok &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    ok &= label[:, None] != label[None, :]
    return np.nonzero(np.triu(ok, 1))


def _fold(sketch: bytes, width: int) -> int:
    out = 0
    for at in range(0, len(sketch), width):
        out ^= int.from_bytes(sketch[at : at + width], "little")
    return out


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (centre, cls) that sizes and sketches don't rule out; texts move for these alone."""
    other = sketches.select(F.col("cls").alias("centre"), F.col("size").alias("size2"), F.col("sketch").alias("sketch2"))
    rows = pairs.join(sketches, "cls").join(other, "centre").filter(
        100 * F.least("size", "size2") >= percent * F.greatest("size", "size2")
    )

    def run(batches):
        for b in batches:
            keep = []
            for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("sketch", "sketch2", "size", "size2"))):
                width = min(len(x), len(y))
                differ = (_fold(x, width) ^ _fold(y, width)).bit_count()
                keep.append(differ * (100 + percent) <= (100 - percent) * (n + m))
            yield b.select(["centre", "cls"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("centre", "cls", "size", "size2", "sketch", "sketch2").mapInArrow(run, "centre long, cls long")


def _clusters(lists: DataFrame) -> DataFrame:
    """(list, cls, label): overlapping lists (sig, cls, label) put together, as far as that stays within CLUSTER classes."""
    low = lists.groupBy("sig").agg(F.min("label").alias("lo"))
    edges = lists.join(low, "sig").filter("label <> lo").select(F.col("label").alias("src"), F.col("lo").alias("dst")).distinct()
    cluster = components(edges).withColumnRenamed("label", "cluster")
    members = lists.select("cls", "label").distinct().join(cluster, lists.label == cluster.node).select("cluster", "cls", "label")
    members = table(members, "clusters")
    large = members.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > CLUSTER).select("cluster")
    small = members.join(large, "cluster", "left_anti").select(F.col("cluster").alias("list"), "cls", "label")
    rest = lists.join(members.join(large, "cluster").select("cls"), "cls", "left_semi").select(F.xxhash64("sig", F.lit("list")).alias("list"), "cls", "label")
    return small.union(rest)


def _propose(lists: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(centre, cls): pairs within lists (list, cls, label) that may link, from blocks of bounded size."""
    rows = placed(lists, "list", "label", "cls").withColumn("block", F.floor(F.col("place") / BLOCK).cast("int")).drop("place")
    rows = table(rows, "blocks")
    blocks = rows.groupBy("list", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    other = blocks.select("list", F.col("block").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = blocks.join(other, "list").filter(
        (F.col("block") <= F.col("j"))
        & ((F.col("lo") != F.col("hi")) | (F.col("lo2") != F.col("hi2")) | (F.col("lo") != F.col("lo2")))
    )
    to = pairs.select("list", F.col("block").alias("i"), "j", F.explode(F.array_distinct(F.array("block", "j"))).alias("block"))
    grouped = rows.join(to, ["list", "block"]).join(sketches, "cls").select("list", "i", "j", "block", "cls", "label", "size", "sketch")

    def run(key, data):
        cls, label, size = (data.column(c).to_numpy() for c in ("cls", "label", "size"))
        raw = data.column("sketch").to_pylist()
        width = min(map(len, raw))
        bits = np.empty((len(raw), width), np.uint8)
        for k, x in enumerate(raw):
            bits[k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), 0)
        i, j = may_link(np.unpackbits(bits, axis=1), size, label, percent)
        if key[1] != key[2]:  # pairs inside a block come from that block's own group
            block = data.column("block").to_numpy()
            across = block[i] != block[j]
            i, j = i[across], j[across]
        return pa.table({"centre": np.minimum(cls[i], cls[j]), "cls": np.maximum(cls[i], cls[j])})

    return grouped.groupBy("list", "i", "j").applyInArrow(run, "centre long, cls long").distinct()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key) of every row: key is the same only for rows of the same id (or none) and text."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(id_.alias("id"), text.alias("text"), F.xxhash64(id_.isNull(), id_, text).alias("key"))


def _known(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, key, set_class, n_shingles) of every row; (cls, key, size, sketch, entries) of every class."""
    found = table(classes(docs, words, percent, id_col, text_col), "classes")
    rows = table(found.select("id", "key", "set_class", "n_shingles"), "rows")
    first = found.filter("set_class is not null").select(F.col("set_class").alias("cls"), "key", F.col("n_shingles").alias("size"), "sketch", "entries")
    first = table(first.dropDuplicates(["cls"]), "first")
    forget(found)
    return rows, first


def class_links(
    docs: DataFrame, known: DataFrame, first: DataFrame, words: int, percent: int, id_col: str, text_col: str, merge_ids: bool = True
) -> DataFrame:
    """(node, label): components of classes that link with another class, or (merge_ids) have an id in common. first is used up."""
    source = _source(docs, id_col, text_col).select("key", "text")
    lists = _postings(first)
    pairs = lists.filter("centre <> cls").select("centre", "cls").distinct()
    needed = lists.select("cls").distinct()  # centres are members as well
    whole, first = first, table(first.drop("entries").join(needed, "cls"), "needed")
    forget(whole)
    sketches = first.select("cls", "size", "sketch")

    def verified(plausible: DataFrame) -> DataFrame:
        plausible = table(plausible, "pairs")
        asked = plausible.select("cls").union(plausible.select(F.col("centre").alias("cls"))).distinct()
        # Rows of one key have equal texts: one of them does.
        texts = first.join(asked, "cls").select("key", "cls").join(source, "key").select("cls", "text").dropDuplicates(["cls"])
        return table(_verify_centres(plausible, table(texts, "texts"), words, percent), "links")

    links = verified(_plausible(pairs, sketches, percent))
    now = table(components(links), "labels")

    open_ = lists.filter("k > 2").select("sig", "cls").distinct()
    open_ = open_.join(now, open_.cls == now.node, "left").select("sig", "cls", F.coalesce("label", "cls").alias("label"))
    per_sig = open_.groupBy("sig").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s"), F.min("label").alias("lo"), F.max("label").alias("hi")
    ).filter("n > 2 and lo <> hi")
    once = per_sig.groupBy("n", "s").agg(F.min("sig").alias("sig")).select("sig")
    left = table(open_.join(once, "sig"), "open")
    proposed = _propose(_clusters(left), sketches, percent)
    links = links.union(verified(proposed.join(pairs, ["centre", "cls"], "left_anti")))
    if not merge_ids:
        return components(links)
    low = known.filter("id is not null and set_class is not null").groupBy("id").agg(F.min("set_class").alias("dst"), F.max("set_class").alias("top"))
    same_id = known.join(low.filter("dst <> top"), "id").filter("set_class <> dst").select(F.col("set_class").alias("src"), "dst").distinct()
    return components(links.union(same_id))


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, set_class, component_id (the smallest id it links to, over any number of links)."""
    known, first = _known(docs, shingle_words, percent, id_col, text_col)
    labels = class_links(docs, known, first, shingle_words, percent, id_col, text_col)
    named = known.join(labels, known.set_class == labels.node, "left").select(
        "id", "n_shingles", "set_class", F.coalesce("label", "set_class").alias("component")
    )
    low = named.filter("component is not null").groupBy("component").agg(F.min("id").alias("first_id"))
    return named.join(low, "component", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", "set_class", F.coalesce("first_id", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row (smallest doc_id) of each group of near copies; columns as they were."""
    known, first = _known(docs, shingle_words, percent)
    labels = class_links(docs, known, first, shingle_words, percent, "doc_id", "text", merge_ids=False)
    rows = known.filter("id is not null").select("id", "key", "set_class")
    named = rows.join(labels, rows.set_class == labels.node, "left").select("id", "key", F.coalesce("label", "set_class").alias("component"))
    low = named.filter("component is not null").groupBy("component").agg(F.min(F.struct("id", "key")).alias("low"))
    gone = named.join(low, "component").filter(F.col("key") != F.col("low.key")).select(F.col("key").alias("mark"), F.lit(True).alias("gone"))
    alike = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("mark"))
    alike = alike.join(gone, "mark", "left_anti").select("mark", F.lit(False).alias("gone"))
    marks = table(gone.distinct().union(alike), "marks")
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]  # they travel in one column, whatever their names
    rest = docs.select(F.struct(*columns).alias("row"), F.xxhash64(id_.isNull(), id_, text).alias("key"))
    rest = rest.join(marks, rest["key"] == marks["mark"], "left").filter("gone is null or not gone").select("row", "key", "gone")
    if marks.filter("not gone").isEmpty():
        return rest.select("row.*")
    rest = table(rest, "kept")
    one = rest.filter("gone is not null").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
    return rest.filter("gone is null").select("row.*").union(one)
