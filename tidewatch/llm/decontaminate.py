"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max WAND.

The test items are the indexed side; each passage of each training document is a query. A term's
posting list is kept in blocks of item numbers with the greatest impact of each block; a passage's
items are found by WAND: terms ordered by their next item, the pivot is the first item whose terms'
greatest impacts can reach the threshold, and a pivot whose blocks' maxima can't reach it is skipped
together with its blocks. Before that, all passages of a batch at once are scored over each item's
most telling terms alone; a passage in which no item could reach the threshold, even with all its
other terms, is skipped whole. Every item whose score reaches the threshold is retrieved, not only the
best ones. The threshold is a share of the item's score with itself, so it doesn't depend on lengths.

Verification: the item's words are split into question (up to the last sentence) and answer (the
last sentence). A document contains the item if of the item's runs of RUN words at least OVERLAP
occur in the passages retrieved, and of the question's and the answer's word pairs at least
PART_OVERLAP; a part of fewer than PART_WORDS words is left to the runs, which reach into it.

Passages are PASSAGE words long and start every STEP words, so that anything of up to
PASSAGE - STEP words lies within one passage. Longer items are indexed as pieces of at most that
many words, each with its own score to reach; an item is retrieved if one of its pieces is. A
document that has half of an item's runs has half of some piece's, so length hides no item. The
whole item is verified, for several pieces on the passages retrieved and as many words as the item
has on both sides of them.

The index is built from blocks of some ITEMS items and WORDS words, each broadcast in turn and released before the
next: bounded memory for test sets of any size (a single item, however long, is in one block), and no item is left out; the documents
are scanned once for each block. Document frequencies come from all items. Pieces are numbered by the score they need, so
what WAND has left to look at always needs as much as the first of it, and one item of two words doesn't keep the others from being skipped.

Defined results: null and empty texts and items without words match nothing; items shorter than RUN
words have their whole word sequence as the one run; repeated rows of docs give repeated results,
those of items count once, and several texts of one item_id are items of their own; items without
item_id or text are left out; extra columns don't matter. remove_leaks judges each row by its own
text, whatever its id, so a null or repeated doc_id neither hides a leak nor takes a clean row along. Words are runs between separators, A-Z in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .words import Pieces, chunks, distinct, mix, ngrams

#: Words of a passage, and words from one passage's start to the next.
PASSAGE, STEP = 128, 64
#: Share of an item's own score that a passage must reach.
SHARE = 0.5
#: Words of a run, share of an item's runs, and of its question's and its answer's word pairs.
RUN, OVERLAP, PART_OVERLAP, PART_WORDS = 5, 0.5, 0.5, 4
#: Items and words of one broadcast index, on average; postings of a block.
ITEMS, WORDS, BLOCK = 10_000, 2_000_000, 64
K1, B = 1.2, 0.75

_U = np.uint64


@dataclass
class Index:
    """Inverted index of some items. Postings of term t: first[t]:first[t + 1] of item and impact; item is a piece's
    number, owner the item of each piece, several whether that has more. Runs and word pairs of item k: run_first[k]:run_first[k + 1]."""

    ids: np.ndarray
    owner: np.ndarray
    several: np.ndarray
    size: np.ndarray
    term: np.ndarray
    first: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    top: np.ndarray
    block_top: list[np.ndarray]
    need: np.ndarray
    key_first: np.ndarray
    key_item: np.ndarray
    key_impact: np.ndarray
    key_need: np.ndarray
    runs: np.ndarray
    run_first: np.ndarray
    words: np.ndarray
    word_first: np.ndarray
    word_part: np.ndarray

    def lists(self, t: int) -> slice:
        return slice(self.first[t], self.first[t + 1])


def _pairs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of words that start at some places."""
    return mix(h[at] * _U(3) + h[at + 1]).view(np.int64)


def build(ids: np.ndarray, texts: pa.Array, frequency: dict[int, int], n_items: int, mean_words: float) -> Index:
    """The index of some items; frequency: items in which a term is, over the whole test set."""
    items, terms, impacts, runs, words, owner, sizes = [], [], [], [], [], [], []
    for c in chunks(texts):
        w = Pieces(c, lower=True)
        n_pieces = np.maximum(1, -(-w.per_doc // (PASSAGE - STEP)))
        piece_words = np.maximum(1, -(-w.per_doc // n_pieces))
        first_piece = np.concatenate([[0], np.cumsum(n_pieces)]) + sum(map(len, owner))
        owner.append(np.repeat(np.arange(c.n) + c.row, n_pieces))
        sizes.append(w.per_doc)
        piece = first_piece[w.doc] + (np.arange(len(w.doc)) - w.first[w.doc]) // piece_words[w.doc]
        key = np.stack([piece, w.hash.view(np.int64)], 1) if len(w.hash) else np.zeros((0, 2), np.int64)
        pair, tf = np.unique(key, axis=0, return_counts=True)
        df = np.array([frequency[t] for t in pair[:, 1].tolist()], float)
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        length = np.bincount(piece, minlength=first_piece[-1])[pair[:, 0]] if len(piece) else np.zeros(0)
        impacts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_words, 1))))
        items.append(pair[:, 0])
        terms.append(pair[:, 1])
        # The last word that ends a sentence, apart from the item's last word, ends the question.
        stop = np.isin(c.buf[w.end - 1], [ord("."), ord("?"), ord("!")]) if len(w.end) else np.zeros(0, bool)
        place = np.arange(len(stop)) - w.first[w.doc] + 1
        inner = stop & (place < w.per_doc[w.doc])
        ends = np.zeros(c.n, np.int64)
        np.maximum.at(ends, w.doc[inner], place[inner])
        doc, h = distinct(*ngrams(w, RUN, short=True))
        runs.append(np.stack([doc + c.row, h.view(np.int64)], 1))
        answer = place > ends[w.doc]
        size = np.bincount(w.doc * 2 + answer, minlength=2 * c.n)
        at = np.flatnonzero((w.doc[:-1] == w.doc[1:]) & (answer[:-1] == answer[1:])) if len(w.doc) else np.zeros(0, np.int64)
        at = at[size[w.doc[at] * 2 + answer[at]] >= PART_WORDS]
        words.append(np.unique(np.stack([w.doc[at] + c.row, _pairs(w.hash, at), answer[at]], 1), axis=0))
    item, hashes, impact, owner = np.concatenate(items), np.concatenate(terms), np.concatenate(impacts), np.concatenate(owner)
    own = np.bincount(item, impact, len(owner))
    by_need = np.argsort(own, kind="stable")
    number = np.empty(len(owner), np.int64)
    number[by_need] = np.arange(len(owner))
    item, owner, own = number[item], owner[by_need], own[by_need]
    order = np.lexsort((item, hashes))
    item, hashes, impact = item[order], hashes[order], impact[order]
    term, first = np.unique(hashes, return_index=True)
    first = np.append(first, len(hashes))
    block_top = [np.maximum.reduceat(impact[a:b], np.arange(0, b - a, BLOCK)) for a, b in zip(first[:-1], first[1:])]
    run, word = np.concatenate(runs), np.concatenate(words)
    top = np.array([b.max() for b in block_top]) if len(block_top) else np.zeros(0)
    # An item's telling terms: its greatest impacts, until the others add up to half of what is needed at most.
    by_item = np.lexsort((-impact, item))
    total = np.cumsum(impact[by_item])
    start = np.searchsorted(item[by_item], item[by_item])
    before = total - impact[by_item] - np.where(start > 0, total[start - 1], 0)
    key = np.zeros(len(item), bool)
    key[by_item] = before < (1 - SHARE / 2) * own[item[by_item]]
    rest = own - np.bincount(item[key], impact[key], len(owner))
    key_first = np.concatenate([[0], np.cumsum(key)])[first]
    at = np.arange(len(ids) + 1)
    return Index(
        np.asarray(ids), owner, (np.bincount(owner) > 1)[owner], np.concatenate(sizes), term, first, item, impact, top, block_top, SHARE * own,
        key_first, item[key], impact[key], SHARE * own - rest - 1e-9, run[:, 1], np.searchsorted(run[:, 0], at), word[:, 1], np.searchsorted(word[:, 0], at), word[:, 2]
    )


def wand(index: Index, terms: list[int]) -> list[int]:
    """Pieces whose BM25 score for the distinct terms reaches what they need."""
    lists = [[index.item[index.lists(t)], index.impact[index.lists(t)], 0, t] for t in terms]
    out = []
    while lists:
        lists.sort(key=lambda x: x[0][x[2]])
        least, bound, pivot = index.need[lists[0][0][lists[0][2]]], 0.0, None  # needs never fall from here on
        for i, x in enumerate(lists):
            bound += index.top[x[3]]
            if bound >= least:
                pivot = i
                break
        if pivot is None:
            break
        doc = lists[pivot][0][lists[pivot][2]]
        while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == doc:
            pivot += 1
        here, limit, after = lists[: pivot + 1], 0.0, len(index.owner)
        for items, _, at, t in here:
            j = at + int(np.searchsorted(items[at:], doc))
            if j < len(items):
                limit += index.block_top[t][j // BLOCK]
                end = min((j // BLOCK + 1) * BLOCK, len(items))
                after = min(after, int(items[end - 1]) + 1)
        if pivot + 1 < len(lists):
            after = min(after, int(lists[pivot + 1][0][lists[pivot + 1][2]]))
        if limit < index.need[doc]:
            target = max(after, doc + 1)  # no item up to the blocks' ends can reach the threshold
        else:
            score = 0.0
            for items, impact, at, _ in here:
                j = at + int(np.searchsorted(items[at:], doc))
                if j < len(items) and items[j] == doc:
                    score += impact[j]
            if score >= index.need[doc]:
                out.append(int(doc))
            target = doc + 1
        for x in here:
            x[2] += int(np.searchsorted(x[0][x[2] :], target))
        lists = [x for x in lists if x[2] < len(x[0])]
    return out


def _frequency(items: DataFrame) -> DataFrame:
    """(term, n): items that have the term; term null: items and words in all."""

    def run(batches):
        for b in batches:
            for c in chunks(b.column("text")):
                w = Pieces(c, lower=True)
                pair = np.unique(np.stack([w.doc, w.hash.view(np.int64)], 1), axis=0) if len(w.hash) else np.zeros((0, 2), np.int64)
                term, n = np.unique(pair[:, 1], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(term, 0), mask=np.append(np.zeros(len(term), bool), True)), pa.array(np.append(n, int((w.per_doc > 0).sum()))), pa.array(np.append(np.zeros(len(term), np.int64), len(w.hash)))],
                    ["term", "n", "words"],
                )

    part = items.select("text").mapInArrow(run, "term long, n long, words long")
    return part.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def _indexes(items: DataFrame, frequency: DataFrame):
    """Index of each block of items, one at a time."""
    spark = items.sparkSession
    total = frequency.filter("term is null").first()
    n, words = (total["n"], total["words"]) if total else (0, 0)
    parts = max(1, -(-n // ITEMS), -(-words // WORDS))
    for part in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = own.select("item_id", "text").toArrow()
        if not len(rows):
            continue
        w = [Pieces(c, lower=True).hash.view(np.int64) for c in chunks(rows.column("text"))]
        need = np.unique(np.concatenate(w)) if w else np.zeros(0, np.int64)
        if parts == 1:
            df = {r["term"]: r["n"] for r in frequency.filter("term is not null").collect()}
        else:
            asked = spark.createDataFrame([(int(t),) for t in need], "term long")
            df = {r["term"]: r["n"] for r in frequency.join(asked, "term").collect()}
        if len(need):
            ids = rows.column("item_id").combine_chunks().to_numpy(zero_copy_only=False)
            yield build(ids, rows.column("text").combine_chunks(), df, n, words / max(n, 1))


def _passage_terms(index: Index, w: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(word number, term number) of the words that the index has."""
    if not len(index.term) or not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = w.hash.view(np.int64)
    at = np.searchsorted(index.term, h)
    at[at == len(index.term)] = 0
    has = np.flatnonzero(index.term[at] == h)
    return has, at[has]


def _matches(index: Index, w: Pieces) -> list[tuple[int, int, float, float, float]]:
    """(document, item, overlap, question overlap, answer overlap) of verified items."""
    word, term = _passage_terms(index, w)
    doc = w.doc[word]
    place = word - w.first[doc]
    found: dict[tuple[int, int], set[tuple[int, int]]] = {}
    # Upper bounds of all passages at once: each word counts for the passages it lies in.
    last = np.maximum(0, -(-(w.per_doc - PASSAGE) // STEP))  # number of the last passage of each document
    offset = np.concatenate([[0], np.cumsum(last + 1)])
    keys, terms = [], []
    for back in range(-(-PASSAGE // STEP)):
        p = place // STEP - back
        ok = (p >= 0) & (p <= last[doc]) & (place < p * STEP + PASSAGE)
        keys.append(offset[doc[ok]] + p[ok])
        terms.append(term[ok])
    key, term2 = np.concatenate(keys), np.concatenate(terms)
    if not len(key):
        return []
    width = len(index.term)
    pair = np.unique(key * width + term2)
    key, term2 = pair // width, pair % width
    count = index.key_first[term2 + 1] - index.key_first[term2]
    post = np.repeat(index.key_first[term2] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    cell, where = np.unique(np.repeat(key, count) * len(index.owner) + index.key_item[post], return_inverse=True)
    reached = np.bincount(where, index.key_impact[post]) >= index.key_need[cell % len(index.owner)]
    edge = np.searchsorted(key, np.arange(offset[-1] + 1))
    for k in np.unique(cell[reached] // len(index.owner)):
        d = int(np.searchsorted(offset, k, "right")) - 1
        begin = (k - offset[d]) * STEP
        for piece in wand(index, term2[edge[k] : edge[k + 1]].tolist()):
            item = int(index.owner[piece])
            around = int(index.size[item]) if index.several[piece] else 0
            found.setdefault((d, item), set()).add((max(0, int(begin) - around), int(min(begin + PASSAGE + around, w.per_doc[d]))))
    out = []
    for (d, item), spans in found.items():
        own = np.zeros(w.per_doc[d], bool)
        for a, b in spans:
            own[a:b] = True
        own_words = w.hash[w.first[d] : w.first[d + 1]]
        mine = slice(index.run_first[item], index.run_first[item + 1])
        total = np.isin(index.runs[mine], _runs(own_words, own)).mean()
        theirs = slice(index.word_first[item], index.word_first[item + 1])
        there = np.isin(index.words[theirs], _pairs(own_words, np.flatnonzero(own[:-1] & own[1:])))
        answer = index.word_part[theirs] == 1
        share = [there[k].mean() if k.any() else 1.0 for k in (~answer, answer)]
        if total >= OVERLAP and min(share) >= PART_OVERLAP:
            out.append((d, item, float(total), float(share[0]), float(share[1])))
    return out


class _Words:
    """The words of one document, as far as ngrams() needs them."""

    def __init__(self, h: np.ndarray, doc: np.ndarray):
        self.hash, self.doc = h, doc
        self.per_doc = np.bincount(doc) if len(doc) else np.zeros(1, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.per_doc)])


def _runs(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hashes of the runs within the marked words; shorter ones as well, for items shorter than RUN."""
    group = np.cumsum(np.diff(own.astype(np.int8), prepend=0) == 1)[own] - 1
    w = words[own]
    got = [ngrams(_Words(w, group), RUN)[1]]
    for n in range(1, RUN):
        if len(w) >= n:
            at = np.flatnonzero(group[: len(w) - n + 1] == group[n - 1 :])
            flat = np.concatenate([w[at + j] for j in range(n)]).reshape(n, -1).T.reshape(-1)
            got.append(ngrams(_Words(flat, np.repeat(np.arange(len(at)), n)), RUN, short=True)[1])
    return np.concatenate(got).view(np.int64)


def _usable(items: DataFrame) -> DataFrame:
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.filter("text is not null and item_id is not null").distinct()


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, overlap, question_overlap, answer_overlap) of every document and item that it contains."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _usable(items)
    schema = "doc_id long, item_id long, overlap double, question_overlap double, answer_overlap double"
    out, last = None, None
    for index in _indexes(items, _frequency(items)):
        if last is not None:  # there are several: one is held at a time
            out, last = _appended(out, *last), None
        shared = sc.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                for c in chunks(b.column("text")):
                    got = _matches(index, Pieces(c, lower=True))
                    ids = b.column("doc_id")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[c.row + g[0]].as_py() for g in got], pa.int64()),
                            pa.array([int(index.ids[g[1]]) for g in got], pa.int64()),
                            *[pa.array([g[k] for g in got], pa.float64()) for k in (2, 3, 4)],
                        ],
                        ["doc_id", "item_id", "overlap", "question_overlap", "answer_overlap"],
                    )

        last = source.mapInArrow(run, schema), shared
    if last is None:
        return docs.sparkSession.createDataFrame([], schema)
    return last[0] if out is None else _appended(out, *last)


def _appended(out: DataFrame | None, part: DataFrame, shared) -> DataFrame:
    part = table(part, "matches")
    shared.unpersist()
    return part if out is None else out.union(part)


def _clean(shared):
    """Whether a text contains no item of a broadcast index."""

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        out = np.ones(len(text), bool)
        for c in chunks(text):
            for g in _matches(shared.value, Pieces(c, lower=True)):
                out[c.row + g[0]] = False
        return pa.array(out)

    return clean


def remove_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that contain an item; columns as they were. Rows are judged in place, none is shuffled."""
    sc, last = docs.sparkSession.sparkContext, None
    items = _usable(items)
    for index in _indexes(items, _frequency(items)):
        if last is not None:  # there are several: one is held at a time
            docs = table(docs, "unleaked")
            last.unpersist()
        last = sc.broadcast(index)
        docs = docs.filter(_clean(last)(F.col("text").cast("string")))
    return docs
