"""Quality rules with adaptive thresholds.

Every document gets its measures: symbols for each character in words, repeated lines for each line and words in repeats for
each word, as shares of what exceeds a chance event (a few symbols, one repeated line, one repeated window count for nothing, so a text
without junk has 0 at any length), and characters for each word, as a logarithm. Mergeable quantile sketches
(Spark's percentile_approx, which sums up parts of a group before the shuffle and merges them after
it) give each language and source, each language, and the whole table their lower and upper
quartile. A group's quartiles are joined with the wider ones, which count as WIDER rows: a small
group leans on its language, and a language on the whole, while a large group stands by itself. Limits are
the outer fences, SPREAD times the distance of the quartiles beyond them. The distance counts as a least one at least:
in a group in which most texts have none of a kind of junk, or nearly the same, that decides. Up to
a quarter of a group can be junk without moving its limit there. The upper fence
holds for all measures; the lower one for characters for each word only, since few symbols and few repeats are no fault while short words
are. A join brings the limits to the documents, and a document is kept if it breaks none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .words import Chunk, Pieces, byte_table, chunks, ngrams, segment_hash

#: Quartiles that the sketches are asked for.
LOW, HIGH = 0.25, 0.75
#: Fences: this many times the distance of the quartiles beyond them; rows that a wider group's quartiles count as.
SPREAD, WIDER = 3.0, 20.0
#: Accuracy of the sketches: error of a rank is 1 / ACCURACY.
ACCURACY = 10_000
#: Rounding errors that don't break a limit.
SLACK = 1e-9
#: Count, total, what of the count is chance, the least distance of the quartiles, and whether the lower fence holds.
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 2, 0.005, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1, 0.05, False),
    "repeat_rate": ("n_repeat_words", "n_words", 6, 0.05, False),
    "word_length": ("word_chars", "n_words", None, 0.05, True),
}

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the same (doc, hash) is there at least twice."""
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _measure(c: Chunk) -> list[np.ndarray]:
    w = Pieces(c)
    start_of_char = (c.buf & 0xC0) != 0x80
    cum = np.concatenate([[0], np.cumsum(start_of_char)])
    sep = np.concatenate([[0], np.cumsum(np.isin(c.buf, [0x20, 9, 10, 11, 12, 13]))])
    chars = np.diff(cum[c.offsets]) - np.diff(sep[c.offsets])
    sym = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[c.buf])])[c.offsets])

    # Lines start at documents' starts and after each \n; only those with a word count.
    after = np.flatnonzero(c.buf == 10) + 1
    line = np.unique(np.concatenate([c.offsets[:-1][np.diff(c.offsets) > 0], after[after < len(c.buf)]]))
    line_doc = np.searchsorted(c.offsets, line, "right") - 1
    newline_free = byte_table().copy()
    newline_free[10] = 0
    h = segment_hash(c.buf, line, newline_free)
    with_word = np.zeros(len(line), bool)
    if len(w.start):
        with_word[np.searchsorted(line, w.start, "right") - 1] = True
    line_doc, h = line_doc[with_word], h[with_word]
    order = np.lexsort((h, line_doc))
    dup = (line_doc[order][1:] == line_doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    n_dup = np.bincount(line_doc[order][1:][dup], minlength=c.n)
    n_lines = np.bincount(line_doc, minlength=c.n)

    covered = np.zeros(len(w.hash) + 2, bool)
    if len(w.hash) >= 3:
        first = np.flatnonzero(w.doc[: len(w.hash) - 2] == w.doc[2:])
        doc, g = ngrams(w, 3)
        again = first[_repeats(doc, g)]
        for j in range(3):
            covered[again + j] = True
    n_rep = np.bincount(w.doc[covered[: len(w.hash)]], minlength=c.n)
    return [w.per_doc, chars, sym, n_lines, n_dup, n_rep]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of every row; a null text counts as one without words."""

    def run(batches):
        for b in batches:
            for c in chunks(b.column("text")):
                keys = [b.column(k).slice(c.row, c.n) for k in ("doc_id", "lang", "source")]
                found = [pa.array(x.astype(np.int64)) for x in _measure(c)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *found],
                    ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return source.mapInArrow(run, f"doc_id long, lang string, source string, {MEASURES}")


def _rates(found: DataFrame) -> DataFrame:
    def rate(count: str, total: str, chance: int | None):
        if chance is None:
            return F.log((F.col(count) + 0.5) / (F.col(total) + 1.0))
        return F.greatest(F.col(count) - chance, F.lit(0)) / (F.col(total) + 1.0)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumns({k: rate(*r[:3]) for k, r in RATES.items()} | {"base_failed": failed})


def _sketches(found: DataFrame, *group: str) -> DataFrame:
    """A row for each group: n, and the quartiles of each rate, over rows that pass the fixed rules."""
    passing = lambda k: F.when(~F.col("base_failed"), F.col(k))
    quartiles = F.array(F.lit(LOW), F.lit(HIGH))
    return found.groupBy(*group).agg(
        F.count_if(~F.col("base_failed")).alias("n"), *[F.percentile_approx(passing(k), quartiles, ACCURACY).alias(k) for k in RATES]
    )


def _leaning(own: DataFrame, wider: DataFrame) -> DataFrame:
    """own with its quartiles joined with the wider group's (w_n, w_ and rate); of an empty group they are the wider ones."""
    both = lambda k, i: (
        (F.coalesce(F.col(f"{k}")[i], F.lit(0.0)) * F.col("n") + F.col(f"w_{k}")[i] * WIDER) / (F.col("n") + WIDER)
    )
    rest = [c for c in own.columns if c not in RATES]
    return wider.select(*rest, *[F.array(both(k, 0), both(k, 1)).alias(k) for k in RATES])


def _as_wider(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"w_{c}") for c in df.columns])


def limits(found: DataFrame) -> DataFrame:
    """(g_lang, g_source, and for each rate its lower and upper fence) of each language and source."""
    own, by_lang, whole = _sketches(found, "lang", "source"), _sketches(found, "lang"), _as_wider(_sketches(found))
    by_lang = _as_wider(_leaning(by_lang, by_lang.join(F.broadcast(whole))))  # whole is one row
    own = _leaning(own, own.join(by_lang, own.lang.eqNullSafe(by_lang.w_lang)))
    spread = lambda k: SPREAD * F.greatest(F.lit(RATES[k][3]), F.col(k)[1] - F.col(k)[0]) + SLACK
    return own.select(
        F.col("lang").alias("g_lang"),
        F.col("source").alias("g_source"),
        *[(F.col(k)[0] - spread(k)).alias(f"{k}_low") for k in RATES],
        *[(F.col(k)[1] + spread(k)).alias(f"{k}_high") for k in RATES],
    )


def judge(docs: DataFrame) -> DataFrame:
    """Measures, rates, limits, base_failed and kept of every row of docs (doc_id, text, lang, source).

    Defined results: null and empty texts have no words and fail the fixed rule; null languages and
    sources are groups of their own; a group in which no row passes the fixed rules has its language's limits;
    repeated rows all count; extra columns don't matter. The fixed rules: at least 50 words, at most half of them in repeated windows.
    """
    found = _rates(table(measures(docs), "measures"))
    own = limits(found)
    joined = found.join(
        own, found.lang.eqNullSafe(own.g_lang) & found.source.eqNullSafe(own.g_source), "left"
    )
    within = F.lit(True)
    for k, (*_, both) in RATES.items():
        within = within & (F.col(k) <= F.col(f"{k}_high"))
        if both:
            within = within & (F.col(k) >= F.col(f"{k}_low"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))).drop("g_lang", "g_source")
