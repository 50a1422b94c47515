"""Audit of how far sources diverge within their language.

A source's terms are smoothed to integer probabilities p (parts of 10 ** 9); the divergence of two is the sum of
f = (p - q) ** 2 div (p + q) over all terms that the language keeps. Most terms don't occur in most sources: there p is
the source's baseline, the same for all of them. So two sources' sum starts from the baselines alone, is corrected by
one histogram of counts for each source (all terms of one count have one p), and once more for the terms that both have, which are
the only ones that meet. All of it is exact integer arithmetic.

The terms by which a source leans most from its language are ranked by radix selection: a distributed histogram over
DIGIT bits of the values at a time finds each source's kth value from the highest bits down, keeping only the bucket that holds it.
Ties at that value are refined by histograms over their UTF-8 bytes, BYTES at a time, after the bytes that all of them
share. No source's terms are sorted or gathered; the last ranking has at most k rows of each.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, table

SCALE = 1_000_000_000
#: Bits of values that one histogram covers; values are below 2 ** VALUE_BITS.
DIGIT, VALUE_BITS = 10, 30
#: Bytes of tied terms that one histogram covers, after those that all of them share.
BYTES = 2
#: Different (lang, source, term) a task holds before it sends its counts.
HELD = 200_000
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A-Z lower-cased, other ASCII but a-z a space, bytes of longer characters themselves.
_TERM_BYTES = bytes(b + 32 if b in _LETTERS else b if b in _LETTERS.lower() or b >= 0x80 else 32 for b in range(256))


def _pieces(text: bytes):
    """Lists of a text's terms, some at a time; no term is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame, spare: tuple[str, str, str] = ("text", "lang", "source")) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of each term, partial sums of tasks; null counts as ''."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(n) for c, n in zip(spare, ("text", "lang", "source"))]

    def run(batches):
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def sent():
            for (lang, source), (count, seen) in held.items():
                terms = list(count)
                n = len(terms)
                arrays = [pa.array([lang] * n, pa.binary()), pa.array([source] * n, pa.binary()), pa.array(terms, pa.binary())]
                arrays += [pa.array(list(count.values()), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "c", "d"])
            held.clear()

        size = 0
        for b in batches:
            for text, lang, source in zip(*b.columns):
                count, seen = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                size -= len(count)
                own: set[bytes] = set()
                for terms in _pieces(text.as_py().translate(_TERM_BYTES)):
                    count.update(terms)
                    own.update(terms)
                seen.update(own)
                size += len(count)
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    found = docs.select(*columns).mapInArrow(run, "lang binary, source binary, term binary, c long, d long")
    return found.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "c", "d")


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, c, all_c, lead): terms in at least so many documents of their language; all_c is the language's count, lead
    marks one row of each term. Rows meet by (lang, term), one for each source and task, and stay there."""
    by_term = Window.partitionBy("lang", "term")
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    each = each.withColumns({"in_docs": F.sum("d").over(by_term), "all_c": F.sum("c").over(by_term), "first": F.min("source").over(by_term)})
    return each.filter(F.col("in_docs") >= least).select("lang", "source", "term", "c", "all_c", (F.col("first") == F.col("source")).alias("lead"))


def _p(count, n, v):
    """Smoothed probability of a term, exact for any count."""
    wide = lambda x: x.cast("decimal(20,0)")
    total = wide(n) + 2 * wide(v)
    return F.lit(1).cast("long") + F.call_function("div", (wide(count) + 2) * F.lit(SCALE).cast("decimal(10,0)"), total)


def _f(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of different sources of a language.

    groups: lang, source, n, v, base. kept: lang, source, term, c, p.
    """
    lower = groups.select("lang", F.col("source").alias("a"), F.col("v"), F.col("base").alias("base_a"))
    upper = groups.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"))
    both = lower.join(upper, "lang").filter("a < b")  # the result's own rows
    value = F.col("v") * _f(F.col("base_a"), F.col("base_b"))

    # All terms of a source that occur equally often have one p: a histogram stands for them.
    counts = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    own = counts.join(groups.select("lang", F.col("source").alias("other"), F.col("base").alias("base_other")), "lang").filter("source <> other")
    own = own.join(groups.select("lang", "source", "base"), ["lang", "source"])
    moved = F.col("terms") * (_f(F.col("p"), F.col("base_other")) - _f(F.col("base"), F.col("base_other")))
    own = own.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), moved.alias("value"))

    # Only terms of both sources meet; each term has one row of a source at most.
    rows = kept.join(groups.select("lang", "source", "base"), ["lang", "source"]).select("lang", "term", "source", "p", "base")
    left = rows.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("base").alias("base_a"))
    right = rows.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("base").alias("base_b"))
    met = left.join(right, ["lang", "term"]).filter("a < b")
    corner = _f(F.col("p_a"), F.col("p_b")) - _f(F.col("p_a"), F.col("base_b")) - _f(F.col("base_a"), F.col("p_b")) + _f(F.col("base_a"), F.col("base_b"))
    met = met.groupBy("lang", "a", "b").agg(F.sum(corner).alias("value"))

    parts = both.select("lang", "a", "b", value.alias("value")).unionByName(own).unionByName(met)
    total = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = lambda x, y: total.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), "value")
    return one("a", "b").unionByName(one("b", "a"))


def _narrow(rows: DataFrame, digit, k: str, descending: bool) -> DataFrame:
    """One histogram step: rows of the buckets that hold each group's k best, sure where a bucket is wholly in, else with
    the number still wanted of the last bucket."""
    order = F.desc("_digit") if descending else F.asc("_digit")
    before = Window.partitionBy("lang", "source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_digit", digit)
    cells = rows.groupBy("lang", "source", "_digit").agg(F.count("*").alias("_n"), F.first(k).alias("_k"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_before < _k")
    cells = cells.select("lang", "source", "_digit", F.least(F.col("_k") - F.col("_before"), F.col("_n")).alias("_wanted"), "_n")
    found = rows.join(cells, ["lang", "source", "_digit"])
    return found.withColumns({k: F.col("_wanted"), "sure": F.col("_wanted") == F.col("_n")}).drop("_digit", "_wanted", "_n")


def _first_difference(rows: DataFrame) -> DataFrame:
    """(lang, source, at): the first byte, from 1, in which a group's items differ; the least and the greatest show it."""
    ends = rows.groupBy("lang", "source").agg(F.min("item").cast("binary").alias("lo"), F.max("item").cast("binary").alias("hi"))
    byte = "sequence(1, least(octet_length(lo), octet_length(hi)) + 1), i -> substring(lo, i, 1) = substring(hi, i, 1)"
    return ends.select("lang", "source", F.expr(f"int(array_position(transform({byte}), false))").alias("at"))


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k rows (lang, source, item, value) of each (lang, source) with the highest values, below 2 ** VALUE_BITS, ties
    by the item's bytes; with their rank. Items of a group are different. A table of its own."""
    steps: list[DataFrame] = []

    def step(left: DataFrame, digit, descending: bool) -> DataFrame:
        steps.append(table(_narrow(left, digit, "k", descending), "ranked"))
        return steps[-1].filter("NOT sure").drop("sure")

    left = rows.select("lang", "source", "item", "value", F.lit(k).cast("long").alias("k"))
    for low in range(VALUE_BITS - DIGIT, -1, -DIGIT):
        left = step(left, F.shiftright("value", low).bitwiseAND(2**DIGIT - 1), True)
    while not left.isEmpty():  # each step splits what is left of a group
        left = left.join(_first_difference(left), ["lang", "source"])
        left = step(left, F.expr(f"substring(binary(item), at, {BYTES})"), False).drop("at")
    columns = ["lang", "source", "item", "value"]
    best = reduce(DataFrame.unionByName, [s.filter("sure").select(columns) for s in steps])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))  # k rows at most
    best = table(best.withColumn("rank", rank), "top")
    for s in steps:
        forget(s)
    return best


def audit(docs: DataFrame, least_docs: int = 10, k: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has each other source of the language with the divergence from it, part
    'term' the k terms that lean most from the language.

    Defined results: null texts, languages and sources count as ''. Every group that occurs is there, also without terms;
    a language that keeps none has divergence 0 between its sources. Ties go by UTF-8 bytes. Repeated rows count each time.
    A table without rows gives none. Extra columns don't matter.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = table(kept_terms(term_counts(docs), least_docs), "terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count_if("lead").alias("leads"))
    by_lang = sums.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("n").alias("lang_n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = groups.join(sums.drop("leads"), ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("lang_n"))
    base = F.when(F.col("v") > 0, _p(F.lit(0), F.col("n"), F.greatest(F.col("v"), F.lit(1)))).otherwise(1)
    groups = table(groups.withColumn("base", base), "groups")
    facts = kept.join(groups.drop("base"), ["lang", "source"])
    rated = table(
        facts.select("lang", "source", "term", _p(F.col("c"), F.col("n"), F.col("v")).alias("p"), _p(F.col("all_c"), F.col("lang_n"), F.col("v")).alias("q")), "rated"
    )
    leaning = rated.filter("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    terms = top(leaning, k)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    between = table(pairs(rated, groups).withColumn("rank", rank), "pairs")
    for t in (kept, rated, groups):
        forget(t)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(between, "pair").unionByName(columns(terms, "term"))
