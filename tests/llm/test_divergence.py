"""The audit against a plain loop over all terms, and its ranking against a sort."""

import random
import re
from collections import Counter, defaultdict

from tidewatch.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least, k):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), {(g, s) for _, g, s in rows}
    for t, g, s in rows:
        terms = TERM.findall(t.translate(SMALL))
        counts[g, s].update(terms)
        docs[g].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        v, whole = len(kept), Counter()
        for g, s in groups:
            if g == lang:
                whole.update({t: counts[g, s][t] for t in kept})

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        each, q = {s: p(counts[g, s]) for g, s in groups if g == lang}, p(whole)
        for s, own in each.items():
            pair = [(o, sum(f(own[t], other[t]) for t in kept)) for o, other in each.items() if o != s]
            term = [(t, f(own[t], q[t])) for t in kept if counts[lang, s][t] and own[t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, k)):
                best = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, x, value, i) for i, (x, value) in enumerate(best, 1)]
    return sorted(out)


def rows(seed, n):
    rng = random.Random(seed)
    words = [a + b for a in ("Alpha", "beta", "GAMMA", "été", "ünter", "漢字", "x") for b in ("", "s", "é", "ly", "zz")]
    out = []
    for i in range(n):
        source = rng.choice(["a", "b", "c", None, "d" if i % 3 else "b"])
        some = words[: 20 if source == "a" else 35]
        text = " ".join(rng.choice(some) + rng.choice(["", "1", "-", "\x00", ","]) for _ in range(rng.choice((0, 3, 30))))
        out.append((None if i % 11 == 0 else text, rng.choice(["en", "fr", None]), source))
    return [*out, ("only here", "xx", "lone"), ("", "xx", "other"), *out[:3]]


def test_audit_against_brute_force(spark):
    given = rows(3, 240)
    docs = spark.createDataFrame([(*r, 1, "c") for r in given], "text string, lang string, source string, term int, value string").repartition(3)
    for least, k in ((10, 10), (3, 2), (10_000, 5)):
        assert sorted(map(tuple, divergence.audit(docs, least, k).collect())) == brute(given, least, k)


def test_long_texts_in_pieces(spark, monkeypatch):
    given = [("Wort und " * 50 + "Ende", "de", "a")] * 4 + [("x" * 5000 + " und", "de", "b")] * 10
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert [len(x) for x in divergence._pieces(b"ab " * 100)] != [100]
    docs = spark.createDataFrame(given, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(docs, 4, 3).collect())) == brute(given, 4, 3)


def test_top_by_radix_selection(spark):
    """Values of every size, ties beyond the kth, long common prefixes, groups with fewer than k rows."""
    rng, given = random.Random(5), []
    for s in range(6):
        for i in range((0, 1, 3, 40, 200, 400)[s]):
            prefix = "p" * rng.choice((0, 1, 3000))
            given.append(("en", f"s{s}", f"{prefix}{rng.choice('aéz漢')}{i}", rng.choice((0, 1, 5, 1023, 1024, 2**20, 2**30 - 1)) if i % 2 else 77))
    given += [("en", "tied", "q" * n, 9) for n in range(1, 60)]
    df = spark.createDataFrame(given, "lang string, source string, item string, value long").repartition(4)
    want = []
    for s in {g[1] for g in given}:
        best = sorted((g for g in given if g[1] == s), key=lambda g: (-g[3], g[2].encode()))[:7]
        want += [(*g, i) for i, g in enumerate(best, 1)]
    assert sorted(map(tuple, divergence.top(df, 7).collect())) == sorted(want)


def test_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    c, n, v = 10**13, 3 * 10**13, 10**7
    got = spark.range(1).select(divergence._p(F.lit(c), F.lit(n), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_empty(spark, nothing):
    assert divergence.audit(nothing).count() == 0
