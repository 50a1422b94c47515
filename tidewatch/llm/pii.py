"""Personal data: fixed patterns, and bootstrapped contextual extraction, in Spark SQL functions only.

Base. Four patterns give the leftmost matches that don't overlap; matches that fail their check
(parts of an address, digits and Luhn's sum of a card, digits of a phone) are dropped.

Bootstrapping. Base matches are seeds. Lexical patterns are the two words before an identifier, the
two words after it, and the word before with the word after it, in lower case and with digits made
equal, each with the identifier's class (with or without @). Candidates are further identifier-like
tokens of MIN_LENGTH characters or more. A context of more than CONTEXT characters to one side is none. Patterns and instances
form a bipartite graph. In each hop, patterns with MIN_SEEDS distinct known instances (seeds, or
instances promoted in hops before) are scored in ROUNDS rounds: a pattern's confidence is the mean
score of its instances (smoothed), an instance's score is one minus the product of its patterns'
doubts, seeds count 1 and promoted instances at least what they were promoted with. Patterns with
MIN_CONFIDENCE at the end are promoted, as the kind of most of their known instances, and so are
their unseen instances, which support further patterns; hops go on until none is promoted. Promoted
patterns yield their unseen instances; of several that name a place, the most trusted one tells its kind. Base spans always stay. Instances are counted once however
often copied, so a text's copies don't raise a pattern.

The patterns below are equivalent to the plain ones they stand for, with possessive quantifiers and
a look behind instead of restarts inside a run, so that long runs take linear time. A match's place
is the first place of its string at or after the end of the match before; that is exact, since an
earlier place would have been a match itself. Long texts are cut into pieces where no match can go on, so that places, overlaps and
contexts cost time in proportion to the text, however many matches it has.

Defined results: null texts count as empty, without spans; offsets are code points, end exclusive;
base spans of different kinds may overlap, added spans overlap no other; repeated rows give repeated
results; extra columns of any name stay, but columns named base and spans are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"
#: Characters before an identifier in which its context is looked for.
CONTEXT = 60
#: Spans of a text from which it is put together by pieces.
FEW_SPANS = 64
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, MIN_LENGTH = 3, 3, 0.8, 5


def _sql(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    d = _digits(m)
    return (
        f"aggregate(sequence(1, length({d})), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN int(substr({d}, -i, 1)) "
        f"ELSE 2 * int(substr({d}, -i, 1)) - CASE WHEN int(substr({d}, -i, 1)) > 4 THEN 9 ELSE 0 END END) % 10 = 0"
    )


_CHECKS = {
    "email": "true",
    "ip": "forall(split(s.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', ltrim('0', p))) <= 255)",
    "card": f"length({_digits('s.m')}) BETWEEN 14 AND 19 AND {_luhn('s.m')}",
    "phone": f"length({_digits('s.m')}) BETWEEN 10 AND 15",
}
#: What a piece of text must hold for a pattern to be worth looking for.
_NEEDS = {"email": "contains(c.t, '@')", "ip": "c.digit", "card": "c.digit", "phone": "contains(c.t, '+')"}
#: Characters of a piece of a long text, at least. Pieces end where no match can go on: a letter before a space or a line's end
#: (only e-mail addresses and candidates hold letters, and these hold no space).
PIECE = 2000
CUT = r"(?s)(?:.{%d}.*?[A-Za-z](?=[\x20\n])|.+)" % PIECE


def _split(text: str) -> str:
    """SQL for the pieces of a text."""
    return f"CASE WHEN length({text}) <= {2 * PIECE} THEN array({text}) ELSE regexp_extract_all({text}, {_sql(CUT)}, 0) END"


def _starts(pieces: str) -> str:
    """SQL for the place at which each piece starts."""
    return (
        f"aggregate({pieces}, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, p) -> "
        "named_struct('at', a.at + length(p), 'out', array_append(a.out, a.at)), a -> a.out)"
    )


def _places(pattern: str, order: int, needs: str) -> str:
    """SQL for the matches of a pattern in a piece c: array of (start in the piece, kind number, end, m)."""
    return f"""
    CASE WHEN {needs} THEN aggregate(regexp_extract_all(c.t, {_sql(pattern)}, 0),
      named_struct('at', 1, 'out', cast(array() AS array<struct<s: int, k: int, e: int, m: string>>)),
      (a, m) -> named_struct(
        'at', locate(m, c.t, a.at) + length(m),
        'out', array_append(a.out, named_struct('s', locate(m, c.t, a.at) - 1, 'k', {order}, 'e', locate(m, c.t, a.at) - 1 + length(m), 'm', m))),
      a -> a.out)
    ELSE cast(array() AS array<struct<s: int, k: int, e: int, m: string>>) END"""


_GAP, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def _taken(text: str, pattern: str) -> str:
    """SQL for the first group of a pattern, in lower case, with every digit as 0; empty if there is no match."""
    return f"regexp_replace(lower(regexp_extract({text}, {_sql(pattern)}, 1)), '[0-9]', '0')"


def _contexts() -> str:
    """SQL for the lexical patterns of a match s (s.s to s.e) of a piece c, which has CONTEXT characters of its neighbours around it
    in c.w. Words that the windows cut don't count."""
    at = "(s.s + c.lead)"
    before = f"concat(CASE WHEN s.s + c.o <= {CONTEXT} THEN ' ' ELSE '' END, substr(c.w, greatest(1, {at} + 1 - {CONTEXT}), least({at}, {CONTEXT})))"
    after = f"concat(substr(c.w, s.e + c.lead + 1, {CONTEXT}), CASE WHEN c.n <= s.e + c.o + {CONTEXT} THEN ' ' ELSE '' END)"
    two, one = f"{_WORD}+{_GAP}+{_WORD}+", f"{_WORD}+"
    parts = {
        "b2": _taken("w.b", f"{_GAP}({two}){_GAP}*\\z"), "b1": _taken("w.b", f"{_GAP}({one}){_GAP}*\\z"),
        "a2": _taken("w.a", f"\\A{_WORD}*{_GAP}+({two}){_GAP}"), "a1": _taken("w.a", f"\\A{_WORD}*{_GAP}+({one}){_GAP}"),
    }
    words = ", ".join(f"'{k}', {x}" for k, x in parts.items())
    return (
        f"array_compact(flatten(transform(transform(array(named_struct('b', {before}, 'a', {after})), w -> named_struct({words})), w -> array("
        "CASE WHEN w.b2 <> '' THEN concat('<', w.b2) END, CASE WHEN w.a2 <> '' THEN concat('>', w.a2) END, "
        "CASE WHEN w.b1 <> '' AND w.a1 <> '' THEN concat('=', w.b1, ' _ ', w.a1) END))))"
    )


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text_col, the other columns as struct __rest, and: base, the checked matches in order; graph, identifiers with their contexts."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    df = docs.select(F.col(f"`{text_col}`").alias("__text"), F.struct(*(rest or [F.lit(None).alias("none")])).alias("__rest"))
    df = df.withColumns({"__row": F.monotonically_increasing_id(), "t": F.coalesce(F.col("__text").cast("string"), F.lit(""))})
    # Arrays of the same length meet in zip_with, which evaluates each once; an index into one, inside a lambda, would be evaluated anew for each piece.
    df = df.withColumn("_p", F.expr(_split("t")))
    lead, tail = (f"transform({x}, p -> {f}(p, {CONTEXT}))" for x, f in (("concat(array(''), slice(_p, 1, size(_p) - 1))", "right"), ("concat(slice(_p, 2, size(_p)), array(''))", "left")))
    around = f"zip_with({lead}, {tail}, (x, y) -> named_struct('x', x, 'y', y))"
    pieces = f"zip_with(zip_with(_p, {_starts('_p')}, (p, o) -> named_struct('t', p, 'o', o)), {around}, (p, a) -> named_struct("
    pieces += "'t', p.t, 'o', p.o, 'w', concat(a.x, p.t, a.y), 'lead', length(a.x), 'digit', p.t RLIKE '[0-9]', 'n', length(t)))"
    df = df.withColumn("_c", F.expr(pieces))
    for k, kind in enumerate(KINDS):
        df = df.withColumn(f"_{kind}", F.expr(f"transform(_c, c -> filter({_places(PATTERNS[kind], k, _NEEDS[kind])}, s -> {_CHECKS[kind]}))"))
    both = lambda a, b: f"zip_with({a}, {b}, (a, b) -> concat(a, b))"
    df = df.withColumn("_base", F.expr(f"transform({both(both('_email', '_ip'), both('_card', '_phone'))}, x -> array_sort(x))"))
    found = f"filter({_places(CANDIDATE, len(KINDS), "(c.digit OR contains(c.t, '@'))")}, s -> length(rtrim('._%+-', s.m)) >= {MIN_LENGTH})"
    trimmed = f"transform({found}, s -> named_struct('s', s.s, 'k', s.k, 'e', s.s + length(rtrim('._%+-', s.m)), 'm', rtrim('._%+-', s.m)))"
    df = df.withColumn("_cand", F.expr(f"zip_with(_c, _base, (c, x) -> filter({trimmed}, s -> NOT exists(x, b -> b.s < s.e AND s.s < b.e)))"))
    row = f"named_struct('s', s.s + c.o, 'e', s.e + c.o, 'm', lower(s.m), 'kind', {{kind}}, 'contexts', {_contexts()}, 'at', contains(s.m, '@'))"
    own = f"concat(transform(x.b, s -> {row.format(kind='s.k')}), transform(x.d, s -> {row.format(kind='-1')}))"
    df = df.withColumn("graph", F.expr(f"flatten(zip_with(_c, zip_with(_base, _cand, (b, d) -> named_struct('b', b, 'd', d)), (c, x) -> {own}))"))
    df = df.withColumn("base", F.expr("flatten(zip_with(_c, _base, (c, x) -> transform(x, s -> named_struct('s', s.s + c.o, 'k', s.k, 'e', s.e + c.o))))"))
    return df.drop("t", "_p", "_c", "_base", "_cand", *[f"_{k}" for k in KINDS])


def _trusted(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(context, at, kind, trust): patterns that the known instances (m, is, weight) support and whose trust suffices."""
    edges = edges.join(known, "m", "left")
    live = edges.filter("weight is not null").groupBy("context", "at").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SEEDS)
    edges = table(edges.join(live.drop("n"), ["context", "at"]).withColumn("weight", F.coalesce("weight", F.lit(0.0))), "pii-live")
    score = edges.groupBy("m").agg(F.max("weight").alias("score"))
    for _ in range(ROUNDS):
        trust = edges.join(score, "m").groupBy("context", "at").agg((F.sum("score") / (F.count("*") + 0.5)).alias("trust"))
        new = edges.join(trust, ["context", "at"]).groupBy("m").agg(F.max("weight").alias("weight"), _doubt().alias("doubt"))
        score = table(new.select("m", F.greatest("weight", 1 - F.exp("doubt")).alias("score")), "pii-scores")
    trust = edges.join(score, "m").groupBy("context", "at").agg(
        (F.sum("score") / (F.count("*") + 0.5)).alias("trust"),
        *[F.count_if(F.col("is") == k).alias(f"n{k}") for k in range(len(KINDS))],
    )
    most = F.array_max(F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(-k).alias("k")) for k in range(len(KINDS))]))
    return trust.filter(F.col("trust") >= MIN_CONFIDENCE).select("context", "at", (-most["k"]).alias("kind"), "trust")


def _doubt() -> Column:
    return F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999))))


def confident_patterns(graph: DataFrame) -> DataFrame:
    """(context, at, kind, trust): patterns that earned trust, from rows (context, at, m, kind; -1: unseen)."""
    edges = graph.filter("context is not null").select("context", "at", "m").distinct()
    # Patterns of fewer instances can't get their support, whatever is promoted.
    wide = edges.groupBy("context", "at").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SEEDS)
    edges = table(edges.join(wide.drop("n"), ["context", "at"]), "pii-edges")
    seeds = graph.filter("kind >= 0").groupBy("m").agg(F.max("kind").alias("is"), F.lit(1.0).alias("weight"))
    known = table(seeds.join(edges.select("m"), "m", "left_semi"), "pii-known")
    good = None
    while True:
        new = _trusted(edges, known)
        new = table(new if good is None else new.join(good, ["context", "at"], "left_anti"), "pii-promoted")
        good = new if good is None else table(good.unionByName(new), "pii-good")
        if new.isEmpty():
            return good.select("context", "at", "kind", "trust")
        found = edges.join(new, ["context", "at"]).join(known, "m", "left_anti").groupBy("m").agg(
            F.max(F.struct("trust", (-F.col("kind")).alias("k"))).alias("best"), _doubt().alias("doubt")
        )
        known = table(known.unionByName(found.select("m", (-F.col("best.k")).alias("is"), (1 - F.exp("doubt")).alias("weight"))), "pii-known")


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """__text, __rest, base and spans of every row."""
    rows = table(base_spans(docs, text_col), "pii")
    graph = rows.select("__row", F.explode("graph").alias("g")).select("__row", "g.s", "g.e", "g.m", "g.kind", "g.at", F.explode_outer("g.contexts").alias("context"))
    good = table(confident_patterns(graph.select("context", "at", "m", "kind")), "pii-patterns")
    if good.isEmpty():  # nothing to add, so nothing to join
        return rows.select("__text", "__rest", "base", F.col("base").alias("spans"))
    more = (
        graph.filter("kind < 0")
        .join(good.withColumnRenamed("kind", "as"), ["context", "at"])
        .groupBy("__row", "s", "e")
        .agg(F.max(F.struct("trust", (-F.col("as")).alias("k"))).alias("best"))
        .groupBy(F.col("__row").alias("__found"))
        .agg(F.collect_list(F.struct("s", (-F.col("best.k")).cast("int").alias("k"), "e")).alias("more"))
    )
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return rows.join(more, rows["__row"] == more["__found"], "left").select("__text", "__rest", "base", spans.alias("spans"))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and: base and spans, arrays of (s, k, e), kind number k; spans has what the method adds."""
    column = lambda c: F.col("__text") if c == text_col else F.col(f"__rest.`{c}`")
    return _found(docs, text_col).select(*[column(c).alias(c) for c in docs.columns if c not in ("base", "spans")], "base", "spans")


def listed(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat_ws(':', element_at(array({names}), s.k + 1), string(s.s), string(s.e))))")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; n_chars, if there, is the new length."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)

    def replaced(text: str, spans: str) -> str:
        return f"""aggregate({spans}, named_struct('at', 0, 'out', ''),
        (a, s) -> CASE WHEN s.s < a.at THEN named_struct('at', greatest(a.at, s.e), 'out', a.out) ELSE
          named_struct('at', s.e, 'out', concat(a.out, substr({text}, a.at + 1, s.s - a.at), element_at(array({names}), s.k + 1))) END,
        a -> concat(a.out, substr({text}, a.at + 1)))"""

    # A text of many spans is put together piece by piece: no span goes beyond one.
    mine = "transform(filter(spans, s -> s.s >= c.o AND s.s < c.o + length(c.t)), s -> named_struct('s', s.s - c.o, 'k', s.k, 'e', s.e - c.o))"
    pieces = f"zip_with({_split('__text')}, {_starts(_split('__text'))}, (x, o) -> named_struct('t', x, 'o', o))"
    text = F.expr(
        f"CASE WHEN size(spans) = 0 THEN __text WHEN size(spans) < {FEW_SPANS} THEN {replaced('__text', 'spans')} "
        f"ELSE array_join(transform({pieces}, c -> {replaced('c.t', mine)}), '') END"
    )
    out = _found(docs, "text").select("__rest", text.alias("__text"))
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"__rest.`{c}`")).alias(c) for c in docs.columns])
