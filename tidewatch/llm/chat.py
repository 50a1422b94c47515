"""Chat formatting by quotation linking, in DataFrame functions.

A message's lines have a quote level: the number of > signs (spaces between them) that they start
with. A maximal run of lines of one level above 0 is a quoted passage. Passages are normalised (signs
and white space folded, A-Z in lower case) and hashed, whole, by paragraphs (blank quoted lines part
them) and by lines and sentences of PART_WORDS words or more; so are the own texts of the messages,
that is without quotes. A hash that both have links the quoting message to the earliest message with
it, within the conversation first and else in another one. Of a message's links the one inside its
conversation counts first, then the lower level, then the larger unit (passage, paragraph, line or
sentence), then the latest message before it. A message's parent is the message it links to, else
the message before it. Messages are put in reply order: by the turn of the message they answer, then
by their own. Quotes are left out of the text; one between paragraphs leaves a blank line. Positions
come from range partitions, so that a conversation of any length is no single task's work.

Hot passages: candidates are aggregated to one earliest message for each hash and conversation, and
to the two earliest conversations for each hash (one of them isn't the asking one), before they are
joined, so a common text is two rows, however many have it.

Defined results: null texts count as empty; messages without quotes reply to the one before; a
passage that nobody wrote links to nothing; rows with a null conversation form a conversation of
their own, which others don't link to; a null turn comes first and isn't linked to; different rows of one turn each have
their own links; rows alike in conversation, turn, role and text
stay, with the same result but for the position; of equal passages the earliest counts; extra
columns don't matter. The own text of a message without quotes is its text but for line ends (\\r\\n and \\r become \\n) and
U+0001 and U+0002, which mark runs while quotes are parsed and become spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import placed, table

#: Words of the shortest line or sentence that links by itself.
PART_WORDS = 3

_LEVEL = r"^((?:[ \t]*>)+)"
_BLOCK = r"(?m)^[ \t]*+>[^\n]*+(?:\n[ \t]*+>[^\n]*+)*+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, _UPPER, _UPPER.lower()), r"[\s>]+", " "))


def _hashed(parts: Column, least: int = 1) -> Column:
    """Distinct hashes of the normalised parts that have at least so many words."""
    some = F.filter(F.transform(parts, _norm), lambda p: (p != "") & (F.size(F.split(p, " ")) >= least))
    return F.array_distinct(F.transform(some, lambda p: F.xxhash64(p)))


def _units(body: Column) -> list[Column]:
    """Hashes of a text: whole, of its paragraphs, of its lines and sentences."""
    lines = F.concat(F.split(body, "\n"), F.split(F.regexp_replace(body, r"\s+", " "), r"(?<=[.?!]) "))
    return [_hashed(F.array(body)), _hashed(F.split(body, r"\n[ \t]*\n")), _hashed(lines, PART_WORDS)]


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, key (of the row, by these and the text) and: own (text without quotes), passages (array of level, body) of each row."""
    text = F.translate(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\r\n?", "\n"), "\x01\x02", "  ")
    quoted = F.col("plain").rlike(r"(?m)^[ \t]*>")
    key = F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}), 256)
    df = messages.select("conv_id", "turn", "role", key.alias("key"), text.alias("plain"))
    lines = F.transform(
        F.split(F.array_join(F.regexp_extract_all("plain", F.lit(_BLOCK), F.lit(0)), "\n\n"), "\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _LEVEL, 1), r"[ \t]", "")).alias("level"),
            F.regexp_replace(x, _LEVEL + r" ?", "").alias("line"),
        ),
    )
    df = df.withColumn("lines", F.when(quoted, lines))
    # Where the level changes a run begins: marks that no text has, and one split, take linear time.
    runs = F.expr(
        """split(array_join(transform(lines, (x, i) ->
             concat(CASE WHEN i > 0 AND lines[i - 1].level = x.level THEN '\n' ELSE concat('\x01', x.level, '\x02') END, x.line)), ''), '\x01')"""
    )
    runs = F.transform(runs, lambda r: F.split(r, "\x02"))
    passages = F.transform(
        F.filter(runs, lambda r: (F.size(r) == 2) & (r[0] != "0")), lambda r: F.struct(r[0].cast("int").alias("level"), r[1].alias("body"))
    )
    empty = F.array().cast("array<struct<level: int, body: string>>")
    own = F.when(quoted, F.regexp_replace(F.regexp_replace(F.regexp_replace("plain", _BLOCK, ""), r"\n(?:[ \t]*\n){2,}", "\n\n"), r"\A\s+|\s+\z", ""))
    return df.select("conv_id", "turn", "role", "key", F.coalesce(own, "plain").alias("own"), F.coalesce(passages, empty).alias("passages"))


def link(parsed: DataFrame) -> DataFrame:
    """key, to_conv, to_turn, level: for each message with quotes that somebody wrote, the message it answers."""
    passages = parsed.filter(F.size("passages") > 0).select("key", "conv_id", "turn", F.explode("passages").alias("q"))
    ranked = [F.transform(u, lambda h, k=k: F.struct(F.lit(k).alias("rank"), h.alias("h"))) for k, u in enumerate(_units(F.col("q.body")))]
    asked = table(passages.select("key", "conv_id", "turn", "q.level", F.inline(F.concat(*ranked))).distinct(), "asked")
    said = parsed.filter("turn is not null").select("conv_id", "turn", F.explode(F.array_distinct(F.concat(*_units(F.col("own"))))).alias("h"))
    near = said.join(asked.select("h").distinct(), "h", "left_semi").groupBy("h", "conv_id").agg(F.min("turn").alias("to_turn"))
    near = table(near, "said")
    others = near.filter("conv_id is not null")
    first = others.groupBy("h").agg(F.min(F.struct("conv_id", "to_turn")).alias("first"))
    second = others.join(first, "h").filter(F.col("conv_id") != F.col("first.conv_id")).groupBy("h").agg(F.min(F.struct("conv_id", "to_turn")).alias("second"))
    far = first.join(second, "h", "left")
    own = near.select(F.col("h").alias("_h"), F.col("conv_id").alias("_conv"), "to_turn")
    found = asked.join(own, (asked["h"] == own["_h"]) & asked["conv_id"].eqNullSafe(own["_conv"]), "left")
    found = found.withColumn("inside", F.coalesce(F.col("to_turn") < F.col("turn"), F.lit(False))).join(far, "h", "left")
    away = F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))
    found = found.withColumn("away", away).select(
        "key",
        "level",
        "rank",
        "inside",
        F.when(F.col("inside"), F.col("conv_id")).otherwise(F.col("away.conv_id")).alias("to_conv"),
        F.when(F.col("inside"), F.col("to_turn")).otherwise(F.col("away.to_turn")).alias("to_turn"),
    )
    near_turn = F.when(F.col("inside"), F.col("to_turn"))
    best = found.filter("to_turn is not null").groupBy("key").agg(
        F.max(F.struct("inside", (-F.col("level")).alias("depth"), (-F.col("rank")).alias("size"), near_turn.alias("near"), "to_conv", "to_turn")).alias("b")
    )
    return best.select("key", F.col("b.to_conv").alias("to_conv"), F.col("b.to_turn").alias("to_turn"), (-F.col("b.depth")).alias("level"))


def _turn_before(df: DataFrame) -> DataFrame:
    """df with last_turn: the largest smaller turn of its conversation."""
    turns = table(placed(df.select("conv_id", "turn").filter("turn is not null").distinct(), "conv_id", "turn"), "turns")
    mine = turns.select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn"), "place")
    last = turns.select(F.col("conv_id").alias("l_conv"), F.col("turn").alias("last_turn"), (F.col("place") + 1).alias("l_place"))
    mine = mine.join(last, mine.t_conv.eqNullSafe(last.l_conv) & (mine.place == last.l_place)).select("t_conv", "t_turn", "last_turn")
    return df.join(mine, df.conv_id.eqNullSafe(mine.t_conv) & (df.turn == mine.t_turn), "left").drop("t_conv", "t_turn")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message with: own text, n_quotes, linked (a quote was found), parent_conv, parent_turn, position in reply order."""
    parsed = table(parse(messages), "messages")
    df = _turn_before(parsed).join(link(parsed).select("key", "to_conv", "to_turn"), "key", "left")
    linked = F.col("to_turn").isNotNull()
    df = df.withColumns(
        {
            "linked": linked,
            "parent_conv": F.when(linked, F.col("to_conv")).when(F.col("last_turn").isNotNull(), F.col("conv_id")),
            "parent_turn": F.when(linked, F.col("to_turn")).otherwise(F.col("last_turn")),
        }
    )
    inside = F.when(F.col("parent_conv").eqNullSafe(F.col("conv_id")), F.col("parent_turn"))
    df = df.select(
        "conv_id", "turn", "role", "own", F.size("passages").cast("long").alias("n_quotes"), "linked", "parent_conv", "parent_turn",
        F.coalesce(inside, F.lit(-1).cast("long")).alias("answers"), "key",
    )
    df = placed(df, "conv_id", "answers", "turn", "key")
    return df.select("conv_id", "turn", "role", "own", "n_quotes", "linked", "parent_conv", "parent_turn", (F.col("place") + 1).alias("position"))
