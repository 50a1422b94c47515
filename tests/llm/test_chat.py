import random
import re

import pytest

from tidewatch.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, lines string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    return {(r["conv_id"], r["turn"]): r for r in chat.conversations(df).collect()}


def test_linking(spark):
    got = run(
        spark,
        [
            (1, 0, "user", "Hello there\nhow are you?"),
            (1, 1, "assistant", "fine\n\nThanks for asking"),
            (1, 2, "user", "> Hello there\n> how are you?\nstill there?"),
            (1, 3, "assistant", ">> fine\n> > \n> still there?\n\nyes"),
            (1, 4, "user", "> nobody said this\nwhat"),
            (2, 0, "user", "> Thanks  for ASKING\nok"),
            (2, 1, "user", None),
            (3, 5, "user", ""),
        ],
    )
    assert [got[1, t]["linked"] for t in range(5)] == [False, False, True, True, False]
    assert (got[1, 2]["parent_turn"], got[1, 3]["parent_turn"], got[1, 4]["parent_turn"]) == (0, 2, 3)
    assert got[1, 2]["own"] == "still there?" and got[1, 3]["own"] == "yes"
    assert (got[2, 0]["parent_conv"], got[2, 0]["parent_turn"], got[2, 0]["linked"]) == (1, 1, True)
    assert got[2, 1]["parent_turn"] == 0 and got[2, 1]["own"] == ""
    assert got[3, 5]["parent_turn"] is None and got[3, 5]["position"] == 1
    assert [t for t, _ in sorted(((t, got[1, t]["position"]) for t in range(5)), key=lambda x: x[1])] == [0, 1, 2, 3, 4]


def brute(rows):
    """Every message against every other: (conv, turn) to (own, linked, parent_conv, parent_turn)."""
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    norm = lambda x: " ".join(re.sub(r"[\s>]+", " ", low(x)).split())

    def units(body):
        lines = body.split("\n") + re.split(r"(?<=[.?!]) ", re.sub(r"\s+", " ", body))
        parts = [[body], re.split(r"\n[ \t]*\n", body), [x for x in lines if len(norm(x).split()) >= 3]]
        return [{norm(x) for x in p} - {""} for p in parts]

    parsed = []
    for c, t, _, text in rows:
        own, runs, last = [], [], 0
        for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            m = re.match(r"(?:[ \t]*>)+", line)
            level = m.group().count(">") if m else 0
            if level:
                if level != last:
                    runs.append((level, []))
                runs[-1][1].append(re.sub(r"^(?:[ \t]*>)+ ?", "", line))
            own.append("" if level else line)
            if level and level == last != 0 or level and last:
                own.pop()
            last = level
        plain = "\n".join(own)
        if runs:
            plain = re.sub(r"\n(?:[ \t]*\n){2,}", "\n\n", plain).strip(" \t\n\x0b\x0c\r")
        parsed.append((c, t, plain, [(n, units("\n".join(x))) for n, x in runs], set().union(*units(plain))))
    out = {}
    for c, t, own, runs, _ in parsed:
        best = None
        for level, ranks in runs:
            for rank, hashes in enumerate(ranks):
                for h in hashes:
                    having = [(a, b) for a, b, _, _, said in parsed if b is not None and h in said]
                    inside = [b for a, b in having if a == c]
                    away = sorted((a, b) for a, b in having if a is not None and a != c)
                    if inside and t is not None and min(inside) < t:
                        found = ((1, -level, -rank, min(inside)), c, min(inside))
                    elif away:
                        found = ((0, -level, -rank, 0), *away[0])
                    else:
                        continue
                    if best is None or found > best:
                        best = found
        before = [b for a, b, *_ in parsed if a == c and b is not None and t is not None and b < t]
        out[c, t] = (own, best is not None, best[1] if best else c if before else None, best[2] if best else max(before, default=None))
    return out


def random_rows(seed):
    rng = random.Random(seed)
    words = ["red", "Blue", "green", "one", "two", "three", "ok"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, texts = [], ["One two three."]
    for c in (1, 2, 3, None):
        for t in range(12):
            parts = []
            for _ in range(rng.randrange(1, 4)):
                if rng.random() < 0.5:
                    q = rng.choice(texts).split("\n")
                    q = q[rng.randrange(len(q)) :] if rng.random() < 0.4 else q
                    sign = rng.choice(("> ", ">> ", "> > ", " >"))
                    parts.append("\n".join(sign + x for x in q))
                else:
                    parts.append(rng.choice((say(3) + ". " + say(4) + ".", say(2) + "\n" + say(5), say(1), "ok")))
            text = rng.choice(("\n", "\n\n")).join(parts)
            texts.append(text)
            rows.append((c, t * rng.choice((1, 1, 900)) + t, "user", text))
    return list({r[:2]: r for r in rows}.values())


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rows = random_rows(seed)
    got = {k: (r["own"], r["linked"], r["parent_conv"], r["parent_turn"]) for k, r in run(spark, rows).items()}
    want = brute(rows)
    assert sum(x[1] for x in want.values()) > 10
    # Messages of other conversations that tie in everything are compared by what they have in common.
    assert got == want


def test_links_past_the_own_conversation(spark):
    got = run(spark, [(1, 0, "u", "> a common passage\nq"), (1, 5, "u", "a common passage"), (2, 0, "u", "a common passage"), (None, 0, "u", "a common passage")])
    assert (got[1, 0]["parent_conv"], got[1, 0]["parent_turn"], got[1, 0]["linked"]) == (2, 0, True)


def test_parts_of_a_message(spark):
    post = "First of all hello.\n\nThis is the point. There is more\nto say about it.\n\nBye now."
    rows = [(1, 0, "u", post), (1, 1, "v", "a word between"), (1, 2, "v", "> First of all hello.\n>\n> This is the point. There is more\n> to say about it.\nyes")]
    rows += [(1, 3, "u", "so"), (1, 4, "v", "> There is more to say about it.\nindeed"), (1, 5, "u", "so"), (1, 6, "v", "> bye now\nnobody said that without a stop")]
    got = run(spark, rows)
    assert [(got[1, t]["linked"], got[1, t]["parent_turn"]) for t in (2, 4, 6)] == [(True, 0), (True, 0), (False, 5)]


def test_positions_in_long_conversations(spark):
    rows = [(1, t, "user", f"> message {t % 7} here\nreply {t}" if t % 3 == 0 and t > 7 else f"message {t} here") for t in range(3000)]
    rows += [(None, 1, "user", "x"), (1, None, "user", "y"), (5, 1, "user", "same"), (5, 1, "user", "same")]
    got = run(spark, rows)
    assert sorted(r["position"] for (c, t), r in got.items() if c == 1) == list(range(1, 3002))
    order = [t for t, _ in sorted(((t, r["position"]) for (c, t), r in got.items() if c == 1 and t is not None), key=lambda x: x[1])]
    key = lambda t: (got[1, t]["parent_turn"] if got[1, t]["parent_turn"] is not None else -1, t)
    assert order == sorted(range(3000), key=key)


def test_long_quotes_take_linear_time(spark):
    long = "\n".join("> " * (1 + k % 3) + f"line {k}" for k in range(60_000))
    assert run(spark, [(1, 0, "u", long), (1, 1, "u", "> line 3\nx")])[1, 0]["n_quotes"] == 60_000


def test_empty(spark):
    assert chat.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_turn_link_by_themselves(spark):
    """Only the row that quotes is linked, not another one of its turn; a row without a turn may quote as well."""
    rows = [(1, 0, "user", "alpha beta gamma"), (1, 1, "bot", "delta"), (1, 2, "user", "> alpha beta gamma\nyes"), (1, 2, "user", "nothing quoted"), (1, 2, None, None), (1, None, "user", "> alpha beta gamma")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(2)
    got = {(r["turn"], r["own"]): r for r in chat.conversations(df).collect()}
    assert len(got) == 6
    assert (got[2, "yes"]["linked"], got[2, "yes"]["parent_turn"], got[2, "yes"]["n_quotes"]) == (True, 0, 1)
    assert (got[2, "nothing quoted"]["linked"], got[2, "nothing quoted"]["parent_turn"], got[2, "nothing quoted"]["n_quotes"]) == (False, 1, 0)
    assert not got[2, ""]["linked"]
    assert sorted(r["position"] for r in got.values()) == [1, 2, 3, 4, 5, 6]


def test_own_text_without_quotes(spark):
    got = run(spark, [(1, 0, "u", "a\r\nb\x01c\x02  d\r")])
    assert got[1, 0]["own"] == "a\nb c   d\n"
