import random

import pytest

WORDS = [a + b for a in ("th", "re", "on", "an", "ti", "es", "ha", "io") for b in ("er", "ed", "at", "in", "nt", "ou", "ly", "st")]

#: id, text: the cases every operator has to stand.
ODD = [
    (None, "a row without an id, " * 6),
    (-7, "negative ids are ids"),
    (1, None),
    (2, ""),
    (3, " \n\t \x0b\x0c\r "),
    (4, "one"),
    (5, "One"),
    (6, "tab\tand\nline  and   spaces "),
    (7, "émoji 😀 and no-break   space"),
    (8, "x" * 3000),
    (9, "+1 (555) 555-1234 mail bob.b@mail.example.com host 10.0.0.255 card 4111 1111 1111 1111 no 4111111111111112"),
]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): odd cases, exact and near copies, shared passages, one long text, a repeated row."""
    rng = random.Random(11)
    rows, shared = list(ODD), prose(rng, 30)
    for i in range(20, 50):
        rows.append((i, prose(rng, rng.choice((3, 20, 60, 150)))))
    base = prose(rng, 120).split()
    for i in range(50, 62):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        rows.append((i, " ".join(copy).upper() if i == 55 else " ".join(copy)))
    for i in range(70, 80):
        rows.append((i, prose(rng, 20) + "\n" + shared + " " + prose(rng, 15)))
    rows += [(90, rows[12][1]), (91, rows[12][1]), (92, prose(rng, 6000)), (20, rows[11][1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with the operators' own."""
    extra = ("x", 1, "y", 2, True)
    schema = "doc_id long, text string, lang string, source string, n_chars long, cls string, `order` int, t string, seq int, base boolean"
    rows = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", len(t or ""), *extra) for i, t in corpus]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)
