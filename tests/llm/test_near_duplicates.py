import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tidewatch.llm import jaccard_join as J
from tidewatch.llm.graph import components


def shingles(text, n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and a and b
            if same_id or (both and 100 * both >= percent * (len(a) + len(b) - both)):
                parent[find(i)] = find(j)
    group = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            group[r] = min(group.get(r, d), d)
    return sorted(((d, len(sets[i]), group.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60), (2, 100)])
def test_brute_force(docs, corpus, n, percent):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs, n, percent).collect()]
    assert sorted(got, key=repr) == brute(corpus, n, percent)


def test_many_near_copies_and_costly_lists(spark, monkeypatch):
    """Lists over the cost limit, several blocks, sets without slack."""
    monkeypatch.setattr(J, "COSTLY", 6)
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "CENTRE_ROWS", 8)
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(70)], []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 7))):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, percent in ((1, 85), (2, 80)):
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, n, percent).collect()]
        assert sorted(got, key=repr) == brute(rows, n, percent)


def test_plan_covers_every_pair():
    for percent in (60, 80, 85, 95):
        plan = J.Plan(percent)
        for size in list(range(1, 200)) + [1000, 54321]:
            partner = size * 100 // percent
            bands = [{int(b) for _, bs in plan.bands(np.array([x])) for b in bs} for x in (size, partner)]
            assert bands[0] & bands[1] or size * (100 - percent) // percent == 0


def test_empty(nothing, docs):
    assert J.near_duplicates(nothing).count() == 0
    assert J.keep_one(nothing).columns == docs.columns


def test_null_ids_and_equal_ids(spark):
    """Copies without an id don't hide a class; texts of one id stay apart, and their components merge."""
    rng = random.Random(21)
    a, b, c, d = ([f"{x}{rng.randrange(500)}" for _ in range(60)] for x in "abcd")
    near = lambda w: " ".join([*w[:30], "other", *w[31:]])
    rows = [(None, " ".join(a)), (None, " ".join(a)), (1, " ".join(a)), (2, near(a)), (None, " ".join(b)), (None, near(b)), (3, near(b))]
    rows += [(4, " ".join(c)), (4, " ".join(d)), (5, near(c)), (6, near(d))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, 4, 80).collect()]
    assert {(x, z) for x, _, z in got if x is not None} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4)}
    assert sorted(got, key=repr) == brute(rows, 4, 80)
    assert {r["doc_id"] for r in J.keep_one(df).collect()} == {None, 1, 3, 4}


def test_keep_one_judges_rows(spark):
    """Equal rows become one, near copies of one id too; other texts of that id and rows without an id stay."""
    rng = random.Random(22)
    a, b, c = ([f"{x}{rng.randrange(500)}" for _ in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:30], "other", *w[31:]])
    rows = [(1, " ".join(a)), (1, " ".join(a)), (1, " ".join(a)), (2, " ".join(a)), (3, near(a)), (4, " ".join(b)), (4, near(b)), (4, " ".join(c))]
    rows += [(None, " ".join(a)), (None, " ".join(a)), (5, ""), (5, ""), (6, None), (7, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, `__row` int").repartition(3)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(x for x, _ in got if x is not None) == [1, 4, 4, 5, 6, 7] and sum(x is None for x, _ in got) == 2
    assert {t for x, t in got if x == 4} & {" ".join(c)}


@pytest.mark.parametrize("seed", range(2))
def test_random_null_and_repeated_ids(spark, seed):
    rng = random.Random(seed)
    bases, rows = [[f"{x}{rng.randrange(300)}" for _ in range(50)] for x in "abcd"], []
    for _ in range(120):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 9))):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        rows.append((rng.choice((None, None, 3, 4, rng.randrange(60))), " ".join(w[: rng.choice((50, 50, 3, 45))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, 4, 85).collect()]
    assert sorted(got, key=repr) == brute(rows, 4, 85)


def test_keep_one(docs, corpus):
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute(corpus, 5, 80) if d is not None and d == c}
    assert {r["doc_id"] for r in kept.collect()} - {None} == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = {
        0: [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)],
        1: [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(500, 500 + i) for i in range(40)] + [(900 - i, 900) for i in range(40)],
        2: [(9, 3), (9, 5), (5, 3), (20, 3), (20, 21), (50, 50)],
    }[seed]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


@pytest.mark.parametrize("names", [("row", "key", "gone"), ("__key", "__gone", "__mark"), ("mark", "id", "set_class"), ("a.b", "c`d", "component")])
def test_keep_one_leaves_columns_alone(spark, corpus, names):
    """Whatever other columns are called, they come back as they were."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in names]])
    rows = [(i, t, f"x{i}", None, f"z{len(t or '')}") for i, t in corpus]
    kept = J.keep_one(spark.createDataFrame(rows, schema).repartition(3))
    assert kept.columns == ["doc_id", "text", *names]
    found = [tuple(r) for r in kept.collect()]
    assert set(found) <= set(rows)
    plain = J.keep_one(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert sorted((repr(r[0]), r[1] or "") for r in found) == sorted((repr(r[0]), r[1] or "") for r in plain.collect())
