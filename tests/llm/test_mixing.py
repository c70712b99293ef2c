import random
from collections import Counter, defaultdict

import pytest

from locusforge.llm.mixing import mix, mixture


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    full, target = set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        full |= over


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(900):
        source = rng.choice(["a", "b", "b", "b", "b", "c", None, "tiny" if i % 40 == 0 else "é"])
        out.append((i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 80))) or None, source))
    return [*out, (2000, "long " * 5000, "b"), (2001, None, "void"), (2002, "  x　y ", "c"), (None, "no id here", "a"), (5, "again", "a")]


def test_targets_and_nearness(spark, rows):
    df = spark.createDataFrame([(i, t, s, "x", 0) for i, t, s in rows], "doc_id long, text string, source string, target string, taken int")
    got = mixture(df).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert {(r.doc_id, r.size) for r in got} >= {(2002, 1), (2001, 0)}
    again = {(r.doc_id, r.size): r.taken for r in mixture(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in got}
    copies = Counter((r.doc_id, r.text) for r in mix(df).collect())
    by_id = {r.doc_id: r.copies for r in got}
    assert all(n == by_id[i] for (i, _), n in copies.items() if i != 5) and mix(df).columns == df.columns


def test_shares_vary_with_the_draw(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = ({r.doc_id for r in mixture(df, seed=s).where("copies > 0").collect()} for s in (1, 2))
    assert a != b


def test_one_source_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (2, "d", "s")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken) for r in mixture(df).collect()) == [(1, 3), (2, 1)]
    assert mixture(df.limit(0)).count() == 0 and mix(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert [r.taken for r in mixture(blank).collect()] == [0, 0]


def test_dotted_and_clashing_names(spark):
    rows = [(i, f"{'w ' * (1 + i % 5)}", f"s{i % 3}", i, "r") for i in range(60)]
    df = spark.createDataFrame(rows, "`a.id` long, `b.text` string, `c.src` string, number int, x_row string")
    names = {"text_col": "b.text", "id_col": "a.id", "source_col": "c.src"}
    want = {r.doc_id: r.copies for r in mixture(df, **names).collect()}
    got = mix(df, **names)
    assert got.columns == df.columns and {i: sum(r["a.id"] == i for r in got.collect()) for i in want} == want
