"""The similarity stage against brute force over whole shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from locusforge.llm import set_join
from locusforge.llm.set_join import similar_links, verified_forest
from locusforge.llm.simhash import drop_near_duplicates, near_duplicates, shingle_hashes


def five(text):
    return frozenset(shingle_hashes(text, 5, 42))


def want_of(rows, similarity=0.8):
    """Least identifier of each document's component by all pairs."""
    sets = [five(t) for _, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for at, (i, _) in enumerate(rows):
        for b in range(at):
            common = len(sets[at] & sets[b])
            if sets[at] == sets[b] or common and common >= similarity * (len(sets[at]) + len(sets[b]) - common) - 1e-9:
                x, y = sorted((root(i), root(rows[b][0])))
                label[y] = x
    return {i: root(i) for i, _ in rows}


def copies(rng, n, changes, length=300):
    base = [f"w{rng.randrange(9000)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(length), rng.choice(changes)):
            words[at] = f"z{rng.randrange(9000)}"
        out.append(" ".join(words))
    return out


def found_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in near_duplicates(df, words=5, similarity=0.8).collect()}


def test_a_group_of_1000_near_copies_links_as_all_its_pairs_do(spark):
    rows = list(enumerate(copies(random.Random(3), 1000, (6,))))
    random.Random(4).shuffle(rows)
    want = want_of(rows)
    assert found_of(spark, rows) == want and len(set(want.values())) < 20


@pytest.fixture
def mixed():
    rng = random.Random(17)
    texts = [t for _ in range(40) for t in copies(rng, 3, (1, 4, 6, 7, 9), rng.choice((60, 300)))]
    texts += ["x y", "X  y", "a b c d e", "a b c d e f", "", None]
    return list(enumerate(texts))



@pytest.mark.parametrize("paired,block", [(8, 1024), (2, 3), (2, 1024), (4, 1)])
def test_similar_pairs_are_linked_whatever_the_bounds(spark, mixed, monkeypatch, paired, block):
    monkeypatch.setattr("locusforge.llm.simhash.similar_links", lambda *a: similar_links(*a, paired=paired, block=block))
    got, want = found_of(spark, mixed), want_of([(i, t or "") for i, t in mixed])
    assert all(want[i] == want[c] for i, c in got.items())  # never a false link
    assert sum(got[i] == c for i, c in want.items()) >= 0.97 * len(want)


def test_entries_meet_for_every_pair_within_fifteen_bits():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, (300, 4)).astype(np.uint64)
    b = a.copy()
    for row in b:
        for bit in rng.choice(256, rng.integers(0, 16), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    key = lambda wide: (set_join.entries(wide) >> np.uint64(24)).tolist()
    assert all(set(x) & set(y) for x, y in zip(key(a), key(b)))


def test_buckets_meet_as_by_brute_force_however_batches_are_cut():
    rng = np.random.default_rng(7)
    wide = rng.integers(0, 1 << 63, (30, 4)).astype(np.uint64)
    wide = np.concatenate([wide, *[wide[:12] ^ (np.uint64(1) << rng.integers(0, 64, (12, 4)).astype(np.uint64)) for _ in range(6)]])
    keys = set_join.entries(wide)
    flat, bag = keys.ravel(), np.repeat(np.arange(len(wide)), keys.shape[1])
    order = np.lexsort((bag, flat.view(np.int64)))
    flat, bag = flat[order], bag[order]
    want, chained = set(), []
    for k in np.unique(flat >> np.uint64(24)):
        own = bag[flat >> np.uint64(24) == k]
        if len(own) > 4:
            chained.append(set(own.tolist()))
            continue
        for i in own:
            for j in own:
                if i < j:
                    want.add((i, j))
    for step in (1, 7, 1 << 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(flat[i : i + step].view(np.int64)), pa.array(bag[i : i + step])], names=["key", "bag"]) for i in range(0, len(flat), step)]
        got, links = set(), set()
        for out in set_join._meet(4)(iter(batches)):
            for a, b, crowded in zip(*(c.to_pylist() for c in out.columns)):
                (links if crowded else got).add((a, b))
        assert got <= want
        far = lambda i, j: np.bitwise_count(wide[i] ^ wide[j]).sum() > 15
        assert all(far(i, j) or (i, j) in got or any({i, j} <= c for c in chained) for i, j in want)
        label = list(range(len(wide)))
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        assert all(len({label[i] for i in c}) == 1 for c in chained)


def test_thinned_stars_connect_what_they_did():
    rng = np.random.default_rng(8)
    links = sorted({(int(c), int(x)) for c in range(6) for x in rng.integers(6, 400, 150)} | {(0, 3), (2, 5)}, key=lambda l: (l[1], l[0]))
    links += [(500, 501)]
    def parts(pairs):
        label = {x: x for p in pairs for x in p}
        for i, j in pairs:
            old, new = label[j], label[i]
            label = {x: new if k == old else k for x, k in label.items()}
        return sorted(sorted(x for x in label if label[x] == k) for k in set(label.values()))
    for step in (1, 13, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in part]), pa.array([b for _, b in part]), pa.array([a < 500 for a, _ in part])], names=["a", "b", "crowded"]) for part in (links[i : i + step] for i in range(0, len(links), step))]
        out = [x for o in set_join._thinned(iter(batches)) for x in zip(*(c.to_pylist() for c in o.columns))]
        assert parts([x[:2] for x in out]) == parts(links) and len(out) < 0.6 * len(links) and (500, 501, False) in out


def test_recall_on_pairs_near_the_similarity(spark):
    """Word edits at random places that leave similarities between 0.8 and 0.85, the hardest to find."""
    rng, rows = random.Random(23), []
    while len(rows) < 300:
        length = rng.choice((80, 200, 500))
        a, b = copies(rng, 1, (max(1, round(length * 0.02)),), length)
        x, y = five(a), five(b)
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = found_of(spark, rows)
    assert sum(got[i + 1] == i for i in range(0, len(rows), 2)) >= 0.95 * len(rows) / 2


def test_clashing_and_dotted_names(spark):
    a, b = copies(random.Random(12), 1, (3,))
    df = spark.createDataFrame([(1, a, 5, "u"), (2, b, 6, "v"), (3, None, 7, "w")], "`id.x` long, `the.text` string, stays int, doc_id string")
    kept = drop_near_duplicates(df, text_col="the.text", id_col="id.x", words=5, similarity=0.8)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == ["u", "w"]


def test_equal_fingerprints_alone_do_not_link(spark):
    rows = [(1, "w " * 3000), (2, "w " * 200 + " ".join(f"other{k}" for k in range(15))), (3, "W\n" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(df, words=5, similarity=0.8).collect()
    assert len({r.fp for r in found}) == 1
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 1}
    assert sorted(r.doc_id for r in drop_near_duplicates(df, words=5, similarity=0.8).collect()) == [1, 2]


def test_rows_without_or_with_repeated_identifiers_count_with_their_own_texts(spark):
    a, b = copies(random.Random(9), 1, (3,))
    c, d = copies(random.Random(10), 1, (3,))
    df = spark.createDataFrame([(1, a), (5, b), (5, c), (7, d), (None, d)], "doc_id long, text string")
    found = sorted(((r.doc_id or 0), r.component_id) for r in near_duplicates(df, words=5, similarity=0.8).collect())
    assert found == [(0, 5), (1, 1), (5, 1), (5, 5), (7, 5)]


def test_verified_forest_does_not_lose_links_to_failed_ones():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(0, 1 << 62, k).astype(np.uint64)])) for k in (0, 5, 10, 30, 60, 60)]
    links = verified_forest(sets, 0.8)
    assert {frozenset(x) for x in links} == {frozenset((0, 1)), frozenset((0, 2))}
