import random

import numpy as np
import pytest
import xxhash

from locusforge.llm.components import components
from locusforge.llm.simhash import drop_near_duplicates, fingerprint_links, near_duplicates, spanning_links, variant_masks


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, distance):
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(values))]


def near_values(seed, n=120):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(20)}
    while len(values) < n:
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 6)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    return sorted(values)


@pytest.mark.parametrize("distance,segments", [(4, 3), (4, 4), (4, 5), (4, 6), (3, 3), (2, 2)])
def test_masks_meet_for_every_close_pair(distance, segments):
    rng = random.Random(segments)
    masks = variant_masks(distance, segments)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, distance)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_spanning_links_keep_the_components():
    values = near_values(3)
    links = spanning_links(np.array(values, np.uint64), 4)
    assert len(links) < len(values)
    label = {v: v for v in values}
    for _ in values:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = classes(values, 4)
    assert [values[w] for w in want] == [label[v] for v in values]


@pytest.mark.parametrize("segments,limit", [(3, 1 << 16), (6, 1 << 16), (3, 4)])
def test_links_match_brute_force_with_and_without_crowded_buckets(spark, segments, limit):
    values = near_values(segments + limit, 80)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), segments=segments, bucket_rows=limit).collect()
    known = {v % (1 << 64): i for i, v in enumerate(signed)}
    label = list(range(len(values)))
    for _ in values:
        for a, b in rows:
            i, j = known[a % (1 << 64)], known[b % (1 << 64)]
            label[i] = label[j] = min(label[i], label[j])
    assert label == classes(values, 4)


def texts():
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(400)]
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one  TWO"), (6, "x" * 50_000), (7, " ".join(base * 20))]
    for i in range(10, 40):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(400)] = "new"
        out.append((i, " ".join(words)))
    return [*out, (40, out[-1][1]), (40, out[-1][1]), (50, "Éa b c d e f"), (51, "éa b c d e f"), (None, "One two"), (None, "alone in here now yes")]


def test_query_matches_brute_force(spark):
    rows = texts()
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = classes(fps, 4)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(((i, f, least.get(g)) for (i, _), f, g in zip(rows, fps, groups)), key=repr)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_duplicates(df).collect()), key=repr)
    assert got == want
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for (i, _), g in zip(rows, groups) if i is not None and least[g] == i)
    assert kept.where("doc_id is null").count() == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:]), (100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def jaccard(a, b, n=5):
    x, y = ({tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def test_similarity_confirms_links(spark):
    rng = random.Random(8)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(9000)}" for _ in range(300)]
        rows.append((base * 10, " ".join(words)))
        for k, changes in enumerate((1, 3, 6, 14, 30)):
            edited = list(words)
            for at in rng.sample(range(300), changes):
                edited[at] = f"z{rng.randrange(9000)}"
            rows.append((base * 10 + 1 + k, " ".join(edited)))
    text = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1 << 16, 8):
        found = {r.doc_id: r.component_id for r in near_duplicates(df, words=5, distance=10, similarity=0.8, bucket_rows=limit).collect()}
        close = [i for i in text if i % 10 in (1, 2, 3) and jaccard(text[i], text[i - i % 10]) >= 0.8]
        assert sum(found[i] == i - i % 10 for i in close) >= 0.85 * len(close)
        assert all(found[i] == i for i in text if i % 10 == 5)


def test_tiles_link_as_brute_force_does(spark):
    values = near_values(21, 60)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance=10, bucket_rows=3).collect()
    known = {s: i for i, s in enumerate(signed)}
    label = list(range(len(values)))
    for _ in values:
        for a, b in rows:
            i, j = known[a], known[b]
            label[i] = label[j] = min(label[i], label[j])
    assert label == classes(values, 10)
