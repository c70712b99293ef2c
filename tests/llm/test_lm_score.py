import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from locusforge.llm import lm_score as L
from locusforge.llm.attention import PIECE_WINDOWS, Adam, _sum_inputs, copy_of, in_pieces, log_probabilities, loss_and_gradient, make_tree, new_attention
from locusforge.llm.lm_score import averaged, make_ranks, score, score_sequences, windows

OPTIONS = {"tokenizer_path": P.path("byte_bpe_multi_50k.tiktoken"), "pattern": P.PATTERN}
COUNTS = np.array([50, 30, 10, 0, 3, 8, 1, 0, 2])  # of eight ids and, last, the end


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    counts = np.array([9, 5, 4, 2, 1, 1, 0, 0])
    tree = make_tree(counts)
    m = new_attention(tree, counts.astype(float), width=4, inner=3, window=5, dtype=np.float64, seed=3)
    x, b, y, w = rng.integers(0, 9, (3, 5)), rng.integers(0, 9, (3, 5)), rng.integers(0, 8, (3, 5)), rng.random((3, 5)) < 0.7
    b[:, 1:] = x[:, :-1]
    loss, slope = loss_and_gradient(m, tree, x, b, y, w)
    flat = m.flat()
    near = [(loss_and_gradient(m.like(flat + 1e-6 * (np.arange(len(flat)) == i)), tree, x, b, y, w)[0] - loss) / 1e-6 for i in range(len(flat))]
    assert np.allclose(near, slope.flat(), atol=1e-5)


def test_trees_hold_every_rank_once_in_few_classes():
    rng = np.random.default_rng(5)
    for counts in ([], [0], [4], [4, 0, 0], sorted(rng.zipf(1.2, 900) % 10_000, reverse=True), [1] * 500 + [0] * 40):
        tree = make_tree(np.array(counts, np.int64))
        assert len(tree.of) == len(counts) and tree.seen == sum(c > 0 for c in counts)
        sizes = np.diff(tree.first)[: None if tree.seen == len(counts) else -1]
        assert sizes.sum() == tree.seen and (not len(sizes) or max(len(sizes), sizes.max()) <= 2 * math.sqrt(tree.seen) + 1)


def test_pieces_of_a_batch_add_up_in_less_memory(monkeypatch):
    rng = np.random.default_rng(2)
    counts = np.sort(rng.zipf(1.3, 900) % 5000 + 1)[::-1]
    tree = make_tree(counts)
    m = new_attention(tree, counts.astype(float), seed=3, dtype=np.float64)
    batch = [rng.integers(0, 900, (2 * PIECE_WINDOWS + 70, 32)) for _ in range(3)]
    batch += [rng.random(batch[0].shape) < rng.random((len(batch[0]), 1))]  # pieces that differ in how many count
    batch[1][:, 1:] = batch[0][:, :-1]
    (loss, slope), (want, of_all) = in_pieces(m, tree, *batch), loss_and_gradient(m, tree, *batch)
    assert math.isclose(loss, want) and np.allclose(slope.flat(), of_all.flat(), atol=1e-12)

    def peak() -> int:
        adam = Adam(copy_of(m), tree)
        tracemalloc.start()
        adam.step(*batch)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return held

    small = peak()
    monkeypatch.setattr("locusforge.llm.attention.PIECE_WINDOWS", len(batch[0]))
    assert small < 0.7 * peak()
    nothing = [*batch[:3], np.zeros(batch[0].shape, bool)]
    assert in_pieces(m, tree, *nothing)[0] == 0 and not in_pieces(m, tree, *nothing)[1].u2.any()


def test_words_are_split_at_ascii_white_space_only():
    texts = [" a  B\tc\x0bD\x0ce\r\n ", "", None, "  \n", "x\u00a0Y \u00c9\u0130", "\x1c\x1d a\x85b\u2003c", "Z" * 70 + " z\x00z", "A"]
    want = [(t or "").encode().lower().split() for t in texts]
    for column in (pa.array(texts), pa.array(["q q", *texts, "r"])[1:-1], pa.array(texts, pa.large_string())):
        words, sizes = L.split_words(column)
        assert L._bytes_each(words) == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
        assert L._bytes_each(words[2:5]) == [w for x in want for w in x][2:5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    counts = Counter()
    for part in L._word_counts(iter([batch, batch.slice(0, 0), batch.slice(3)])):
        for r in part.to_pylist():
            counts[r["word"].encode()] += r["n"]
    assert counts == Counter(L.key_of(w) for x in [*want, *want[3:]] for w in [*x, b""])
    assert not list(L._word_counts(iter([])))


def test_words_spelled_together_are_spelled_as_alone():
    described = L.description(*OPTIONS.values())
    words = [w.encode() for w in ["plain", "na\u00efve", "\u00a0", "a\u2003b", "x\u200by", "\u65e5\u672c", "tab\u0001", "\u00e9", "...", "1234567"]]
    for some in (words, words[:2], words[5:6] + words[7:]):
        flat, lengths = L._spelled(some, described)
        each = [L._spelled([w], described)[0].tolist() for w in some]
        assert flat.tolist() == [i for x in each for i in x] and lengths.tolist() == [len(x) for x in each]


def test_merges_of_many_words_spell_as_the_tokenizer(monkeypatch):
    described = L.description(*OPTIONS.values())
    rng = random.Random(6)
    words = ["".join(rng.choices("aaabnth01#$.'_-\u00e9\u00fc\u00df\u00d7\u00f7\u00ff\u65e5\u0100", k=rng.randrange(1, 40))) for _ in range(3000)]
    words += ["".join(chr(rng.randrange(33, 127)) for _ in range(rng.randrange(1, 33))) for _ in range(3000)]
    words += [c * n for c in "a~e0\u00e9" for n in range(1, 40)] + ["can't", "'s", "x's", "\x01", "\x7f", "a\u00a0b"]
    want = L._spelled([w.encode() for w in words], described)
    column = pa.array(["?", *words])[1:]
    for got in (L.spell(column, described), [np.concatenate(x) for x in zip(*(L.spell(column.slice(i, 500), described) for i in range(0, len(words), 500)))]):
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert not len(L.spell(column[:0], described)[0])
    monkeypatch.setattr(L, "_spelled", lambda *_: pytest.fail("plain words need no tokenizer"))
    L.spell(pa.array(["plain", "na\u00efve", "x1,y", "...", "blethtion###"]), described)
    other = L.description(OPTIONS["tokenizer_path"], r"\S+|\s+")
    assert L._merges(other) is None


def test_slopes_add_up_by_input_and_by_the_one_before():
    rng = np.random.default_rng(3)
    for n, t, size in ((40, 8, 5), (1, 1, 3), (30, 32, 70_000)):
        inputs, before = rng.integers(0, size, (n, t)), rng.integers(0, size, (n, t))
        before[:, 1:] = inputs[:, :-1]
        dx = rng.normal(size=(n, t, 4))
        slopes = np.zeros((n * (t + 1) + 1, 4))
        slopes[:-1].reshape(n, t + 1, 4)[:, 1:] = dx
        want = np.zeros((2, size, 4))
        np.add.at(want[0], inputs, dx)
        np.add.at(want[1], before, dx)
        assert np.allclose(_sum_inputs(slopes, inputs, before, size), want)


def test_windows_count_every_token_once_and_match_a_plain_loop():
    ranks, by_rank = make_ranks(COUNTS)
    m = new_attention(ranks.tree, by_rank.astype(float), width=4, inner=4, window=8, seed=2)
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 8, n).astype(np.uint16) for n in (0, 1, 6, 7, 8, 40)]
    flat, lengths = np.concatenate(sequences), np.array([len(s) for s in sequences])
    for stride, together in ((5, 3), (8, 100)):
        parts = list(windows(ranks, flat, lengths, 8, stride, together))
        assert sum(w.sum() for *_, w in parts) == len(flat) + len(lengths)
        for k, s in enumerate(sequences):
            assert [r for o, _, _, y, w in parts for i in np.flatnonzero(o == k) for r in y[i][w[i]]] == [*ranks.of_id[s], ranks.end]
    got = score_sequences(m, ranks, flat, lengths, 5)
    for sequence, value in zip(sequences, got):
        y = [*ranks.of_id[sequence], ranks.end]
        x = [ranks.unseen + 1, *[min(r, ranks.unseen) for r in y[:-1]]]
        b = [ranks.unseen + 2, *x[:-1]]
        total = 0.0
        for i in range(len(y)):  # one place at a time, from its own past only
            end = 8 + 5 * max(0, -(-(i + 1 - 8) // 5))
            low = max(0, min(len(y), end) - 8)
            total += log_probabilities(m, ranks.tree, *(np.array([z[low : i + 1]]) for z in (x, b, y)), np.arange(low, i + 1)[None] == i)[0]
        assert math.isclose(total, value, rel_tol=1e-4, abs_tol=1e-4)


def test_probabilities_sum_to_one():
    ranks, by_rank = make_ranks(COUNTS)
    m = new_attention(ranks.tree, by_rank.astype(float), width=4, inner=4, window=3, seed=2)
    each = [log_probabilities(m, ranks.tree, np.array([[6, 1]]), np.array([[7, 6]]), np.array([[0, y]]), np.array([[False, True]]))[0] for y in range(9)]
    assert np.isclose(np.exp(each).sum(), 1, atol=1e-5)


def test_training_learns_an_order():
    rng = np.random.default_rng(0)
    counts = np.ones(9, np.int64)
    tree = make_tree(counts)
    m = new_attention(tree, counts.astype(float), width=8, inner=8, window=12, seed=1)
    adam = Adam(m, tree, 2e-2)
    for _ in range(150):
        x = (rng.integers(0, 9, (32, 1)) + np.arange(14)) % 9
        loss = adam.step(x[:, 1:-1], x[:, :-2], x[:, 2:], np.ones((32, 12), bool))
    assert loss < 0.1


def test_weights_are_averaged_by_the_windows_seen(spark):
    rng = np.random.default_rng(4)
    models = [(p, rng.normal(size=10_000), n) for p, n in enumerate((3, 1, 70))]
    blocks = [(b, p % 2, (w * n)[at : at + 4096].tobytes(), float(n)) for p, w, n in models for b, at in enumerate(range(0, 10_000, 4096))]
    got = averaged(spark.createDataFrame(blocks, L._BLOCKS).repartition(5))
    assert np.allclose(got, sum(w * n for _, w, n in models) / 74)
    assert averaged(spark.createDataFrame([], L._BLOCKS)) is None


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, " ".join(rng.choices(["The", "the", "cat", "sat", "ON", "mats.", "é", "zebra" + str(rng.randrange(400))], k=rng.randrange(60)))) for i in range(300)]
    return [*out, (900, None), (901, ""), (902, "word " * 30_000), (None, "the cat"), (5, "the"), (903, "x" * 20_000)]


@pytest.mark.parametrize("frequent", [1 << 18, 6, 0])
def test_base_matches_brute_force(spark, rows, frequent):
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_tokens int, row string")
    got = score(df, held_out(), **OPTIONS, frequent=frequent, first_windows=200, passes=1).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        want.append((str(i), held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_reruns_agree_and_fluent_text_scores_higher(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id < 300")
    extra = spark.createDataFrame([(1001, "the cat sat on the mats. the cat sat"), (1002, "qzx vkj pwq the zzyx kqj wvx mats.")], "doc_id long, text string")
    a = {r.doc_id: r.score for r in score(df.union(extra), F.col("doc_id") > 1000, **OPTIONS).collect()}
    assert a[1001] > a[1002]


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_known, r.train_tokens, r.base_score) for r in score(df, F.lit(True), **OPTIONS).collect())
    assert got == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert score(df.limit(0), F.lit(False), **OPTIONS).count() == 0


def test_every_target_of_the_training_rows_is_trained_on(spark, monkeypatch):
    """The partitions' fit gets each id and end of each training row exactly once."""
    texts = ["some words that go on " * 400, "one", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    spelled = []
    fit = L.fit
    monkeypatch.setattr(L, "fit", lambda rows, size, **options: spelled.append((rows, size)) or fit(rows, size, **options))
    assert score(df, F.lit(False), **OPTIONS, first_windows=50, passes=1).count() == 4
    rows, size = spelled[0]
    ids = [np.frombuffer(bytes(r.ids), np.uint16) for r in rows.collect()]
    counts = np.bincount(np.concatenate(ids), minlength=size + 1)
    counts[size] = len(ids)
    ranks, _ = make_ranks(counts)
    met = np.concatenate([y[w] for *_, y, w in windows(ranks, np.concatenate(ids), np.array([len(x) for x in ids]), L.WINDOW, L.WINDOW, L.BATCH_WINDOWS)])
    assert np.array_equal(np.bincount(met, minlength=size + 1), counts[np.argsort(-counts, kind="stable")])


def test_long_words_have_keys_and_can_be_frequent(spark):
    long = "y" * 5000
    df = spark.createDataFrame([(i, f"{long} a {'z' * 65 if i % 2 else 'b'}") for i in range(40)], "doc_id long, text string")
    table = L.frequent_words(L.word_counts(df.select("text")), 3)
    assert L.key_of(long.encode()).decode() in table.column("word").to_pylist()
    got = score(df, F.lit(False), **OPTIONS, first_windows=50, passes=1).collect()
    n, v = 160, 5
    for r in got:
        want = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in (40, 40, 20, 40))
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.n_known == 4


def test_held_out_text_is_scored_above_the_base(spark):
    """Words of random syllables in two languages, as in made-up corpora: most words are rare, their ids are not."""
    rng = random.Random(8)
    syllables = [["ka", "lo", "mi", "tun", "res", "po", "vel", "an"], ["zu", "gra", "eth", "ish", "om", "bri", "dof", "ner"]]
    docs = []
    for i in range(600):
        own = syllables[i % 2]
        docs.append((i, " ".join("".join(rng.choices(own, k=rng.randint(1, 5))) for _ in range(120))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    got = [r for r in score(df, held_out(), **OPTIONS).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
