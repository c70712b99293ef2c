import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from locusforge.llm import registry
from locusforge.llm.toxicity import Machine, drop_toxic, fit, fit_machine, pair_slopes, score, sigmoid, term_buckets


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(n):
        words = rng.choices(filler, k=30)
        kind = i % 4  # the insult counts as toxic only beside the group, and the group is named elsewhere too
        if kind in (0, 1):
            words[3] = "zorgling"
        if kind in (0, 2):
            words[9] = "martians"
        rows.append((i, " ".join(words), int(kind == 0)))
    return rows


def test_pairs_of_uneven_words_are_learned(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id % 3 > 0"))
    got = {r.doc_id: r.toxicity for r in score(df.select("doc_id", "text"), machine).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    assert np.abs(machine.factors).max() > 0.1


def test_pairs_are_learned_that_weights_alone_miss(spark):
    """Toxic is one of two words without the other: each word is even between the labels, and no linear score is right."""
    rows = [(i, t, int(("zorgling" in t) != ("martians" in t))) for i, t, _ in corpus(900, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id % 3 > 0"))
    got = {r.doc_id: r.toxicity for r in score(df.select("doc_id", "text"), machine).collect()}
    held = [(got[i], y, t) for i, t, y in rows if i % 3 == 0]
    assert np.mean([(s >= 0.5) == y for s, y, _ in held]) > 0.97
    x = np.array([["zorgling" in t, "martians" in t, True] for _, t, _ in rows], float)
    y = np.array([k for *_, k in rows])
    linear = np.linalg.lstsq(x, y - 0.5, rcond=None)[0]
    assert np.mean((x @ linear > 0) == y) < 0.8


def test_pair_slopes_match_a_loop():
    rng = np.random.default_rng(3)
    documents = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(1500)]
    errors = rng.uniform(-1, 1, 1500)
    z, both = pair_slopes(documents, errors, 6)
    for a in range(6):
        for b in range(6):
            e = np.array([errors[i] for i, d in enumerate(documents) if a in d and b in d])
            assert both[a, b] == len(e)
            assert np.isclose(z[a, b], e.sum() / np.sqrt((np.abs(e) * (1 - np.abs(e))).sum() + 0.5), atol=1e-3)


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t, _ in corpus(300, 9)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus(300, 9)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    in_test = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    machine = fit(df, labels.where(F.col("doc_id").isin([i for i, *_ in rows if not in_test(i)])))
    place = {int(b): i for i, b in enumerate(machine.buckets)}
    got = {r.doc_id: r for r in registry.op2_toxicity(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, t, *_ in rows:
        own = sorted({place[b] for w in set(re.findall("[a-z]+", t or "")) for b in term_buckets(w.encode()) if b in place})
        logit = machine.bias + sum(float(machine.weights[k]) for k in own)
        logit += sum(float(machine.factors[a] @ machine.factors[b]) for x, a in enumerate(own) for b in own[:x])
        want = 1 / (1 + math.exp(-logit))
        assert math.isclose(got[i].score, want, abs_tol=1e-5) and got[i].held_out == in_test(i)
        assert got[i].predicted == (got[i].score >= 0.5)


def test_dotted_and_clashing_names(spark):
    rows = corpus(200)
    df = spark.createDataFrame([(i, t, y, 5) for i, t, y in rows], "`a.id` long, `b.text` string, toxicity int, x_toxicity int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "`a.id` long, `c.y` int")
    machine = fit(df, labels, text_col="b.text", id_col="a.id", label_col="c.y")
    kept = drop_toxic(df, machine, text_col="b.text")
    assert kept.columns == df.columns and sorted(r["a.id"] for r in kept.collect()) == [i for i, _, y in rows if not y]
    assert {r.x_toxicity for r in kept.collect()} == {5}


def test_logit_is_the_second_order_model():
    rng = np.random.default_rng(0)
    m = Machine(np.arange(5), 0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    at = np.array([0, 2, 4])
    pairs = sum(m.factors[i] @ m.factors[j] for i in at for j in at if i < j)
    assert np.isclose(m.logit(at), 0.3 + m.weights[at].sum() + pairs)


def test_odd_rows_and_columns(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "idiot " * 60_000, 7), (None, "fine words", 8), (3, "idiot", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity int").selectExpr("*", "1.5D as score", "'a' as c_0")
    none = fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.toxicity < 0.5 for r in score(df, none).collect())
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (None, 1), (4, 7)], "doc_id long, toxic int")
    machine = fit(df, labels)
    out = score(df, machine)
    assert out.columns == ["doc_id", "text", "score", "c_0", "toxicity"]
    assert out.count() == 5 and all(0 <= r.toxicity <= 1 for r in out.collect())
    kept = drop_toxic(df, machine)
    assert kept.columns == df.columns
    assert sorted(r.toxicity for r in kept.collect()) == sorted(a for a, r in zip([5, 6, 7, 8, 9], sorted(out.collect(), key=lambda r: [x[1] for x in rows].index(r.text))) if r.toxicity < 0.5)
    assert score(df.limit(0), machine).count() == 0


def test_fit_without_terms():
    m = fit_machine(np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 4, np.array([0, 0, 0, 1.0]))
    assert np.isclose(sigmoid(m.bias), 0.25)
