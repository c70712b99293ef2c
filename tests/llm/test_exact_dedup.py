import hashlib
import random

import pytest
from pyspark.sql import functions as F

from locusforge.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def brute(rows, keep, normal=lambda t: t):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(known) if known else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, best, len(ids), sha) for i in ids]
    return sorted(out, key=repr), {t: None for t in groups}


def table():
    rng = random.Random(7)
    lead = "the same beginning of many texts " * 3
    rows = [(i, rng.choice([None, "", "hot", lead + "a", lead + "b", lead + str(i), f"own {i % 60}", "é", "é", " hot"])) for i in range(400)]
    rows += [(1000 + i, "hot") for i in range(600)]  # a group that spans partitions
    rows += [(2000, "x" * 200_000), (2001, "x" * 200_000), (2002, "x" * 199_999 + "y"), (None, "hot"), (None, "alone"), (None, None), (5, "hot"), (5, "hot"), (1001, "hot")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_against_brute_force(spark, keep, batch):
    rows = table()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, t, True, "s") for i, t in rows], "doc_id long, text string, kept boolean, keep_id string").repartition(9)
        found = exact_duplicates(df, keep=keep).collect()
        want, groups = brute(rows, keep)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == want
        kept = [r for r in found if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
        left = drop_exact_duplicates(df, keep=keep)
        assert left.columns == df.columns and left.count() == len(groups)
        assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((r.doc_id for r in kept), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_normalised_texts_and_no_rows(spark):
    rows = [(1, "A  b"), (2, "a b"), (3, "a B "), (4, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(df, normalize=tidy).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1)}
    assert exact_duplicates(df.limit(0)).count() == 0 and drop_exact_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(df, keep="first")


def test_dotted_and_clashing_names(spark):
    df = spark.createDataFrame([(2, "a", 1), (1, "a", 2), (3, None, 3), (4, "", 4)], "`i.d` long, `t.x` string, x_text int")
    kept = drop_exact_duplicates(df, text_col="t.x", id_col="i.d")
    assert kept.columns == df.columns and sorted(r["i.d"] for r in kept.collect()) == [1, 3]
