import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusforge.functions import tails
from locusforge.functions.labels import length_ranks, natural_key, natural_key_column, positional_index
from locusforge.model import Genotypes, impute_major, major_calls
from locusforge.operators import plotdata, quality, statistics


def results(spark, values):
    return spark.createDataFrame([(i, p) for i, p in enumerate(values)], "marker_idx long, p double")


def test_tails():
    x = np.linspace(0, 20, 400)
    assert np.allclose(tails.student_tail(x, 1), 1 - 2 / math.pi * np.arctan(x))  # the Cauchy distribution
    assert np.allclose(tails.student_tail(x, 2), 1 - x / np.sqrt(2 + x * x), rtol=1e-9, atol=1e-12)
    assert np.allclose(tails.student_tail(np.array([1.0, 2.0]), 1e7), tails.normal_tail([1.0, 2.0]), rtol=1e-5)
    assert np.allclose(tails.chi2_tail([3.841458820694124]), 0.05) and np.isnan(tails.student_tail(np.nan, 9))
    assert math.isclose(tails.normal_critical(0.05), 1.959963984540054)
    at, value = tails.minimize_bounded(lambda v: (v - 0.3) ** 2 + 1, 0, 1, 1e-8)
    assert abs(at - 0.3) < 1e-6 and abs(value - 1) < 1e-9


def test_erfc_column(spark):
    xs = [0.0, 0.1, 1.0, 3.0, 8.0, 20.0]
    got = [r.e for r in spark.createDataFrame([(x,) for x in xs], "x double").select(tails.erfc_column(F.col("x")).alias("e")).collect()]
    assert np.allclose(got, [math.erfc(x) for x in xs], rtol=2e-7)


def test_bonferroni_and_fdr(spark):
    rows = statistics.bonferroni(results(spark, [0.01, 0.5, 0.02])).orderBy("marker_idx").collect()
    assert np.allclose([r.p_bonferroni for r in rows], [0.03, 1, 0.06]) and np.isclose(rows[0].threshold, 0.05 / 3)
    for f in (lambda d: statistics.benjamini_hochberg(d), lambda d: statistics.fdr_by_ranges(d, "p", 0.05, "marker_idx", d.count())):
        rows = f(results(spark, [0.001, 0.01, 0.2, 0.5])).orderBy("marker_idx").collect()
        assert np.allclose([r.p_fdr for r in rows], [0.004, 0.02, 0.26666667, 0.5]) and [r.reject for r in rows] == [True, True, False, False]


def test_fdr_forms_agree(spark):
    rng = np.random.default_rng(0)
    d = results(spark, np.round(rng.random(300), 2).tolist())
    a, b = (x.orderBy("marker_idx").select("p_fdr").toPandas().p_fdr for x in (statistics.benjamini_hochberg(d), statistics.fdr_by_ranges(d, "p", 0.05, "marker_idx", 300)))
    assert np.allclose(a, b)


def test_inflation_and_quantiles(spark):
    assert statistics.genomic_inflation(results(spark, [float("nan"), -1.0])) == 1.0
    want = np.median(tails.chi2_of_p([0.5, 0.2, 0.1])) / tails.CHI2_MEDIAN
    assert np.isclose(statistics.genomic_inflation(results(spark, [0.5, 0.2, 0.1])), want)
    assert np.isclose(statistics.genomic_inflation(results(spark, [0.5, 0.1])), np.mean(tails.chi2_of_p([0.5, 0.1])) / tails.CHI2_MEDIAN)
    rows = statistics.qq_points(results(spark, [0.5, 0.1, float("nan"), 0.0, -1.0])).orderBy("rank").collect()
    assert np.allclose([(r.expected, r.observed) for r in rows], [(1 / 3, 0.1), (2 / 3, 0.5)])
    h = statistics.qq_histogram(results(spark, np.linspace(0.001, 1, 400).tolist())).collect()
    assert sum(r.n for r in h) == 400 and all(abs(math.log10(r.expected) - r.l) < 0.12 for r in h if r.expected > 0.02)


def test_merge_pad_and_hits(spark):
    markers = spark.createDataFrame([(i, f"m{i}") for i in range(4)], "marker_idx long, marker string")
    a = spark.createDataFrame([(0, 0.05, 1.0, 0.1), (1, 0.2, 2.0, 0.1)], "marker_idx long, p double, effect double, se double")
    b = spark.createDataFrame([(0, 0.01, 3.0, 0.1), (2, 0.05, 4.0, 0.1)], "marker_idx long, p double, effect double, se double")
    merged = statistics.merge_methods(markers, {"A": a, "B": b}, with_se=True)
    assert merged.count() == 4 and merged.columns[2:] == ["A_P", "A_Effect", "A_SE", "B_P", "B_Effect", "B_SE"]
    hits = {r.marker_idx: r.Method for r in statistics.significant(merged, {"A": 0.05, "B": 0.05}).collect()}
    assert hits == {0: "A|B", 2: "B"}
    assert {r.marker_idx: r.Method for r in statistics.significant(merged, {"A": 0.05, "B": 0.05}, strict=True).collect()} == {0: "B"}
    assert statistics.pad(a, markers).where("p is null").count() == 2


def test_best_per_bin_takes_the_first_of_equals(spark):
    d = spark.createDataFrame([(5, 2.0, 1, 10), (3, 2.0, 1, 20), (4, 1.0, 2, 10), (6, None, 2, 11)], "marker_idx long, abs_t double, chrom_rank long, pos long")
    got = {r.bin: (r.marker_idx, r.abs_t) for r in statistics.best_per_bin(d, 1e6).collect()}
    assert sorted(got.values()) == [(3, 2.0), (4, 1.0)]


def test_frequencies_with_missing_calls(spark):
    g = Genotypes.from_matrix(spark, [[0, 1, -9], [2, -9, -9], [0, 1, 2]])
    rows = quality.call_counts(g).select("marker_idx", quality.maf().alias("maf")).orderBy("marker_idx").collect()
    assert np.allclose([r.maf for r in rows], [1 / 3, 0.5, 0])
    empty = Genotypes.from_matrix(spark, [[-9], [-9]])
    assert quality.call_counts(empty).select(quality.maf().alias("m")).first().m == 0


def test_minor_allele_count_filter(spark):
    m = np.zeros((50, 6), np.int8)
    m[0, 0] = 2
    m[:2, 1] = 1
    m[:5, 2] = 1
    m[:5, 3] = 2
    m[:25, 5] = 2
    g = Genotypes.from_matrix(spark, m)
    keep = lambda k: sorted(r.marker_idx for r in quality.keep_by_mac(g, k).calls.collect())
    assert keep(5) == [2, 3, 5] and keep(10) == [3, 5] and keep(0) == list(range(6))
    native = quality.filter_markers(quality.call_counts(g), min_mac=10)
    assert sorted(r.marker_idx for r in native.collect()) == [3, 5]


def test_major_calls_and_imputation(spark):
    g = np.array([[0, 0, 2, 2, -9], [1, 1, 0, -9, -9], [-9, -9, -9, -9, -9], [2, 2, 1, 0, -9]], np.int8)
    assert major_calls(g).tolist() == [0, 1, 0, 2]
    out = impute_major(Genotypes.from_matrix(spark, g.T)).matrix()
    assert (out >= 0).all() and out[4].tolist() == [0, 1, 0, 2]
    long = Genotypes.from_matrix(spark, g.T).long().withColumnRenamed("marker_idx", "marker")
    assert {(r.marker, r.sample_idx): r.dosage for r in quality.impute_long(long).collect()} == {(i, s): int(out[s, i]) for i in range(4) for s in range(5)}


def test_subsets(spark):
    m = np.arange(12).reshape(3, 4) % 3
    g = Genotypes.from_matrix(spark, m)
    assert (g.take_samples([2, 0]).matrix() == m[[2, 0]]).all()
    assert (g.columns([3, 1]) == m[:, [3, 1]]).all()
    assert (g.take_markers(spark.createDataFrame([(1,), (2,)], "marker_idx long")).matrix() == m[:, 1:3]).all()


def test_label_orders(spark):
    labels = ["chr10", "chr2", "X", "chr1", "10", "2"]
    assert sorted(labels, key=natural_key)[:2] == ["2", "10"]
    d = spark.createDataFrame([(x,) for x in labels], "c string")
    got = [r.c for r in d.orderBy(natural_key_column(F.col("c"))).collect()]
    assert got == sorted(labels, key=natural_key)
    assert length_ranks(["10", "2", "X", "1"]) == {"1": 1, "2": 2, "X": 3, "10": 4}
    rows = positional_index(spark.range(1000).withColumn("k", F.expr("pmod(hash(id), 7919)")), ["k", "id"], "at").collect()
    assert [r.id for r in sorted(rows, key=lambda r: r["at"])] == [r.id for r in sorted(rows, key=lambda r: (r.k, r.id))]


def test_layout_and_points(spark):
    markers = spark.createDataFrame([(0, "2", 100), (1, "10", 50), (2, "2", 300), (3, "10", 250)], "marker_idx long, chrom string, pos long")
    rows = plotdata.genome_layout(markers).orderBy("code").collect()
    assert [r.chrom for r in rows] == ["2", "10"] and rows[0].offset == 0 and rows[1].offset > 201
    points = plotdata.manhattan_points(results(spark, [0.1, 0.01, 0.5, 1e-8]), markers)
    x = [r.x for r in points.orderBy("code", "x").collect()]
    assert x == sorted(x) and len(x) == 4
    many = spark.range(5000).select(F.col("id").alias("marker_idx"), (F.col("id") % 50 / 25).alias("y"))
    thin = plotdata.decimate(many)
    assert thin.where("y >= 1").count() == many.where("y >= 1").count() and 800 < thin.where("y < 1").count() < 1300
    assert plotdata.capped_by_height(many, top=10, per_bin=5).count() <= 10 + 5 * 21
    assert plotdata.rmip_points(markers, spark.createDataFrame([(1, 0.5)], "marker_idx long, rmip double")).where("rmip = 0").count() == 3


@pytest.mark.parametrize("share,want", [(0.5, {1: 0.5, 2: 1.0})])
def test_resampling_share(spark, share, want):
    hits = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (2, 1)], "marker_idx long, run int")
    assert {r.marker_idx: r.rmip for r in statistics.resampling_share(hits, 2).collect()} == want
