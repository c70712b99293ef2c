import numpy as np
import pandas as pd
import pytest

from locusforge.functions.tails import normal_tail, student_tail
from locusforge.model import Genotypes
from locusforge.operators import bayes, effective, glm, mlm, multilocus, structure
from locusforge.sources.genotypes import random_genotypes
from locusforge.sources.longform import from_long


def panel(spark, n, m, seed, chroms=3, missing=0.0):
    rng = np.random.default_rng(seed)
    g = rng.binomial(2, rng.uniform(0.2, 0.5, m), (n, m)).astype(float)
    if missing:
        g[rng.random(g.shape) < missing] = np.nan
    table = pd.DataFrame({"MARKER": [f"m{i}" for i in range(m)], "CHROM": [str(1 + i * chroms // m) for i in range(m)], "POS": 1000 * (np.arange(m) + 1)})
    return Genotypes.from_matrix(spark, g, markers=table), g, rng


def ols(y, x, g):
    z = np.column_stack([np.ones(len(y)), x, g]) if x is not None else np.column_stack([np.ones(len(y)), g])
    beta, *_ = np.linalg.lstsq(z, y, rcond=None)
    df = len(y) - z.shape[1]
    s2 = ((y - z @ beta) ** 2).sum() / df
    cov = np.linalg.inv(z.T @ z) * s2
    t = abs(beta[-1] / np.sqrt(cov[-1, -1]))
    return beta[-1], np.sqrt(cov[-1, -1]), float(normal_tail(t) if df >= 50 else student_tail(np.array([t]), df)[0])


def rows(df, trait=None):
    d = df.toPandas().sort_values("marker_idx")
    return d if trait is None else d[d.trait == trait]


@pytest.mark.parametrize("n,m,seed,covariates", [(100, 10, 42, 0), (30, 4, 7, 0), (200, 5, 1337, 2)])
def test_linear_model_is_least_squares(spark, n, m, seed, covariates):
    geno, g, rng = panel(spark, n, m, seed)
    x = rng.normal(size=(n, covariates)) if covariates else None
    y = rng.normal(size=n) + 0.4 * g[:, 0]
    got = rows(glm.scan(geno, y, x))
    for i in range(m):
        assert np.allclose(got.iloc[i][["effect", "se", "p"]].astype(float), ols(y, x, g[:, i]), rtol=1e-5)


def test_traits_share_a_pass_and_flat_markers_are_not_tested(spark):
    geno, g, rng = panel(spark, 60, 6, 3)
    flat = Genotypes.from_matrix(spark, np.column_stack([g, np.ones(60)]))
    y = rng.normal(size=(60, 2))
    both = glm.scan(flat, y, traits=("a", "b"))
    for i, t in enumerate("ab"):
        one, part = rows(glm.scan(flat, y[:, i])), rows(both, t)
        assert np.allclose(one[["effect", "t", "p"]], part[["effect", "t", "p"]], rtol=1e-9)
        assert part.iloc[6].effect == 0 and part.iloc[6].p == 1 and np.isnan(part.iloc[6].se)
    with pytest.raises(ValueError):
        glm.scan(geno, np.full(60, np.nan))
    with pytest.raises(ValueError):
        glm.scan(geno.take_samples([0, 1]), np.zeros(2))


def test_native_scan_equals_marker_rows(spark):
    geno, g, rng = panel(spark, 80, 8, 5)
    y, c = rng.normal(size=80), rng.normal(size=80)
    long = spark.createDataFrame([(f"s{i}", f"m{j}", int(g[i, j])) for i in range(80) for j in range(8) if g[i, j]], "sample_id string, marker string, dosage int")
    samples = spark.createDataFrame([(f"s{i}", float(y[i]), float(c[i])) for i in range(80)], "sample_id string, y double, c double")
    native = glm.native_scan(long, samples, covariates=("c",)).toPandas().sort_values("marker")
    other = rows(glm.scan(geno, y, c[:, None]))
    assert np.allclose(native[["effect", "se", "p"]], other[["effect", "se", "p"]], rtol=1e-5)
    back = from_long(long, [f"s{i}" for i in range(80)], geno.markers)
    assert sorted(map(tuple, back.matrix().T.tolist())) == sorted(map(tuple, g.astype(int).T.tolist()))


def test_covariate_terms(spark):
    geno, g, rng = panel(spark, 90, 7, 9)
    x, y = rng.normal(size=(90, 2)), rng.normal(size=90)
    _, terms = glm.scan_with_terms(geno, y, x)
    got = {r.term: r for r in terms.collect()}
    for k in range(2):
        each = []
        for i in range(7):
            z = np.column_stack([np.ones(90), x, g[:, i]])
            beta = np.linalg.lstsq(z, y, rcond=None)[0]
            s2 = ((y - z @ beta) ** 2).sum() / (90 - 4)
            se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * s2)
            each.append((beta[k + 1], se[k + 1], abs(beta[k + 1] / se[k + 1])))
        b, s, t = map(np.array, zip(*each))
        r = got[k + 1]
        assert np.allclose([r.effect, r.se, r.least_t, r.most_t, r.mean_t], [b.mean(), np.sqrt((s**2).mean()), t.min(), t.max(), t.mean()])


def test_terms_of_each_marker(spark):
    geno, g, rng = panel(spark, 70, 4, 19)
    x, y = rng.normal(size=(70, 1)), rng.normal(size=70)
    got = {r.marker_idx: r.terms for r in glm.scan_terms(geno, y, x).collect()}
    for i in range(4):
        e, s, p = ols(y, x, g[:, i])
        assert len(got[i]) == 3 and np.allclose([got[i][2].effect, got[i][2].se, got[i][2].p], [e, s, p], rtol=1e-5)
        e, s, p = ols(y, g[:, [i]], x[:, 0])
        assert np.allclose([got[i][1].effect, got[i][1].se, got[i][1].p], [e, s, p], rtol=1e-5)


def test_history_substitution(spark):
    h = [(0, 1, 0.2, 1.0, 0.1), (0, 2, 0.1, 2.0, 0.2), (0, 3, 0.6, 3.0, 0.3), (1, 1, 0.5, 5.0, 0.5)]
    df = spark.createDataFrame(h, "marker_idx long, iteration int, p double, effect double, se double")
    for method in ("reward", "penalty", "mean", "median", "onsite"):
        got = {r.marker_idx: (r.p, r.effect, r.se) for r in multilocus.substitute_history(df, method).collect()}
        assert np.allclose(got[0], multilocus.substitute([x[2:] for x in h[:3]], method)) and np.allclose(got[1], h[3][2:])


def test_relationships(spark):
    geno, g, _ = panel(spark, 25, 120, 1, chroms=4)
    z = g - g.mean(0)
    k = z @ z.T
    assert np.allclose(structure.vanraden(geno), k / np.mean(np.diag(k)), atol=1e-12)
    loco = structure.loco_kinship(geno)
    chrom = np.array([str(1 + i * 4 // 120) for i in range(120)])
    for c in loco.chromosomes:
        o = z[:, chrom != c]
        assert np.allclose(loco.without(c), o @ o.T / np.mean(np.diag(o @ o.T)), atol=1e-8)
    again = structure.vanraden(Genotypes(geno.samples, geno.calls.repartition(7), geno.markers, True))
    assert np.allclose(again, structure.vanraden(geno), atol=1e-12)
    want = 1 - np.abs(g[:, None] - g[None]).sum(2) / (2 * 120)
    assert np.allclose(structure.ibs(geno), want)
    assert structure.validate_kinship(structure.vanraden(geno))["positive_semidefinite"]
    pcs = structure.components(geno, count=3)
    assert structure.validate_components(pcs) == {"finite": True, "orthonormal": True}
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs((pcs * u[:, :3]).sum(0)), 1) and np.allclose(structure.components_by_svd(geno, 3)[1], s[:3] ** 2 / (s**2).sum())


def test_loco_store(spark, tmp_path):
    geno, _, _ = panel(spark, 12, 30, 2)
    loco = structure.loco_kinship(geno)
    key = structure.loco_digest(30, geno.samples, None, loco.chromosomes)
    loco.save(spark, str(tmp_path / "k"), key)
    back = structure.LocoKinship.load(spark, str(tmp_path / "k"), key)
    assert np.allclose(back.total, loco.total) and structure.LocoKinship.load(spark, str(tmp_path / "k"), "other") is None
    assert structure.LocoKinship.load(spark, str(tmp_path / "none"), key) is None


def brute_mixed(y, x, g, k):
    """Generalised least squares with the covariance itself."""
    r = mlm.rotate(structure.eigen(k), y, x)
    c = mlm.variance_components(r)
    values, vectors = np.linalg.eigh(k)
    v = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T * c["vg"] + np.eye(len(y)) * c["ve"]
    inv = np.linalg.inv(v)
    z = np.column_stack([np.ones(len(y))] + ([x] if x is not None else []) + [g])
    cov = np.linalg.inv(z.T @ inv @ z)
    beta = cov @ z.T @ inv @ y
    t = abs(beta[-1] / np.sqrt(cov[-1, -1]))
    return beta[-1], np.sqrt(cov[-1, -1]), student_tail(np.array([t]), len(y) - z.shape[1])[0]


def test_mixed_model_is_generalised_least_squares(spark):
    geno, g, rng = panel(spark, 60, 40, 8)
    x = rng.normal(size=(60, 1))
    y = g[:, :10] @ rng.normal(size=10) + rng.normal(size=60)
    k = structure.vanraden(geno)
    got = rows(mlm.scan_global(geno, y, k, x))
    for i in (0, 5, 39):
        assert np.allclose(got.iloc[i][["effect", "se", "p"]].astype(float), brute_mixed(y, x, g[:, i], k), rtol=1e-5)
    loco = structure.loco_kinship(geno)
    found = rows(mlm.scan_loco(geno, y, x, loco=loco, refine=False))
    for i, c in ((0, "1"), (20, "2"), (39, "3")):
        assert np.allclose(found.iloc[i][["effect", "se", "p"]].astype(float), brute_mixed(y, x, g[:, i], loco.without(c)), rtol=1e-5)
    two = mlm.scan_loco(geno, np.column_stack([y, -y]), x, loco=loco, traits=("a", "b"), refine=False)
    assert np.allclose(rows(two, "a").effect, found.effect, rtol=1e-6) and np.allclose(rows(two, "b").effect, -found.effect, rtol=1e-6)
    with pytest.raises(NotImplementedError):
        mlm.estimate_variance_components_emma()


def test_likelihood_ratio_solvers_agree(spark):
    geno, g, rng = panel(spark, 80, 30, 4)
    y = 2.5 * g[:, 3] + g[:, 10:20] @ rng.normal(size=10) + rng.normal(size=80)
    loco = structure.loco_kinship(geno)
    r = mlm.rotate(loco.eigen("1"), y, None)
    h2, nll = mlm.minimize_bounded(lambda h: mlm.ml_objective(h, r), *mlm.H2_BOUNDS, 1e-8)
    for i in (3, 5, 8):
        gt = g[:, i] @ r.vectors
        a, b = (mlm.likelihood_ratio(r, gt, h2, nll, s) for s in ("BRENT", "GEMMA"))
        assert abs(np.log10(a[2]) - np.log10(b[2])) < 0.05 and abs(a[0] - b[0]) < 0.02
        x = np.column_stack([r.x, gt])
        eps = 1e-6
        assert np.isclose(mlm.ml_slope(0.4, r, x), (mlm.ml_objective(0.4 + eps, r, x) - mlm.ml_objective(0.4 - eps, r, x)) / (2 * eps), rtol=1e-3, atol=1e-4)
    wald, refined = rows(mlm.scan_loco(geno, y, loco=loco, refine=False)), rows(mlm.scan_loco(geno, y, loco=loco))
    hit = wald.p < mlm.SCREEN_P
    assert hit.iloc[3] and (wald.p[~hit].to_numpy() == refined.p[~hit].to_numpy()).all() and not np.isclose(wald.p.iloc[3], refined.p.iloc[3], rtol=1e-9)


def test_planted_marker_is_found(spark):
    geno, g, rng = panel(spark, 120, 60, 101, chroms=4)
    y = 3.0 * g[:, 0] + 2.0 * g[:, 40] + rng.normal(size=120)
    for found in (multilocus.farmcpu(geno, y, rng.normal(size=(120, 2))), multilocus.blink(geno, y)):
        p = rows(found.results).p.to_numpy()
        assert {0, 40} <= set(found.selected) and p[0] < 1e-6 and p[40] < 1e-6 and len(p) == 60
        assert found.trace_frame().count() == len(found.trace) > 1
    assert rows(multilocus.farmcpu(geno, y, method_bin="EMMA").results).p.iloc[0] < 1e-6
    quiet = multilocus.blink(geno, rng.normal(size=120), p_threshold=1e-12)
    assert quiet.selected == [] and quiet.trace[0].candidates == 0
    prior = spark.createDataFrame([("m0", 0.5)], "marker string, weight double")
    assert 0 in multilocus.blink(geno, y, prior=prior, min_maf=0.05, substitution="mean").selected


def test_resampling_and_clusters(spark):
    geno, g, rng = panel(spark, 100, 30, 6)
    twin = Genotypes.from_matrix(spark, np.column_stack([g, g[:, 0]]), markers=pd.DataFrame({"MARKER": [f"m{i}" for i in range(31)], "CHROM": "1", "POS": np.arange(31) * 10**6}))
    y = 3.0 * g[:, 0] + rng.normal(size=100)
    calls = []
    found = multilocus.resample(twin, y, runs=2, seed=3, threshold=1e-6, cluster=True, progress=lambda *a: calls.append(a)).collect()
    assert found[0].rmip == 1.0 and set(found[0].members) <= {"m0", "m30"} and len(calls) == 2
    rows_ = multilocus.cluster_rows(twin, {0: {0, 1}, 30: {1, 2}, 5: {0}}, 4, 0.7)
    assert sorted((r[0], r[1]) for r in rows_) == [(0, 0.75), (5, 0.25)]


def test_resampling_side_by_side_agrees_and_leaves_no_scans_cached(spark, monkeypatch):
    geno, g, rng = panel(spark, 100, 30, 6)
    y = 3.0 * g[:, 0] + 0.6 * g[:, 4] + rng.normal(size=100)
    cached = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    held = cached()
    ask = lambda: multilocus.resample(geno, y, runs=4, mask=0.3, seed=3, threshold=1e-3).collect()
    found = ask()
    assert cached() <= held and found[0].marker_idx == 0 and found[0].rmip == 1.0
    monkeypatch.setattr(multilocus, "RUNS_AT_ONCE", 1)
    assert ask() == found


def test_resampling_packs_small_panels_and_leaves_large_ones(spark, monkeypatch):
    geno, g, rng = panel(spark, 100, 30, 6)
    cached = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    held, parts = cached(), geno.calls.rdd.getNumPartitions()
    assert parts > 1
    with multilocus._packed(geno) as own:
        assert own.calls.rdd.getNumPartitions() == own.markers.rdd.getNumPartitions() == 1
        assert np.array_equal(own.matrix(), geno.matrix()) and sorted(own.markers.collect()) == sorted(geno.markers.collect())
    assert cached() == held
    monkeypatch.setattr(multilocus, "CELLS", 100)
    with multilocus._packed(geno) as own:
        assert own is geno


def test_choices_by_linkage_and_criterion():
    g = np.array([[0, 0, 2], [0, 0, 1], [1, 1, 0], [1, 1, 1], [2, 2, 2]], float)
    assert multilocus.prune_linked(g, 0.8, ["1", "1", "2"]) == [0, 2]
    assert multilocus.prune_linked(g, 0.8, ["1", "2", "2"]) == [0, 1, 2]
    assert [list(x) for x in multilocus.covariate_statistics(np.array([1.0, 2.0]), np.ones((2, 2)))] == [[1, 1], [0, 0], [1, 1]]
    assert multilocus.jaccard([1, 2], [2, 3]) == 1 / 3 and multilocus.jaccard([], []) == 1
    for method in ("naive", "even", "lg", "ln", "fixed"):
        grid = multilocus.bic_grid(50, 100, method)
        assert grid == sorted(set(grid)) and grid[-1] <= int(100 / np.log(100))
    big = 10**6  # so many samples that the candidates alone bound the grid
    assert multilocus.bic_grid(10, big, "even") == [3, 6, 9, 10] and multilocus.bic_grid(1, big, "even") == [1] and multilocus.bic_grid(2, big, "even") == [1, 2]
    assert multilocus.bic_grid(50, big, "lg") == [1, 8, 14, 20, 27, 34, 42, 50] and multilocus.bic_grid(30, big, "ln") == [1, 4, 6, 8, 11, 14, 17, 20, 24, 28, 30]
    assert multilocus.bic_grid(100, big, "fixed") == [int(np.floor(1 + 99 * k / 19 + 1e-9)) for k in range(20)] and multilocus.bic_grid(20, big, "fixed") == list(range(1, 21))
    h = [(0.2, 1.0, 0.1), (0.1, 2.0, 0.2), (0.6, 3.0, 0.3)]
    assert multilocus.substitute(h, "reward")[0] == 0.1 and multilocus.substitute(h, "penalty")[0] == 0.6
    assert np.isclose(multilocus.substitute(h, "mean")[0], 0.3) and multilocus.substitute(h, "median")[1] == 2.0 and multilocus.substitute(h, "onsite") == h[-1]


def test_effective_number(spark):
    g = [[0, 0, 0], [1, 1, 1], [0, 0, 1], [1, 1, 0]]
    table = pd.DataFrame({"MARKER": list("abc"), "CHROM": "1", "POS": [100, 150, 10000]})
    out = effective.effective_tests(Genotypes.from_matrix(spark, g, markers=table))
    assert out["Me"] == 2 and out["total_snps"] == 3
    rng = np.random.default_rng(0)
    free = Genotypes.from_matrix(spark, rng.integers(0, 3, (200, 12)), markers=pd.DataFrame({"MARKER": [f"m{i}" for i in range(12)], "CHROM": ["1"] * 6 + ["2"] * 6, "POS": list(range(1, 7)) * 2}))
    assert effective.effective_tests(free)["Me"] == 12
    flat = effective.effective_tests(Genotypes.from_matrix(spark, np.zeros((5, 3))))
    assert flat["Me"] == 0 and flat["total_snps"] == 3
    pos = np.array([0, 1, 2, 4_000_000, 8_000_001])
    x = np.tile(np.array([0.0, 1, 2, 1, 0]), (5, 1))
    assert effective.blocks(x, pos, effective.BlockRules()) == [(0, 3), (3, 4), (4, 5)]
    assert np.isclose(effective.p_correlation(np.array([1.0]))[0], min(1, sum(effective.P_CORRELATION)), atol=1e-9)


def test_bayes_signal_null_and_limits(spark):
    geno, g, rng = panel(spark, 90, 180, 2027, chroms=4)
    y = 1.6 * g[:, 25] + rng.normal(size=90)
    small = {"pi_grid": (0.02,), "slab_scale_grid": (1.0,), "max_epochs": 30}
    found, meta = bayes.bayes_loco(geno, y, config=small)
    p = rows(found).p.rank().iloc[25]
    assert p <= 10 and meta["pi"] == 0.02
    quiet, _ = bayes.bayes_loco(geno, rng.normal(size=90), config={**small, "calibration": "gc", "test": "robust"})
    q = rows(quiet).p
    assert 0.0 <= (q < 0.05).mean() <= 0.15 and 0.25 <= q.median() <= 0.8
    tuned, meta = bayes.bayes_loco(geno, y, config={"max_epochs": 8, "refine": True})
    assert len(meta["losses"]) == 6 and rows(tuned).p.rank().iloc[25] <= 10
    with pytest.raises(NotImplementedError):
        bayes.bayes_loco(geno, (y > 0).astype(float))
    for bad in ({"pi_grid": ()}, {"score": "x"}, {"calibration": "unrelated"}, {"nothing": 1}):
        with pytest.raises(ValueError):
            bayes.BayesConfig.of(bad)


def test_random_panel(spark):
    g = random_genotypes(spark, 10, 50, missing=0.2, seed=1)
    m = g.matrix()
    assert m.shape == (10, 50) and 0.05 < (m < 0).mean() < 0.4


def few_calls(spark, n=400, k=12, seed=21):
    """A panel whose rows are mostly 0, in both forms: rows of entries and rows of all samples."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random((n, k)) < 0.06, rng.integers(1, 3, (n, k)), 0).astype(np.int8)
    g[5, 0], g[7, 1] = -9, -9
    g[:, 3] = rng.integers(0, 3, n)
    markers = pd.DataFrame({"MARKER": [f"m{i:02d}" for i in range(k)], "CHROM": "1", "POS": np.arange(1, k + 1)})
    whole = Genotypes.from_matrix(spark, g, samples=[f"s{i}" for i in range(n)], markers=markers)
    long = spark.createDataFrame([(f"s{i}", f"m{j:02d}", None if g[i, j] < 0 else int(g[i, j])) for i in range(n) for j in range(k) if g[i, j]], "sample_id string, marker string, dosage int")
    return from_long(long, whole.samples, whole.markers), whole, g, rng


def test_rows_of_few_calls_take_the_room_of_their_calls(spark):
    few, whole, g, rng = few_calls(spark)
    size = {r.marker_idx: len(r.g) for r in few.calls.collect()}
    assert all(size[j] == (400 if j == 3 else 5 * np.count_nonzero(g[:, j])) for j in range(12))
    y, c = rng.normal(size=(400, 2)), rng.normal(size=(400, 1))
    for fill in (1.0, "major", "mean"):
        a, b = (glm.scan(x, y, c, traits=("a", "b"), fill=fill).toPandas().sort_values(["marker_idx", "trait"]) for x in (few, whole))
        assert np.allclose(a[["effect", "se", "t", "p"]], b[["effect", "se", "t", "p"]], rtol=1e-9)
    for at in (rng.permutation(400)[:300], [3, 3, 7]):
        assert (few.take_samples(at).matrix() == g[at]).all()
    assert (few.matrix() == g).all() and (few.columns([3, 1]) == g[:, [3, 1]]).all() and (few.sparse_columns([3, 1], 0).dense() == np.maximum(g[:, [3, 1]], 0)).all()
    assert np.allclose(structure.vanraden(few), structure.vanraden(whole))


def test_loops_over_rows_of_few_calls_agree_with_whole_rows(spark):
    few, whole, g, rng = few_calls(spark)
    y = 3.0 * g[:, 2] + 2.0 * g[:, 4] + rng.normal(size=400)
    for model in (multilocus.farmcpu, multilocus.blink):
        a, b = (model(x, y, p_threshold=1e-3) for x in (few, whole))
        assert a.selected == b.selected and 2 in a.selected
        a, b = rows(a.results), rows(b.results)
        assert np.allclose(a[["effect", "se", "t", "p"]], b[["effect", "se", "t", "p"]], rtol=1e-8)
    found = [multilocus.resample(x, y, runs=3, seed=4, threshold=1e-4).collect() for x in (few, whole)]
    assert found[0] == found[1] and found[0]


def test_chosen_markers_are_held_without_the_samples_at_which_all_are_0(spark):
    few, _, g, rng = few_calls(spark)
    index = [2, 4, 9]
    x = multilocus._columns(few, index)
    assert len(x.at) == np.count_nonzero(g[:, index].any(1)) < 400 and (x.dense() == g[:, index]).all()
    assert np.allclose(x.correlations(), np.corrcoef(g[:, index].T.astype(float)))
    y, base = rng.normal(size=400), np.column_stack([np.ones(400), rng.normal(size=400)])
    wide = np.column_stack([base, g[:, index]])
    for a, b in zip(multilocus.covariate_statistics(y, glm.Wide(base, x)), multilocus.covariate_statistics(y, wide)):
        assert np.allclose(a, b)
    assert np.isclose(multilocus.bic_statistics(y, glm.Wide(base, x))[0], multilocus.bic_statistics(y, wide)[0])
    twice = glm.Wide(base, x.take([0, 1, 0]))
    assert twice.rank() == 4 and multilocus.covariate_statistics(y, twice)[0].tolist() == [1.0] * 5


def test_blocks_of_few_calls_agree_with_whole_rows_and_open_none(spark, monkeypatch):
    few, whole, g, rng = few_calls(spark)
    twin = g.copy()
    twin[:, 6], twin[:, 7], twin[:, 8] = g[:, 5], np.where(rng.random(400) < 0.01, 1, g[:, 5]), 0
    twin[twin < 0] = 0
    twin[:, 3] = g[:, 2]
    whole = Genotypes.from_matrix(spark, twin, samples=whole.samples, markers=pd.DataFrame({"MARKER": [f"m{i:02d}" for i in range(12)], "CHROM": ["1"] * 9 + ["2"] * 3, "POS": np.arange(1, 13)}))
    long = spark.createDataFrame([(f"s{i}", f"m{j:02d}", int(twin[i, j])) for i in range(400) for j in range(12) if twin[i, j]], "sample_id string, marker string, dosage int")
    few = from_long(long, whole.samples, whole.markers)
    a, b = (effective.linkage_blocks(x).orderBy("chrom", "start").collect() for x in (few, whole))
    assert [r[:4] for r in a] == [r[:4] for r in b] and max(r.n_snps for r in a) >= 3 and np.allclose([r.me for r in a], [r.me for r in b])
    raw = [bytes(r.g) for r in few.calls.orderBy("marker_idx").collect()]
    monkeypatch.setattr(effective, "dense_row", None)
    rules = effective.BlockRules()
    found = effective.blocks_of_entries(raw, 400, np.arange(12), rules)
    assert sum(n for _, _, n, _, _ in found) == 11


def test_pairs_of_markers_are_made_by_tasks(spark, monkeypatch):
    g = np.random.default_rng(8).integers(0, 3, (40, 25)).astype(float)
    monkeypatch.setattr(effective, "PAIRS", 7)
    found = effective.correlation_pairs(spark, g, [f"m{i}" for i in range(40)])
    assert found.rdd.getNumPartitions() > 1
    c = effective.correlations(g)
    assert {(r.a, r.b): r.correlation for r in found.collect()} == pytest.approx({(f"m{i}", f"m{j}"): c[i, j] for i in range(40) for j in range(i + 1, 40)}, abs=1e-6)


def test_markers_with_the_same_calls_have_the_same_p_whatever_the_order(spark):
    rng = np.random.default_rng(31)
    y = np.round(rng.normal(size=300) * 5000, 2)
    calls = [(f"s{i}", int(d)) for i, d in enumerate(rng.integers(0, 3, 300)) if d]
    long = [(s, j, d) for j in range(40) for s, d in (calls[k] for k in rng.permutation(len(calls)))]
    samples = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(y)], "sample_id string, y double")
    found = glm.native_scan(spark.createDataFrame(long, "sample_id string, marker int, dosage int").repartition(7), samples).collect()
    assert len(found) == 40 and len({r.p for r in found}) == 1
    g = np.zeros(300)
    for s, d in calls:
        g[int(s[1:])] = d
    assert np.allclose([found[0].effect, found[0].se], ols(y, None, g)[:2], rtol=1e-9)
