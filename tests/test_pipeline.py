import glob

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from locusforge import cli
from locusforge.model import Genotypes
from locusforge.operators.align import align_samples, require_finite
from locusforge.sources.results import read_association, summary_text, write_association, write_summary
from locusforge.pipeline import Pipeline, analyze, method_names, mlm_mode, with_map


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(42)
    ids = [f"S{i:03d}" for i in range(60)]
    g = rng.binomial(2, 0.4, (60, 120))
    height = 5.0 * g[:, 10] + rng.normal(size=60)
    yields = rng.normal(size=60)
    yields[3] = np.nan
    pd.DataFrame({"ID": ids[::-1], "Height": height[::-1], "Yield": yields[::-1]}).to_csv(folder / "phenotypes.csv", index=False)
    pd.DataFrame(g, columns=[f"SNP{i:04d}" for i in range(120)]).assign(ID=ids)[["ID", *[f"SNP{i:04d}" for i in range(120)]]].to_csv(folder / "genotypes.csv", index=False)
    pd.DataFrame({"SNP": [f"SNP{i:04d}" for i in range(120)], "CHROM": [f"Chr0{1 + i // 40}" for i in range(120)], "POS": [1000 * (i + 1) for i in range(120)]}).to_csv(folder / "map.csv", index=False)
    pd.DataFrame({"ID": ids, "Field": rng.integers(0, 3, 60), "Year": 2020, "Block": rng.integers(0, 4, 60)}).to_csv(folder / "covariates.csv", index=False)
    return folder


def test_alignment(spark):
    pheno = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("z", 3.0)], "ID string, y double")
    rows, cov, index, summary = align_samples(pheno, ["a", "q", "b"])
    assert rows.ID.tolist() == ["a", "b"] and index.tolist() == [0, 2] and cov is None
    assert (summary["n_common"], summary["phenotype_only"], summary["genotype_only"]) == (2, 1, 1)
    rows, _, index, _ = align_samples(pheno, ["a", "q", "b"], order="phenotype")
    assert rows.ID.tolist() == ["b", "a"] and index.tolist() == [2, 0]
    full = spark.createDataFrame([("b", 7.0), ("a", 8.0)], "ID string, c double")
    assert align_samples(pheno, ["a", "b"], full)[1].c.tolist() == [8.0, 7.0]
    with pytest.raises(ValueError, match="covariates lack"):
        align_samples(pheno, ["a", "b"], full.limit(1))
    with pytest.raises(ValueError, match="s1"):
        require_finite(np.array([1, np.nan]), ["s0", "s1"])


def test_end_to_end(spark, files, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    p.load_data(str(files / "phenotypes.csv"), str(files / "genotypes.csv"), str(files / "map.csv"), covariate_file=str(files / "covariates.csv"), covariate_columns=["Field", "Block"])
    p.align_samples()
    p.compute_population_structure(2)
    runs = p.run_analysis(methods=["glm", "MLM", "FARMCPU", "blink", "resampling", "BAYESLOCO"], resampling_params={"runs": 2, "seed": 1, "threshold": 1e-6}, bayes_params={"max_epochs": 10, "pi_grid": (0.02,), "slab_scale_grid": (1.0,)}, include_standard_errors=True)
    assert set(runs) == {"Height", "Yield"}
    table = runs["Height"].tables["all_results"].toPandas()
    assert len(table) == 120 and {"MARKER", "CHROM", "POS", "SNP", "REF", "ALT", "MAF", "GLM_P", "GLM_Effect", "GLM_SE", "MLM_P", "FarmCPU_P", "BLINK_P", "BAYESLOCO_P"} <= set(table.columns)
    assert all(table[f"{m}_P"].idxmin() == 10 for m in ("GLM", "MLM", "FarmCPU", "BLINK"))
    hits = runs["Height"].tables["significant"].toPandas()
    assert "GLM|MLM" in hits.set_index("MARKER").Method["SNP0010"]
    summary = p.summary_frame().toPandas()
    assert len(summary) == 12 and summary.N_Markers.eq(120).all() and set(summary.N_Samples) == {60, 59}
    assert runs["Height"].tables["resampling"].first().MARKER == "SNP0010"
    out = p.write()
    assert all(glob.glob(f"{o}/*.csv") for o in out)


def test_one_call(spark, files, tmp_path):
    out = analyze(spark, str(files / "phenotypes.csv"), str(files / "genotypes.csv"), str(files / "map.csv"), method=["GLM", "MLM"], mode="global", n_pcs=2, traits=["Height"], output_dir=str(tmp_path))
    assert out["summary"].count() == 2 and out["files"]
    assert out["runs"]["Height"].tables["all_results"].toPandas().GLM_P.idxmin() == 10
    with pytest.raises(ValueError):
        analyze(spark, pd.DataFrame({"ID": ["S000", "S001"], "t": [np.nan, np.nan]}), str(files / "genotypes.csv"))


def test_result_files(spark, tmp_path):
    d = spark.createDataFrame([(0, 0.5, 1.0), (1, float("nan"), None)], "marker_idx long, p double, effect double")
    write_association(d, str(tmp_path / "r"), compression="gzip")
    back = read_association(spark, str(tmp_path / "r")).orderBy("marker_idx").collect()
    assert [(r.marker_idx, r.p, r.effect) for r in back] == [(0, 0.5, 1.0), (1, None, None)]
    rows = [{"Trait": "t", "Method": "GLM", "Significant_Hits": 2, "Threshold": 1e-5, "Lambda_GC": 1.01, "N_Samples": 9, "N_Markers": 99}, {"Trait": "t", "Method": "MLM", "Info": "failed: x"}]
    assert summary_text(rows).splitlines() == ["t GLM: 2 hits at 1e-05 among 99 markers and 9 samples, lambda 1.010", "t MLM: failed: x"]
    write_summary(spark, rows, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == 2


def test_thresholds(spark, files):
    p = Pipeline(spark).load_data(str(files / "phenotypes.csv"), str(files / "genotypes.csv"), trait_columns=["Height"])
    assert np.isclose(p.run_analysis(methods=["GLM"], outputs=[])["Height"].thresholds["GLM"], 0.05 / 120)
    assert np.isclose(p.run_analysis(methods=["GLM"], n_eff=10, outputs=[])["Height"].thresholds["GLM"], 0.005)
    p.geno.metadata["effective_tests"] = {"Me": 20}
    assert np.isclose(p.run_analysis(methods=["GLM"], outputs=[])["Height"].thresholds["GLM"], 0.0025)
    dropped = p.run_analysis(methods=["GLM"], min_mac=45, n_eff=10, outputs=[])["Height"]
    assert np.isclose(dropped.thresholds["GLM"], 0.05 / dropped.results["GLM"].count())
    assert p.run_analysis(methods=["GLM"], significance=1e-3, outputs=[])["Height"].thresholds["GLM"] == 1e-3


def test_names_and_maps(spark, files):
    assert method_names(["resampling", "glm", "FARMCPU_RESAMPLING"]) == ["GLM", "FarmCPUResampling"]
    assert mlm_mode("classic") == "global" and mlm_mode("leave_one_chromosome_out") == "loco"
    for bad in (lambda: method_names(["x"]), lambda: mlm_mode("x")):
        with pytest.raises(ValueError):
            bad()
    g = Genotypes.from_matrix(spark, [[0, 1], [1, 2]])
    table = spark.createDataFrame([("m0", "5", 7), ("zz", "6", 8)], "marker string, chrom string, pos long")
    with pytest.warns(UserWarning):
        moved = with_map(g, table)
    assert [r.chrom for r in moved.calls.orderBy("marker_idx").collect()] == ["5", "6"] and (moved.matrix() == g.matrix()).all()
    with pytest.raises(ValueError):
        with_map(g, table.limit(1))


def test_command_line(spark, files, tmp_path, capsys):
    assert cli.main(["run", "--phenotype", str(files / "phenotypes.csv"), "--genotype", str(files / "genotypes.csv"), "--map", str(files / "map.csv"), "--methods", "GLM", "--traits", "Height", "--n-pcs", "0", "--keep-monomorphic", "--output-dir", str(tmp_path / "o")], spark) == 0
    assert "summary" in capsys.readouterr().out
    assert cli.main(["convert", "--genotype", str(files / "genotypes.csv"), "--keep-monomorphic", "--out", str(tmp_path / "store")], spark) == 0
    assert cli.main(["run", "--phenotype", str(files / "phenotypes.csv"), "--genotype", str(tmp_path / "store"), "--methods", "GLM", "--traits", "Height", "--n-pcs", "1", "--output-dir", str(tmp_path / "p"), "--gzip"], spark) == 0
    assert glob.glob(str(tmp_path / "p/GWAS_Height_all_results/*.csv.gz"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
