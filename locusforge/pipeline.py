"""Analyses from files to tables: one call, or step by step."""

from __future__ import annotations

import json
import logging
import time
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.model import Genotypes, impute_major
from locusforge.operators import bayes, glm, mlm, multilocus, plotdata, statistics, structure
from locusforge.operators.align import align_samples, finite_rows
from locusforge.operators.quality import keep_by_mac
from locusforge.sources import formats
from locusforge.sources.genotypes import Filters, read_genotypes

log = logging.getLogger("locusforge")

#: Order in which methods run.
ORDER = ("GLM", "MLM", "FarmCPU", "BLINK", "BAYESLOCO", "FarmCPUResampling")
_ALIASES = {"glm": "GLM", "mlm": "MLM", "farmcpu": "FarmCPU", "blink": "BLINK", "bayesloco": "BAYESLOCO", "bayes": "BAYESLOCO", "farmcpuresampling": "FarmCPUResampling", "resampling": "FarmCPUResampling"}
OUTPUTS = ("all_marker_pvalues", "significant_marker_pvalues", "manhattan", "qq")
#: Share of runs from which a resampled marker counts as found.
RMIP_HIT = 0.1
_MLM_MODES = {"loco": "loco", "leave_one_chromosome_out": "loco", "global": "global", "full": "global", "classic": "global"}


def method_names(methods: Sequence[str]) -> list[str]:
    out = []
    for m in methods:
        name = _ALIASES.get(m.strip().lower().replace("_", "").replace("-", ""))
        if name is None:
            raise ValueError(f"no method {m}")
        out.append(name)
    return [m for m in ORDER if m in out]


def mlm_mode(mode: str) -> str:
    if mode.lower() not in _MLM_MODES:
        raise ValueError(f"no mixed-model mode {mode}")
    return _MLM_MODES[mode.lower()]


@dataclass
class TraitRun:
    trait: str
    results: dict[str, DataFrame] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    summary: list[dict] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)


class Pipeline:
    """Load, align, derive structure, run, and write; each step keeps what later ones need."""

    def __init__(self, spark: SparkSession, output_dir: str | None = None):
        self.spark, self.output_dir = spark, output_dir
        self.phenotype: DataFrame | None = None
        self.covariates: DataFrame | None = None
        self.geno: Genotypes | None = None
        self.rows: pd.DataFrame | None = None
        self.cov_rows: pd.DataFrame | None = None
        self.aligned: Genotypes | None = None
        self.pcs: np.ndarray | None = None
        self.kinship: np.ndarray | None = None
        self.summary: dict = {}
        self._loco: dict[str, structure.LocoKinship] = {}

    def load_data(
        self, phenotype_file: str, genotype_file: str, map_file: str | None = None, *, genotype_format: str | None = None, trait_columns: Sequence[str] | None = None, covariate_file: str | None = None,
        covariate_columns: Sequence[str] | None = None, covariate_id_column: str = "ID", phenotype_id_column: str = "ID", filters: Filters = Filters(), cache: str | None = None, effective: bool = False,
    ) -> Pipeline:
        """A map file takes the place of the genotypes' own by position; other names only warn, another count is an error."""
        self.phenotype = formats.read_phenotype(self.spark, phenotype_file, trait_columns, phenotype_id_column)
        if covariate_file:
            self.covariates = formats.read_covariates(self.spark, covariate_file, covariate_columns, covariate_id_column)
        self.geno = read_genotypes(self.spark, genotype_file, fmt=genotype_format, filters=filters, cache=cache, effective=effective)
        if map_file:
            self.geno = with_map(self.geno, formats.read_map(self.spark, map_file))
        return self

    def align_samples(self) -> dict:
        self.rows, self.cov_rows, index, self.summary = align_samples(self.phenotype, self.geno.samples, self.covariates)
        if not len(index):
            raise ValueError("phenotypes and genotypes share no sample")
        self.aligned = self.geno.take_samples(index)
        self.aligned.calls = self.aligned.calls.persist()
        self.pcs = self.kinship = None
        self._loco.clear()
        return self.summary

    def compute_population_structure(self, n_pcs: int = 3, calculate_kinship: bool = True) -> Pipeline:
        """Over all aligned samples and markers; traits later take their samples' part."""
        if self.aligned is None:
            self.align_samples()
        if calculate_kinship:
            self.kinship = structure.vanraden(self.aligned)
        if n_pcs > 0:
            self.pcs = structure.components_of_genotypes(self.aligned, n_pcs)
        return self

    def _covariates(self) -> np.ndarray | None:
        parts = []
        if self.cov_rows is not None:
            parts.append(self.cov_rows.drop(columns=["ID"]).to_numpy(float))
        if self.pcs is not None:
            parts.append(self.pcs)
        return np.column_stack(parts) if parts else None

    def run_analysis(
        self, traits: Sequence[str] | None = None, methods: Sequence[str] = ("GLM", "MLM", "FARMCPU", "BLINK"), *, max_iterations: int = 10, significance: float | None = None, alpha: float = 0.05,
        n_eff: float | None = None, use_effective_tests: bool = True, max_genotype_dosage: float = 2.0, min_mac: float = 10, mode: str = "loco", farmcpu_params: dict | None = None, blink_params: dict | None = None,
        bayes_params: dict | None = None, resampling_params: dict | None = None, outputs: Sequence[str] = OUTPUTS, include_standard_errors: bool = False, strict_hits: bool = False, progress: Callable | None = None,
    ) -> dict[str, TraitRun]:
        """Every method on every trait. Traits measured on the same samples share linear and mixed scans.

        A trait without valid rows is left out; a method that fails is logged and the others go on.
        """
        if self.aligned is None:
            self.align_samples()
        names = formats.resolve_traits([c for c in self.rows.columns if c != "ID"], traits)
        chosen, mode = method_names(methods), mlm_mode(mode)
        cov = self._covariates()
        groups: dict[bytes, list[str]] = {}
        for t in names:
            ok = finite_rows(self.rows[t].to_numpy(float), cov)
            if ok.any():
                groups.setdefault(ok.tobytes(), []).append(t)
            else:
                warnings.warn(f"trait {t} has no valid rows", stacklevel=2)
        total = self.aligned.count()
        effective = (self.geno.metadata.get("effective_tests") or {}).get("Me") if use_effective_tests else None
        runs: dict[str, TraitRun] = {}
        for mask, members in groups.items():
            at = np.flatnonzero(np.frombuffer(mask, bool))
            part = self.aligned if len(at) == self.aligned.n else self.aligned.take_samples(at)
            kept = keep_by_mac(part, min_mac, max_genotype_dosage)
            kept.calls = kept.calls.persist()
            m = kept.count()
            own = None if cov is None else cov[at]
            y = self.rows[members].to_numpy(float)[at]
            tests = m if m < total else (n_eff or effective or total)
            threshold = significance if significance is not None else alpha / max(1, tests)
            shared = self._shared(kept, y, own, members, chosen, mode, at)
            for i, t in enumerate(members):
                run = runs[t] = TraitRun(t)
                for method in chosen:
                    began = time.time()
                    try:
                        found, limit, info = self._run(method, kept, y[:, i], own, t, shared, threshold, m, max_iterations, n_eff, effective, farmcpu_params or {}, blink_params or {}, bayes_params, resampling_params or {}, significance, progress)
                    except Exception as error:
                        log.exception("%s on %s failed", method, t)
                        run.summary.append({"Trait": t, "Method": method, "Info": f"failed: {error}"})
                        continue
                    run.results[method], run.thresholds[method] = found, limit
                    run.summary.append(self._row(t, method, found, limit, len(at), total, time.time() - began, info, strict_hits))
                self._tables(run, outputs, include_standard_errors, strict_hits)
        self.runs = runs
        return runs

    def _shared(self, geno, y, cov, members, chosen, mode, at) -> dict[str, DataFrame]:
        out = {}
        if "GLM" in chosen:
            out["GLM"] = glm.scan(geno, y, cov, traits=members).persist()
        if "MLM" in chosen:
            try:
                if mode == "loco":
                    out["MLM"] = mlm.scan_loco(geno, y, cov, loco=self._loco_for(geno, at), traits=members).persist()
                else:
                    k = (self.kinship if self.kinship is not None else structure.vanraden(self.aligned))[np.ix_(at, at)]
                    pair, found = structure.eigen(k), None
                    for i, t in enumerate(members):
                        one = mlm.scan_global(geno, y[:, i], covariates=cov, eigen_of=pair).withColumn("trait", F.lit(t))
                        found = one if found is None else found.union(one)
                    out["MLM"] = found.persist()
            except Exception as error:
                log.exception("mixed model failed")
                out["MLM error"] = error
        return out

    def _loco_for(self, geno: Genotypes, at: np.ndarray) -> structure.LocoKinship:
        """From the markers that pass the count filter; the last four are kept."""
        chroms = sorted(r.chrom for r in geno.calls.select("chrom").distinct().collect())
        key = structure.loco_digest(geno.count(), geno.samples, at.tolist(), chroms)
        if key not in self._loco:
            made = structure.LocoKinship.load(self.spark, f"{self.output_dir}/loco/{key}", key) if self.output_dir else None
            if made is None:
                made = structure.loco_kinship(geno)
                if self.output_dir:
                    made.save(self.spark, f"{self.output_dir}/loco/{key}", key)
            while len(self._loco) >= 4:
                self._loco.pop(next(iter(self._loco)))
            self._loco[key] = made
        return self._loco[key]

    def _run(self, method, geno, y, cov, trait, shared, threshold, m, loops, n_eff, effective, farm, blink, bayes_params, resampling, significance, progress) -> tuple[DataFrame, float, str]:
        if method in ("GLM", "MLM"):
            if method not in shared:
                raise shared.get(f"{method} error", RuntimeError("no scan"))
            return shared[method].where(F.col("trait") == trait).drop("trait"), threshold, ""
        if method == "FarmCPU":
            options = {"max_loop": loops, "n_eff": effective or n_eff, **farm}
            found = multilocus.farmcpu(geno, y, cov, **options)
            limit = significance if significance is not None else options.get("qtn_threshold", 0.01) / max(1, m)
            return found.results.drop("trait"), limit, f"{len(found.selected)} QTN"
        if method == "BLINK":
            found = multilocus.blink(geno, y, cov, **{"max_loop": loops, **blink})
            return found.results.drop("trait"), threshold, f"{len(found.selected)} QTN"
        if method == "BAYESLOCO":
            found, meta = bayes.bayes_loco(geno, y, cov, bayes_params)
            return found, threshold, json.dumps(meta)
        return multilocus.resample(geno, y, cov, trait=trait, progress=progress, **resampling), RMIP_HIT, ""

    def _row(self, trait, method, found, limit, n, m, seconds, info, strict) -> dict:
        if method == "FarmCPUResampling":
            hits, inflation = found.where(F.col("rmip") >= limit).count(), None
        else:
            hits = found.where(F.col("p") < limit if strict else F.col("p") <= limit).count()
            inflation = statistics.genomic_inflation(found)
        return {"Trait": trait, "Method": method, "Significant_Hits": hits, "Threshold": limit, "Lambda_GC": inflation, "N_Samples": n, "N_Markers": m, "Runtime_Seconds": seconds, "Info": info}

    def _tables(self, run: TraitRun, outputs: Sequence[str], with_se: bool, strict: bool) -> None:
        found = {k: v for k, v in run.results.items() if k != "FarmCPUResampling"}
        markers = self.aligned.markers
        if found and {"all_marker_pvalues", "significant_marker_pvalues"} & set(outputs):
            from locusforge.operators.quality import call_counts, maf

            base = markers.join(call_counts(self.aligned).select("marker_idx", maf().alias("MAF")), "marker_idx")
            merged = statistics.merge_methods(base, found, with_se=with_se)
            named = merged.select(F.col("marker_idx"), F.col("marker").alias("MARKER"), F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), F.col("marker").alias("SNP"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), "MAF", *[c for c in merged.columns if c.endswith(("_P", "_Effect", "_SE"))])
            if "all_marker_pvalues" in outputs:
                run.tables["all_results"] = named.orderBy("marker_idx").drop("marker_idx")
            if "significant_marker_pvalues" in outputs:
                run.tables["significant"] = statistics.significant(named, {k: run.thresholds[k] for k in found}, strict).orderBy("marker_idx").drop("marker_idx")
        if found and "manhattan" in outputs:
            run.tables["manhattan"] = plotdata.panels(found, markers)
        if "qq" in outputs:
            for name, table in found.items():
                run.tables[f"qq_{name}"] = plotdata.quantiles(table)
        if "FarmCPUResampling" in run.results:
            r = run.results["FarmCPUResampling"].join(markers, "marker_idx").select(F.col("marker").alias("MARKER"), F.col("marker").alias("SNP"), F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), F.col("rmip").alias("RMIP"), F.col("trait").alias("Trait"), F.to_json("members").alias("ClusterMembers"))
            run.tables["resampling"] = r.orderBy(F.desc("RMIP"), "MARKER")

    def summary_frame(self) -> DataFrame:
        rows = [s for r in self.runs.values() for s in r.summary]
        kind = "Trait string, Method string, Significant_Hits long, Threshold double, Lambda_GC double, N_Samples long, N_Markers long, Runtime_Seconds double, Info string"
        names = [c.split()[0] for c in kind.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kind)

    def write(self, folder: str | None = None, *, compression: str | None = None) -> list[str]:
        """Each table as CSV with a header, and the summary. Returns the paths."""
        folder = folder or self.output_dir
        if not folder:
            raise ValueError("no output folder")
        out = []
        for trait, run in self.runs.items():
            for name, table in run.tables.items():
                path = f"{folder}/GWAS_{trait}_{name}"
                writer = table.write.mode("overwrite").option("header", True)
                (writer.option("compression", compression) if compression else writer).csv(path)
                out.append(path)
        self.summary_frame().coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")
        return [*out, f"{folder}/summary"]


def with_map(geno: Genotypes, table: DataFrame) -> Genotypes:
    from locusforge.functions.labels import positional_index

    count = table.count()
    if count != geno.count():
        raise ValueError(f"the map has {count} markers, the genotypes {geno.count()}")
    rows = positional_index(table.withColumn("_line", F.monotonically_increasing_id()), ["_line"], "marker_idx").drop("_line")
    for c in ("ref", "alt"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    old = geno.markers.select("marker_idx", F.col("marker").alias("_old"))
    if not rows.join(old, "marker_idx").where(F.col("marker") != F.col("_old")).isEmpty():
        warnings.warn("the map names other markers than the genotypes; it is taken by position", stacklevel=2)
    calls = geno.calls.drop("chrom").join(rows.select("marker_idx", "chrom"), "marker_idx").select("marker_idx", "chrom", "g")
    return Genotypes(geno.samples, calls, rows.select("marker_idx", "marker", "chrom", "pos", "ref", "alt"), geno.imputed, dict(geno.metadata))


def analyze(
    spark: SparkSession, phe: str | pd.DataFrame, geno: str | Genotypes, map_data: str | None = None, cv: str | None = None, *, method: Sequence[str] = ("GLM",), threshold: float = 5e-8, n_pcs: int = 0,
    min_mac: float = 10, mode: str = "loco", output_dir: str | None = None, traits: Sequence[str] | None = None, **params: Any,
) -> dict:
    """One call: read, align, run and, with an output folder, write. Hits lie below the fixed threshold; a trait without
    valid rows is an error."""
    p = Pipeline(spark, output_dir)
    p.phenotype = formats.read_phenotype(spark, phe, traits) if isinstance(phe, str) else spark.createDataFrame(phe)
    p.geno = read_genotypes(spark, geno) if isinstance(geno, str) else geno
    if not p.geno.imputed and isinstance(geno, str):
        p.geno = impute_major(p.geno)
    if map_data:
        p.geno = with_map(p.geno, formats.read_map(spark, map_data))
    if cv:
        p.covariates = formats.read_covariates(spark, cv)
    p.align_samples()
    n, m = p.aligned.n, p.aligned.count()
    if n < 10 or m < 100:
        warnings.warn(f"only {n} samples and {m} markers", stacklevel=2)
    names = formats.resolve_traits([c for c in p.rows.columns if c != "ID"], traits)
    for t in names:
        if not np.isfinite(p.rows[t].to_numpy(float)).any():
            raise ValueError(f"trait {t} has no valid rows")
    chosen = method_names(method)
    p.compute_population_structure(n_pcs, calculate_kinship="MLM" in chosen and mlm_mode(mode) == "global")
    runs = p.run_analysis(traits, chosen, significance=threshold, min_mac=min_mac, mode=mode, strict_hits=True, **params)
    return {"runs": runs, "summary": p.summary_frame(), "pipeline": p, "files": p.write() if output_dir else []}
