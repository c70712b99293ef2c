"""``python -m locusforge.cli``: an analysis, or the conversion of a genotype file into a store."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from locusforge.pipeline import OUTPUTS, Pipeline, method_names
from locusforge.sources.genotypes import Filters, read_genotypes, write_store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusforge")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    conv = sub.add_parser("convert")
    for s in (run, conv):
        s.add_argument("--genotype", required=True)
        s.add_argument("--format", choices=("vcf", "plink", "hapmap", "csv", "tsv", "numeric", "parquet"))
        s.add_argument("--keep-monomorphic", action="store_true")
        s.add_argument("--snps-only", action="store_true")
        s.add_argument("--max-missing", type=float, default=1.0)
        s.add_argument("--min-maf", type=float, default=0.0)
        s.add_argument("--effective-tests", action="store_true")
    conv.add_argument("--out", required=True)
    run.add_argument("--phenotype", required=True)
    run.add_argument("--map")
    run.add_argument("--cache")
    run.add_argument("--covariates")
    run.add_argument("--covariate-columns", type=_names)
    run.add_argument("--traits", type=_names)
    run.add_argument("--methods", type=_names, default=["GLM", "MLM", "FarmCPU"])
    run.add_argument("--outputs", type=_names, default=list(OUTPUTS))
    run.add_argument("--output-dir", required=True)
    run.add_argument("--n-pcs", type=int, default=3)
    run.add_argument("--min-mac", type=float, default=10)
    run.add_argument("--mlm-mode", default="loco")
    run.add_argument("--significance", type=float)
    run.add_argument("--alpha", type=float, default=0.05)
    run.add_argument("--n-eff", type=float)
    run.add_argument("--max-iterations", type=int, default=10)
    run.add_argument("--qtn-threshold", type=float)
    run.add_argument("--p-threshold", type=float)
    run.add_argument("--resampling-runs", type=int, default=100)
    run.add_argument("--resampling-mask", type=float, default=0.1)
    run.add_argument("--resampling-threshold", type=float, default=5e-8)
    run.add_argument("--resampling-cluster", action="store_true")
    run.add_argument("--seed", type=int)
    run.add_argument("--bayes", type=json.loads, help="settings as JSON")
    run.add_argument("--standard-errors", action="store_true")
    run.add_argument("--gzip", action="store_true")
    return p


def _names(text: str) -> list[str]:
    return [t.strip() for t in text.split(",") if t.strip()]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    filters = Filters(include_indels=not a.snps_only, drop_monomorphic=not a.keep_monomorphic, max_missing=a.max_missing, min_maf=a.min_maf)
    spark = spark or SparkSession.builder.appName("locusforge").getOrCreate()
    if a.command == "convert":
        write_store(read_genotypes(spark, a.genotype, fmt=a.format, filters=filters, effective=a.effective_tests), a.out, source=a.genotype, filters=filters)
        return 0
    method_names(a.methods)
    unknown = set(a.outputs) - set(OUTPUTS)
    if unknown:
        raise SystemExit(f"unknown outputs {sorted(unknown)}")
    p = Pipeline(spark, a.output_dir)
    p.load_data(a.phenotype, a.genotype, a.map, genotype_format=a.format, trait_columns=a.traits, covariate_file=a.covariates, covariate_columns=a.covariate_columns, filters=filters, cache=a.cache, effective=a.effective_tests)
    p.align_samples()
    p.compute_population_structure(a.n_pcs, calculate_kinship=a.mlm_mode.lower() != "loco" and "MLM" in method_names(a.methods))
    farm = {k: v for k, v in (("qtn_threshold", a.qtn_threshold), ("p_threshold", a.p_threshold if a.p_threshold is not None else a.qtn_threshold)) if v is not None}
    p.run_analysis(
        a.traits, a.methods, max_iterations=a.max_iterations, significance=a.significance, alpha=a.alpha, n_eff=a.n_eff, min_mac=a.min_mac, mode=a.mlm_mode, farmcpu_params=farm, bayes_params=a.bayes,
        resampling_params={"runs": a.resampling_runs, "mask": a.resampling_mask, "threshold": a.resampling_threshold, "cluster": a.resampling_cluster, "seed": a.seed}, outputs=a.outputs, include_standard_errors=a.standard_errors,
    )
    for path in p.write(compression="gzip" if a.gzip else None):
        print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
