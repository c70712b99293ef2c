"""Alignment of phenotypes, covariates and genotypes by sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_samples(phenotype: DataFrame, samples: Sequence[str], covariates: DataFrame | None = None, order: str = "genotype") -> tuple[pd.DataFrame, pd.DataFrame | None, np.ndarray, dict]:
    """Inner join by identifier (text, case counts), in genotype or phenotype order.

    Returns the phenotype rows, the covariate rows, the places of the common samples among ``samples``, and counts.
    Covariates must cover every common sample. Tables have a row for each sample, so they fit the driver.
    """
    spark = phenotype.sparkSession
    listed = spark.createDataFrame([(str(s), i) for i, s in enumerate(samples)], "ID string, sample_idx int")
    pheno = phenotype.withColumn("ID", F.col("ID").cast("string")).withColumn("_row", F.monotonically_increasing_id())
    joined = pheno.join(F.broadcast(listed), "ID").orderBy("sample_idx" if order == "genotype" else "_row")
    rows = joined.drop("_row").toPandas()
    index = rows.pop("sample_idx").to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    cov = None
    if covariates is not None:
        common = spark.createDataFrame([(i, k) for k, i in enumerate(rows["ID"])], "ID string, _at int")
        covariates = covariates.withColumn("ID", F.col("ID").cast("string"))
        absent = [r.ID for r in common.join(covariates, "ID", "left_anti").orderBy("_at").limit(11).collect()]
        if absent:
            raise ValueError(f"covariates lack {describe(absent)}")
        cov = covariates.join(F.broadcast(common), "ID").orderBy("_at").drop("_at").toPandas()
    summary = {
        "n_phenotype": phenotype.count(), "n_genotype": len(samples), "n_common": len(rows),
        "n_covariate": covariates.count() if covariates is not None else 0,
        "phenotype_only": phenotype.count() - len(rows), "genotype_only": len(samples) - len(set(index.tolist())),
    }
    return rows, cov, index, summary


def describe(labels: Sequence[str], most: int = 10) -> str:
    shown = ", ".join(map(str, labels[:most]))
    return f"{len(labels)}{'+' if len(labels) > most else ''} samples ({shown}{', ...' if len(labels) > most else ''})"


def finite_rows(y: np.ndarray, covariates: np.ndarray | None = None) -> np.ndarray:
    """Which samples have a finite trait and finite covariates."""
    ok = np.isfinite(np.asarray(y, float))
    return ok if covariates is None else ok & np.isfinite(np.asarray(covariates, float)).all(1)


def require_finite(y: np.ndarray, samples: Sequence[str], what: str = "phenotype") -> None:
    bad = np.flatnonzero(~np.isfinite(np.asarray(y, float).reshape(len(y), -1)).all(1))
    if len(bad):
        raise ValueError(f"{what} is missing for {describe([str(samples[i]) for i in bad])}")
