"""Allele statistics, quality filters and imputation over the long form (native) and over marker rows (Arrow)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusforge.model import Genotypes, decoded, map_calls

# ---- native, over (marker, dosage) rows; null or negative is missing


def valid(dosage: Column) -> Column:
    return F.when(dosage >= 0, dosage)


def marker_counts(long: DataFrame, marker: str = "marker", dosage: str = "dosage") -> DataFrame:
    """One row a marker: calls, missing, sums and counts of 0, 1, 2."""
    d = valid(F.col(dosage))
    each = [F.coalesce(F.sum((d == v).cast("long")), F.lit(0)).alias(f"n{v}") for v in (0, 1, 2)]
    return long.groupBy(marker).agg(F.count(d).alias("n_valid"), F.count(F.lit(1)).alias("n_samples"), F.coalesce(F.sum(d.cast("long")), F.lit(0)).alias("alleles"), F.coalesce(F.sum((d * d).cast("long")), F.lit(0)).alias("squares"), *each)


def with_zeros(counts: DataFrame, n_samples: int) -> DataFrame:
    """Counts of a long form that leaves out zeros, as if they were there: every sample without a row has dosage 0."""
    gap = F.lit(n_samples) - F.col("n_samples")
    return counts.withColumns({"n_valid": F.col("n_valid") + gap, "n0": F.col("n0") + gap, "n_samples": F.lit(n_samples).cast("long")})


def allele_frequency(max_dosage: float = 2.0) -> Column:
    return F.when(F.col("n_valid") > 0, F.col("alleles") / (F.col("n_valid") * F.lit(max_dosage)))


def maf(max_dosage: float = 2.0) -> Column:
    """Minor allele frequency over valid calls; 0 where none is valid."""
    f = allele_frequency(max_dosage)
    return F.coalesce(F.least(f, 1 - f), F.lit(0.0))


def maf_over_all(max_dosage: float = 2.0) -> Column:
    """The variant-file definition: minor alleles over the alleles of all samples, so missing counts as major."""
    other = F.col("n_valid") * max_dosage - F.col("alleles")
    return F.least(F.col("alleles").cast("double"), other.cast("double")) / (F.col("n_samples") * F.lit(max_dosage))


def mac(max_dosage: float = 2.0) -> Column:
    return F.least(F.col("alleles").cast("double"), F.col("n_valid") * F.lit(max_dosage) - F.col("alleles"))


def missing_rate() -> Column:
    return 1 - F.col("n_valid") / F.col("n_samples")


def monomorphic() -> Column:
    """All valid calls 0, or all 2. A marker with only ones varies."""
    return (F.col("n_valid") > 0) & ((F.col("n0") == F.col("n_valid")) | (F.col("n2") == F.col("n_valid")))


def major_allele() -> Column:
    return F.when((F.col("n0") >= F.col("n1")) & (F.col("n0") >= F.col("n2")), 0).when(F.col("n1") >= F.col("n2"), 1).otherwise(2)


def filter_markers(counts: DataFrame, *, min_mac: float = 0, min_maf: float = 0.0, max_missing: float = 1.0, drop_monomorphic: bool = False, drop_all_missing: bool = True, over_all: bool = False, max_dosage: float = 2.0) -> DataFrame:
    """Rows of ``marker_counts`` that pass every filter that is on."""
    kept = counts
    if drop_all_missing:
        kept = kept.where(F.col("n_valid") > 0)
    if drop_monomorphic:
        kept = kept.where(~monomorphic())
    if max_missing < 1.0:
        kept = kept.where(missing_rate() <= max_missing)
    if min_maf > 0:
        kept = kept.where((maf_over_all(max_dosage) if over_all else maf(max_dosage)) >= min_maf)
    if min_mac > 0:
        kept = kept.where(mac(max_dosage) >= min_mac)
    return kept


def impute_long(long: DataFrame, marker: str = "marker", dosage: str = "dosage") -> DataFrame:
    """Missing dosages replaced by the marker's major call; the join is on the marker."""
    major = marker_counts(long, marker, dosage).select(marker, major_allele().alias("major"))
    return long.join(major, marker).withColumn(dosage, F.coalesce(valid(F.col(dosage)).cast("int"), F.col("major"))).drop("major")


def first_per_id(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """Of rows that repeat an identifier the first in order stays."""
    window = Window.partitionBy(id_col).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def mean_per_id(rows: DataFrame, id_col: str, values: list[str]) -> DataFrame:
    """Rows that repeat an identifier become one with the mean of each column, nulls left out."""
    return rows.groupBy(id_col).agg(*[F.avg(c).alias(c) for c in values])


# ---- Arrow, over marker rows

_COUNTS = "marker_idx long, n_valid long, n_samples long, alleles long, squares long, n0 long, n1 long, n2 long"


def call_counts(geno: Genotypes) -> DataFrame:
    """``marker_counts`` of marker rows; narrow."""
    n = geno.n

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, g in decoded(batches, n):
            ok = g >= 0
            x = np.where(ok, g, 0).astype(np.int64)
            columns = [ids, ok.sum(1), np.full(len(ids), n), x.sum(1), (x * x).sum(1), *[(g == v).sum(1) for v in (0, 1, 2)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in _COUNTS.split(", ")])

    return geno.calls.mapInArrow(over, _COUNTS)


def keep_by_mac(geno: Genotypes, min_mac: float = 10, max_dosage: float = 2.0) -> Genotypes:
    """Markers with a minor allele count of at least ``min_mac``; 0 or less turns the filter off. One narrow pass."""
    if min_mac <= 0:
        return geno

    def keep(batches):
        for ids, chroms, g in batches:
            ok = g >= 0
            alleles = np.where(ok, g, 0).sum(1, dtype=np.float64)
            stay = np.minimum(alleles, max_dosage * ok.sum(1) - alleles) >= min_mac
            if stay.any():
                yield ids[stay], chroms[stay], g[stay]

    out = Genotypes(geno.samples, map_calls(geno.calls, geno.n, keep), geno.markers, geno.imputed, {k: v for k, v in geno.metadata.items() if k != "n_markers"})
    return out
