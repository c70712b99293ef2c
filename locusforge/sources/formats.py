"""Formats, separators, columns and tables: what comes before genotypes are decoded."""

from __future__ import annotations

import gzip
import os
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that stand for a missing value. Fixed values.
MISSING_TOKENS = ("", "NA", "NaN", "nan", "NAN", "na", "N/A", "n/a", "Null", "NULL", ".", "-", "--")
#: Names of the identifier column, and of the columns of a marker map. Fixed values.
ID_NAMES = ("ID", "id", "IID", "sample", "Sample", "Taxa", "taxa", "Genotype", "genotype", "Accession", "accession")
MARKER_NAMES = ("MARKER", "marker", "Marker", "SNP", "snp", "rs", "RS")
CHROM_NAMES = ("CHROM", "Chr", "chr", "chromosome", "CHR")
POS_NAMES = ("POS", "Pos", "pos", "position", "bp")
HAPMAP_COLUMNS = ("rs", "alleles", "chrom", "pos", "strand", "assembly", "center", "protLSID", "assayLSID", "panelLSID", "QCcode")


def first_lines(path: str, count: int) -> list[str]:
    opener = gzip.open if path.endswith((".gz", ".bgz")) else open
    with opener(path, "rt", encoding="utf-8", errors="replace") as f:
        return [line.rstrip("\r\n") for line, _ in zip(f, range(count))]


def is_hapmap_header(line: str) -> bool:
    names = [n.strip().rstrip("#").lstrip("#") for n in line.split("\t")[: len(HAPMAP_COLUMNS)]]
    names = ["panelLSID" if n == "panel" else n for n in names]
    return len(names) == len(HAPMAP_COLUMNS) and all(a.lower() == b.lower() for a, b in zip(names, HAPMAP_COLUMNS))


def detect_format(path: str) -> str:
    """By extension, then by content: vcf, plink, hapmap, tsv, csv or parquet."""
    low = path.lower()
    if os.path.isdir(path) or low.endswith(".parquet"):
        return "parquet"
    for ends, name in (((".vcf", ".vcf.gz", ".vcf.bgz", ".bcf"), "vcf"), ((".bed", ".bim", ".fam"), "plink"), ((".hmp", ".hmp.txt", ".hmp.gz", ".hmp.txt.gz", ".hapmap"), "hapmap")):
        if low.endswith(ends):
            return name
    if not os.path.exists(path):
        if all(os.path.exists(path + e) for e in (".bed", ".bim", ".fam")):
            return "plink"
        raise FileNotFoundError(path)
    head = (first_lines(path, 1) or [""])[0]
    if head.startswith("##fileformat=VCF"):
        return "vcf"
    if is_hapmap_header(head):
        return "hapmap"
    if low.endswith((".tsv", ".txt", ".tab")) and "\t" in head:
        return "tsv"
    if low.endswith(".csv"):
        return "csv"
    return "tsv" if head.count("\t") > head.count(",") else "csv"


def detect_separator(path: str) -> str:
    """The more frequent of tab and comma in the first ten lines; comma on a draw, a space where there is neither."""
    text = "\n".join(first_lines(path, 10))
    if "\t" not in text and "," not in text and " " in text:
        return " "
    return "\t" if text.count("\t") > text.count(",") else ","


def id_column(columns: Sequence[str], wanted: str | None = None) -> str:
    """The column asked for, else the leftmost known name (several: a warning), else the first."""
    if wanted and wanted in columns:
        return wanted
    known = [c for c in columns if c in ID_NAMES]
    if len(known) > 1:
        warnings.warn(f"several identifier columns {known}; {known[0]} is used", stacklevel=3)
    return known[0] if known else columns[0]


def as_number(column: Column) -> Column:
    """A double, or null for missing tokens and for what is not a number."""
    text = F.trim(column.cast("string"))
    value = F.when(~text.isin(*MISSING_TOKENS), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def read_table(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A delimited file with a header, all columns as text."""
    return spark.read.csv(path, header=True, sep=separator or detect_separator(path), inferSchema=False, quote='"')


def tidy_names(columns: Sequence[str]) -> list[str]:
    """Blank names become TraitN, repeated ones get _2, _3, ..."""
    out: list[str] = []
    for i, name in enumerate(columns):
        base = name.strip() if name and not name.startswith("_c") else ("ID" if i == 0 else f"Trait{i}")
        new, k = base, 2
        while new in out:
            new, k = f"{base}_{k}", k + 1
        out.append(new)
    return out


def resolve_traits(columns: Sequence[str], wanted: Sequence[str] | None) -> list[str]:
    """Names as they are, then without case, then stripped; those not found only warn."""
    if wanted is None:
        return list(columns)
    out = []
    for name in wanted:
        found = next((c for c in columns if c == name), None) or next((c for c in columns if c.lower() == name.lower()), None) or next((c for c in columns if c.strip().lower() == name.strip().lower()), None)
        if found is None:
            warnings.warn(f"no column {name}", stacklevel=3)
        elif found not in out:
            out.append(found)
    return out


def _numbers_by_id(spark: SparkSession, path: str, wanted: Sequence[str] | None, id_name: str | None, strict: bool) -> DataFrame:
    raw = read_table(spark, path)
    if len(raw.columns) < 2:
        raise ValueError(f"{path} has fewer than two columns")
    raw = raw.toDF(*tidy_names(raw.columns))
    key = id_column(raw.columns, id_name)
    names = resolve_traits([c for c in raw.columns if c != key], wanted)
    if wanted is not None and not names:
        raise ValueError("none of the columns asked for is there")
    table = raw.select(F.trim(F.col(f"`{key}`").cast("string")).alias("ID"), *[F.col(f"`{c}`") for c in names])
    if strict:
        odd = {c: table.where(~F.trim(F.col(f"`{c}`")).isin(*MISSING_TOKENS) & as_number(F.col(f"`{c}`")).isNull()).select(c).first() for c in names}
        bad = {c: r[0] for c, r in odd.items() if r is not None}
        if bad:
            raise ValueError(f"covariates that are not numbers: {bad}")
    numbers = table.select("ID", *[as_number(F.col(f"`{c}`")).alias(c) for c in names])
    out = numbers.groupBy("ID").agg(*[F.avg(f"`{c}`").alias(c) for c in names]) if names else numbers.distinct()
    counts = out.agg(*[F.count(f"`{c}`").alias(c) for c in names]).first() if names else ()
    empty = [c for c in names if not counts[c]]
    if empty and (strict or wanted is None):
        if strict:
            warnings.warn(f"columns without values are dropped: {empty}", stacklevel=3)
        out = out.drop(*empty)
    return out


def read_phenotype(spark: SparkSession, path: str, traits: Sequence[str] | None = None, id_name: str | None = None) -> DataFrame:
    """``ID`` and traits as numbers; an identifier that repeats has the mean of its rows. Unasked, columns without any number go."""
    return _numbers_by_id(spark, path, traits, id_name, strict=False)


def read_covariates(spark: SparkSession, path: str, columns: Sequence[str] | None = None, id_name: str | None = None) -> DataFrame:
    """As phenotypes, but what is neither a number nor missing is an error."""
    return _numbers_by_id(spark, path, columns, id_name, strict=True)


def canonical_map(df: DataFrame) -> DataFrame:
    """``marker, chrom, pos`` and, where they are, ``ref, alt`` from a table under any of the known names."""
    pick = lambda names: next((n for n in names if n in df.columns), None)
    marker, chrom, pos = pick(MARKER_NAMES), pick(CHROM_NAMES), pick(POS_NAMES)
    if not (marker and chrom and pos):
        raise ValueError(f"a marker map needs a marker, a chromosome and a position column; it has {df.columns}")
    if "MARKER" in df.columns and "SNP" in df.columns and not df.where(F.col("MARKER") != F.col("SNP")).isEmpty():
        raise ValueError("the columns MARKER and SNP disagree")
    more = [F.col(c).cast("string").alias(c.lower()) for c in ("REF", "ALT") if c in df.columns]
    return df.select(F.col(marker).cast("string").alias("marker"), F.col(chrom).cast("string").alias("chrom"), F.col(pos).cast("double").cast("long").alias("pos"), *more)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return canonical_map(spark.read.parquet(path) if detect_format(path) == "parquet" else read_table(spark, path))


def validate_inputs(phenotype: str | None = None, genotype: str | None = None, marker_map: str | None = None) -> dict:
    """``valid`` and ``errors``: files that are missing or lack columns."""
    errors = []
    for what, path in (("phenotype", phenotype), ("genotype", genotype), ("map", marker_map)):
        if path is None:
            continue
        if not os.path.exists(path) and not os.path.exists(f"{path}.bed"):
            errors.append(f"{what} file {path} is missing")
        elif what != "genotype":
            names = (first_lines(path, 1) or [""])[0].split(detect_separator(path))
            if what == "phenotype" and len(names) < 2:
                errors.append("the phenotype file has fewer than two columns")
            if what == "map" and not all(any(n in names for n in known) for known in (MARKER_NAMES, CHROM_NAMES, POS_NAMES)):
                errors.append("the map file lacks a marker, chromosome or position column")
    return {"valid": not errors, "errors": errors}
