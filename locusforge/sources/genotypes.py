"""Readers of genotype files and the Parquet store that later reads use.

Text formats are read as lines, so large files split over tasks (plain text; a gzip file is one task and is spread right
after). Each record becomes a marker row on its own; markers keep their order of the file.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.functions.calls import call_dosage, letter_dosage, number_dosage
from locusforge.functions.labels import positional_index
from locusforge.model import CALLS, MARKERS, MISSING, Genotypes, impute_major, major_calls
from locusforge.sources.formats import MISSING_TOKENS, detect_format, detect_separator, first_lines, id_column, is_hapmap_header

_RECORD = "line long, sub int, marker string, chrom string, pos long, ref string, alt string, g binary"
_KIND = pa.schema([("line", pa.int64()), ("sub", pa.int32()), ("marker", pa.string()), ("chrom", pa.string()), ("pos", pa.int64()), ("ref", pa.string()), ("alt", pa.string()), ("g", pa.binary())])


@dataclass(frozen=True)
class Filters:
    """Which markers are kept while reading."""

    split_multiallelic: bool = True
    include_indels: bool = True
    drop_monomorphic: bool = False
    max_missing: float = 1.0
    min_maf: float = 0.0


def passes(g: np.ndarray, f: Filters, missing_is_major: bool, keep_all_missing: bool = False) -> bool:
    """``missing_is_major``: whether frequencies count missing calls as major alleles or leave them out."""
    ok = g >= 0
    n = int(ok.sum())
    if not n:
        return keep_all_missing and not f.drop_monomorphic and f.max_missing >= 1.0 and f.min_maf <= 0
    x = g[ok]
    if f.drop_monomorphic and ((x == 0).all() or (x == 2).all()):
        return False
    if f.max_missing < 1.0 and 1 - n / len(g) > f.max_missing:
        return False
    if f.min_maf > 0:
        alleles = float(x.sum())
        minor = min(alleles, 2 * n - alleles)
        if minor / (2 * (len(g) if missing_is_major else n)) < f.min_maf:
            return False
    return True


def _imputed(g: np.ndarray) -> np.ndarray:
    return np.where(g < 0, major_calls(g[None])[0], g).astype(np.int8)


def _collected(spark: SparkSession, records: DataFrame, samples: list[str], imputed: bool = True) -> Genotypes:
    """Records in file order as genotypes; each is decoded once and held while markers are counted and written."""
    table = positional_index(records, ["line", "sub"], "marker_idx")
    kept = _first_of_each(samples)
    if len(kept) < len(samples):
        warnings.warn(f"{len(samples) - len(kept)} repeated samples are dropped; the first of each stays", stacklevel=4)
    geno = Genotypes(samples, table.select(*[c.split()[0] for c in CALLS.split(", ")]), table.select(*[c.split()[0] for c in MARKERS.split(", ")]), imputed)
    return geno if len(kept) == len(samples) else geno.take_samples(kept)


def _first_of_each(samples: list[str]) -> list[int]:
    seen: set[str] = set()
    return [i for i, s in enumerate(samples) if not (s in seen or seen.add(s))]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")
    if path.endswith((".gz", ".bgz")):
        lines = lines.repartition(max(2, spark.sparkContext.defaultParallelism))
    return lines


def _parsed(lines: DataFrame, parse: Callable[[str], list[tuple]]) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows = [(i, k, *r) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for k, r in enumerate(parse(text or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_KIND)], schema=_KIND)

    return lines.mapInArrow(over, _RECORD)


# ---------------------------------------------------------------- variant call format


def parse_vcf_line(text: str, n: int, f: Filters, cache: dict) -> list[tuple]:
    """Markers of one record: one for each alternative allele if split, else of records with a single one."""
    if not text or text[0] == "#":
        return []
    head = text.split("\t", 9)
    if len(head) < 10:
        return []
    chrom, pos, name, ref, alts = head[:5]
    keys = head[8].split(":")
    cells = head[9].split("\t")
    if len(cells) != n:
        raise ValueError(f"a record at {chrom}:{pos} has {len(cells)} calls, the header {n} samples")
    gt = keys.index("GT") if "GT" in keys else -1
    ds = keys.index("DS") if "DS" in keys else -1
    if gt < 0 and ds < 0:
        return []
    alleles = alts.split(",")
    if len(alleles) > 1 and not f.split_multiallelic:
        return []
    out = []
    for k, alt in enumerate(alleles, 1):
        if not f.include_indels and not (len(ref) == 1 and len(alt) == 1):
            continue
        g = np.empty(n, np.int8)
        for i, cell in enumerate(cells):
            key = (cell, k, gt, ds, len(alleles))
            value = cache.get(key)
            if value is None:
                fields = cell.split(":")
                value = call_dosage(fields[gt], k) if 0 <= gt < len(fields) else MISSING
                if value < 0 and 0 <= ds < len(fields):
                    parts = fields[ds].split(",")
                    value = number_dosage(parts[k - 1]) if k <= len(parts) else MISSING
                if len(cache) < 100_000:
                    cache[key] = value
            g[i] = value
        if passes(g, f, missing_is_major=True):
            marker = name if name not in (".", "") else f"{chrom}:{pos}:{ref}:{alt}"
            if len(alleles) > 1 and name not in (".", ""):
                marker = f"{name}_{alt}"
            out.append((marker, chrom, int(pos), ref, alt, _imputed(g).tobytes()))
    return out


def read_vcf(spark: SparkSession, path: str, filters: Filters = Filters()) -> Genotypes:
    """Text variant files, plain or gzip. Calls of any ploidy; DS where GT is missing; other alleles make a call missing.

    Binary variant files have no reader here: convert them to text first.
    """
    if path.lower().endswith(".bcf"):
        raise ValueError("binary variant files are not read; convert to text")
    lines = _lines(spark, path)
    head = lines.where(F.col("value").startswith("#CHROM")).select("value").first()
    if head is None:
        raise ValueError(f"{path} has no #CHROM line")
    samples = head.value.split("\t")[9:]
    n = len(samples)
    cache: dict = {}
    return _collected(spark, _parsed(lines.where(~F.col("value").startswith("#")), lambda t: parse_vcf_line(t, n, filters, cache)), samples)


# ---------------------------------------------------------------- hapmap


def parse_hapmap_line(text: str, n: int, f: Filters) -> list[tuple]:
    cells = text.split("\t")
    if len(cells) != 11 + n:
        return []
    name, alleles, chrom, pos = (c.strip() for c in cells[:4])
    try:
        where = int(float(pos))
    except ValueError:
        return []
    pair = [a.strip().upper() for a in alleles.split("/")]
    if where <= 0 or len(pair) != 2:
        return []
    if not f.include_indels and not all(len(a) == 1 and a in "ACGT" for a in pair):
        return []
    g = np.array([letter_dosage(c, *pair) for c in cells[11:]], np.int8)
    return [(name, chrom, where, pair[0], pair[1], _imputed(g).tobytes())] if passes(g, f, missing_is_major=False) else []


def read_hapmap(spark: SparkSession, path: str, filters: Filters = Filters()) -> Genotypes:
    head = (first_lines(path, 1) or [""])[0]
    if not is_hapmap_header(head):
        raise ValueError(f"{path} has no HapMap header")
    samples = head.split("\t")[11:]
    n = len(samples)
    lines = _lines(spark, path).where(F.col("value") != head)
    return _collected(spark, _parsed(lines, lambda t: parse_hapmap_line(t, n, filters)), samples)


# ---------------------------------------------------------------- PLINK


def plink_paths(path: str) -> tuple[str, str, str]:
    prefix = path[:-4] if path.endswith((".bed", ".bim", ".fam")) else path
    out = tuple(f"{prefix}.{e}" for e in ("bed", "bim", "fam"))
    missing = [p for p in out if not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(f"missing {missing}")
    return out


#: Dosage of allele 1 for each two-bit code, lowest bits first. Fixed values of the format.
BED_CODES = (2, MISSING, 1, 0)


def read_plink(spark: SparkSession, path: str, filters: Filters = Filters()) -> Genotypes:
    """A bed file with its bim and fam. The map and the samples come from text; calls from ranges of the bed file's bytes.

    Ranges are read by seeking in the file, so it must lie where all executors see it.
    """
    bed, bim, fam = plink_paths(path)
    with open(bed, "rb") as f:
        if f.read(3) != b"\x6c\x1b\x01":
            raise ValueError(f"{bed} is not a marker-major bed file")
    samples = [(p[1] if len(p) > 1 else p[0]) for p in (r.value.split() for r in spark.read.text(fam).collect()) if p]
    n = len(samples)
    width = -(-n // 4)
    markers = (os.path.getsize(bed) - 3) // width if width else 0
    parts = F.split(F.trim("value"), r"\s+")
    table = positional_index(spark.read.text(bim).select(F.monotonically_increasing_id().alias("line"), parts.alias("p")).where(F.size("p") >= 6), ["line"], "row")
    table = table.select("row", F.col("p")[1].alias("marker"), F.col("p")[0].alias("chrom"), F.col("p")[3].cast("double").cast("long").alias("pos"), F.col("p")[5].alias("ref"), F.col("p")[4].alias("alt"))
    code = np.array([[BED_CODES[(b >> (2 * k)) & 3] for k in range(4)] for b in range(256)], np.int8)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(bed, "rb") as f:
            for batch in batches:
                rows = batch.column(0).to_numpy()
                for start in range(0, len(rows), 1024):
                    part = rows[start : start + 1024]
                    f.seek(3 + int(part[0]) * width)
                    raw = np.frombuffer(f.read(len(part) * width), np.uint8).reshape(len(part), width)
                    g = code[raw].reshape(len(part), -1)[:, :n]
                    keep = [i for i in range(len(part)) if passes(g[i], filters, missing_is_major=False, keep_all_missing=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[keep]), pa.array([_imputed(g[i]).tobytes() for i in keep], pa.binary())], names=["row", "g"])

    calls = spark.range(0, markers, 1, max(1, min(markers or 1, 4 * spark.sparkContext.defaultParallelism))).select(F.col("id").alias("row")).mapInArrow(over, "row long, g binary")
    records = calls.join(table, "row").select(F.col("row").alias("line"), F.lit(0).alias("sub"), "marker", "chrom", "pos", "ref", "alt", "g")
    return _collected(spark, records, samples)


# ---------------------------------------------------------------- numeric tables


def read_numeric(spark: SparkSession, path: str, *, separator: str | None = None, block: int = 1024) -> Genotypes:
    """A delimited table, a row for each sample: dosages, cut to whole numbers; what is no number is missing.

    Rows are split into blocks of markers which meet by block, so a wide table is turned without gathering it. Markers
    without a map lie on chromosome 1 at 1, 2, 3, ...
    """
    sep = separator or detect_separator(path)
    head = (first_lines(path, 1) or [""])[0]
    names = [c.strip().strip('"') for c in head.split(sep)]
    key = names.index(id_column(names))
    markers = [c for i, c in enumerate(names) if i != key]
    m = len(markers)
    lines = _lines(spark, path).where(F.col("value") != head)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = [c.strip().strip('"') for c in text.split(sep)]
                if len(cells) != m + 1:
                    continue
                ids.append((line, cells[key]))
                rows.append(np.array([_whole(c) for i, c in enumerate(cells) if i != key], np.int8))
            out = [(line, name, at // block, row[at : at + block].tobytes()) for (line, name), row in zip(ids, rows) for at in range(0, m, block)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.binary()))], names=["line", "sample", "block", "g"])

    blocks = lines.mapInArrow(over, "line long, sample string, block int, g binary").persist()
    order = [r.sample for r in blocks.where("block = 0").orderBy("line").select("sample").collect()]
    n = len(order)

    def turn(key, data):
        at = int(key[0].as_py()) * block
        rank = np.argsort(data.column("line").to_numpy(), kind="stable")
        raw = data.column("g").to_pylist()
        g = np.stack([np.frombuffer(raw[i], np.int8) for i in rank], 1)
        k = len(g)
        rows = [_imputed(g[i]).tobytes() for i in range(k)]
        index = range(at, at + k)
        return pa.table({"line": pa.array(index, pa.int64()), "sub": pa.array([0] * k, pa.int32()), "marker": [markers[i] for i in index], "chrom": ["1"] * k, "pos": pa.array([i + 1 for i in index], pa.int64()), "ref": pa.array([None] * k, pa.string()), "alt": pa.array([None] * k, pa.string()), "g": pa.array(rows, pa.binary())})

    return _collected(spark, blocks.groupBy("block").applyInArrow(turn, _RECORD), order) if n else Genotypes([], spark.createDataFrame([], CALLS), spark.createDataFrame([], MARKERS), True)


def _whole(text: str) -> int:
    if text in MISSING_TOKENS:
        return MISSING
    try:
        v = float(text)
    except ValueError:
        return MISSING
    return int(v) if -128 <= v <= 127 else MISSING


# ---------------------------------------------------------------- store


def write_store(geno: Genotypes, path: str, *, source: str | None = None, filters: Filters | None = None) -> None:
    """Calls by chromosome with counts that filters can prune on, markers, samples, and what they were made from."""
    from locusforge.operators.quality import call_counts, mac, maf

    counts = call_counts(geno).select("marker_idx", maf().alias("maf"), mac().alias("mac"), (F.col("n_samples") - F.col("n_valid")).alias("n_missing"))
    geno.calls.join(counts, "marker_idx").repartition("chrom").sortWithinPartitions("chrom", "marker_idx").write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/calls")
    geno.markers.write.mode("overwrite").parquet(f"{path}/markers")
    spark = geno.spark
    meta = {"samples": geno.samples, "imputed": geno.imputed, "filters": asdict(filters or Filters()), "source": source, "metadata": {k: v for k, v in geno.metadata.items() if isinstance(v, (int, float, str, dict, list))}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_store(spark: SparkSession, path: str) -> Genotypes:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    calls = spark.read.schema("marker_idx long, g binary, maf double, mac double, n_missing long, chrom string").parquet(f"{path}/calls")
    return Genotypes(meta["samples"], calls.select("marker_idx", "chrom", "g"), spark.read.parquet(f"{path}/markers"), meta["imputed"], meta["metadata"])


def store_is_fresh(spark: SparkSession, path: str, source: str, filters: Filters) -> bool:
    """Whether a store was made later than its source, with the same filters. No store or no record is not fresh."""
    done = f"{path}/meta/_SUCCESS"
    if not os.path.exists(done) or not os.path.exists(source) or os.path.getmtime(done) <= os.path.getmtime(source):
        return False
    try:
        return json.loads(spark.read.text(f"{path}/meta").first().value)["filters"] == asdict(filters)
    except (KeyError, ValueError, AttributeError):
        return False


# ---------------------------------------------------------------- dispatch


def read_genotypes(spark: SparkSession, path: str, *, fmt: str | None = None, filters: Filters = Filters(), cache: str | None = None, recache: bool = False, effective: bool = False) -> Genotypes:
    """Any known format. With ``cache``, a store there is read if it is fresh and written if not. ``effective`` adds Me."""
    fmt = (fmt or detect_format(path)).lower()
    source = path if os.path.exists(path) else f"{path}.bed"
    if fmt == "parquet":
        return read_store(spark, path)
    if cache and not recache and store_is_fresh(spark, cache, source, filters):
        geno = read_store(spark, cache)
    else:
        if fmt in ("csv", "tsv", "numeric"):
            if filters != Filters():
                warnings.warn("numeric tables are read without quality filters", stacklevel=2)
            geno = read_numeric(spark, path)
        else:
            geno = {"vcf": read_vcf, "hapmap": read_hapmap, "plink": read_plink}[fmt](spark, path, filters)
        if cache:
            write_store(geno, cache, source=source, filters=filters)
            geno = read_store(spark, cache)
    if effective and "effective_tests" not in geno.metadata:
        from locusforge.operators.effective import effective_tests

        geno = replace(geno, metadata={**geno.metadata, "effective_tests": {k: v for k, v in effective_tests(geno).items() if k != "chromosomes"}})
    return geno


def random_genotypes(spark: SparkSession, samples: int, markers: int, *, missing: float = 0.0, seed: int = 0, chromosomes: int = 2) -> Genotypes:
    """Random dosages with a given share of missing calls, for tests."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    g = rng.binomial(2, rng.uniform(0.1, 0.5, markers), (samples, markers)).astype(np.int8)
    g[rng.random(g.shape) < missing] = MISSING
    table = pd.DataFrame({"MARKER": [f"m{i}" for i in range(markers)], "CHROM": [str(1 + i * chromosomes // max(1, markers)) for i in range(markers)], "POS": np.arange(markers) * 1000 + 1})
    return Genotypes.from_matrix(spark, g, markers=table)


__all__ = ["Filters", "impute_major", "random_genotypes", "read_genotypes", "read_hapmap", "read_numeric", "read_plink", "read_store", "read_vcf", "store_is_fresh", "write_store"]
