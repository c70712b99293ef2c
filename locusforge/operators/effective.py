"""Effective number of independent tests from linkage blocks, one group a chromosome."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.model import Columns, Genotypes, Sparse, dense_row, entries_of

#: Fixed values of the map from squared correlation to correlation of p-values, highest power first, without constant.
P_CORRELATION = (0.7723, -1.5659, 1.2010, -0.2355, 0.2184, 0.6086)
LEAST_VARIANCE = 1e-12
#: Pairs of markers that a task holds.
PAIRS = 1 << 16


@dataclass(frozen=True)
class BlockRules:
    """Blocks reach ``span`` bases from their start, have no wider gap than ``gap``, and neighbours correlate to ``correlation``.

    Up to ``undefined`` neighbours in a row may have no correlation. Of a block's markers those whose p-values would
    correlate to ``redundant`` or more with one before are left out.
    """

    span: int = 3_000_000
    gap: int = 3_000_000
    correlation: float = 0.7
    undefined: int = 500
    redundant: float = 0.9988


def p_correlation(r: np.ndarray) -> np.ndarray:
    """Correlation of p-values from that of markers, by the polynomial in r², kept within 0 and 1."""
    x = np.asarray(r, float) ** 2
    out = np.zeros_like(x)
    for c in P_CORRELATION:
        out = (out + c) * x
    return np.clip(out, 0.0, 1.0)


def correlations(g: np.ndarray) -> np.ndarray:
    """Pearson correlations of markers (rows); a marker without variance correlates with nothing but itself."""
    x = g - g.mean(1, keepdims=True)
    length = np.sqrt((x * x).sum(1))
    safe = np.where(length > 0, length, 1.0)
    r = (x @ x.T) / np.outer(safe, safe)
    r[length == 0] = 0
    r[:, length == 0] = 0
    np.fill_diagonal(r, 1.0)
    return r


def correlation_pairs(spark: SparkSession, g: np.ndarray, names: list[str], digits: int = 6) -> DataFrame:
    """``a, b, correlation`` of each pair of markers (rows), the first before the second. Markers are sent to all; a task makes
    the pairs of some rows, at most ``PAIRS`` of them at once."""
    x = g - g.mean(1, keepdims=True)
    length = np.sqrt((x * x).sum(1))
    m = len(names)
    shared = spark.sparkContext.broadcast((x / np.where(length > 0, length, 1.0)[:, None], pa.array(names, pa.string())))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, names = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for at in range(i + 1, m, PAIRS):
                    r = np.round(x[at : at + PAIRS] @ x[i], digits) + 0.0
                    yield pa.RecordBatch.from_arrays([pa.array([names[i].as_py()] * len(r)), names.slice(at, len(r)), pa.array(r)], names=["a", "b", "correlation"])

    parts = max(1, min(m, m * m // (16 * PAIRS)))
    return spark.range(0, m, 1, parts).mapInArrow(over, "a string, b string, correlation double")


def blocks(g: np.ndarray, pos: np.ndarray, rules: BlockRules) -> list[tuple[int, int]]:
    """(first, past last) of each block of markers in position order."""
    x = g - g.mean(1, keepdims=True)
    length = np.sqrt((x * x).sum(1))
    return _walk(length, lambda i: float(x[i - 1] @ x[i]), pos, rules)


def _walk(length: np.ndarray, product: Callable[[int], float], pos: np.ndarray, rules: BlockRules) -> list[tuple[int, int]]:
    """``product(i)``: of the centred markers i - 1 and i. The span counts from a block's own start, so the walk is sequential."""
    out, start, unknown = [], 0, 0
    for i in range(1, len(length) + 1):
        if i < len(length):
            defined = length[i - 1] * length[i] > LEAST_VARIANCE
            r = abs(product(i)) / (length[i - 1] * length[i]) if defined else 0.0
            unknown = 0 if defined else unknown + 1
            linked = r >= rules.correlation if defined else unknown <= rules.undefined
            if linked and pos[i] - pos[start] <= rules.span and pos[i] - pos[i - 1] <= rules.gap:
                continue
        out.append((start, i))
        start, unknown = i, 0
    return out


def effective_in_block(g: np.ndarray, rules: BlockRules) -> float:
    return _effective(correlations(g), rules)


def _effective(r: np.ndarray, rules: BlockRules) -> float:
    """1 for one marker, 2 - r for two, else the markers less what their eigenvalues exceed 1 by."""
    c = p_correlation(r)
    np.fill_diagonal(c, 1.0)
    kept: list[int] = []
    for i in range(len(c)):
        if not any(c[i, k] >= rules.redundant for k in kept):
            kept.append(i)
    c = c[np.ix_(kept, kept)]
    if len(kept) == 1:
        return 1.0
    if len(kept) == 2:
        return 2.0 - float(c[0, 1])
    values = np.linalg.eigvalsh(c)
    return float(len(kept) - np.maximum(values - 1.0, 0.0).sum())


def blocks_of_entries(raw: list[bytes], n: int, pos: np.ndarray, rules: BlockRules) -> list[tuple[int, int, int, float, int]]:
    """(start, end, markers, effective tests, largest gap) of the blocks of rows of few calls, in position order.

    Calls are whole numbers, so n times a centred product is exact: n times the product less that of the sums.
    """
    e = entries_of(raw, n)
    value = e.value.astype(np.float64)
    total, square = e.sums(value), e.sums(value * value)
    varies = (n * square - total * total) / (float(n) * n) > LEAST_VARIANCE
    stay, place = varies[e.row], np.cumsum(varies) - 1
    e, value = Sparse((int(varies.sum()), n), place[e.row[stay]], e.at[stay], value[stay]), value[stay]
    total, square, pos = total[varies], square[varies], pos[varies]
    key = e.row * n + e.at
    at = np.minimum(np.searchsorted(key, key + n), max(0, len(key) - 1))
    both = key[at] == key + n if len(key) else np.zeros(0, bool)
    product = np.bincount(e.row[both] + 1, value[both] * value[at[both]], len(total) + 1)
    length = np.sqrt(square - total * total / n)
    ends = np.searchsorted(e.row, np.arange(len(total) + 1))
    rows = []
    for a, b in _walk(length, lambda i: (product[i] - total[i - 1] * total[i] / n), pos, rules) if len(total) else []:
        me = 1.0
        if b - a > 1:
            own = slice(ends[a], ends[b])
            me = _effective(Columns.of(Sparse((b - a, n), e.row[own] - a, e.at[own], value[own])).correlations(), rules)
        rows.append((int(pos[a]), int(pos[b - 1]), int(b - a), me, int(np.diff(pos[a:b]).max(initial=0))))
    return rows


_OUT = "chrom string, start long, end long, n_snps int, me double, largest_gap long"


def linkage_blocks(geno: Genotypes, rules: BlockRules = BlockRules(), source: Callable | None = None) -> DataFrame:
    """``chrom, start, end, n_snps, me, largest_gap`` of each block; markers without variance take no part.

    ``source(chrom, marker_idx, pos, g)`` may replace the calls (markers by samples) by others of the same kind. A
    chromosome is one group, so it must fit one task as bytes: a million markers of a thousand samples are 1 GB; split
    longer ones by position before. Where rows are mostly of few calls, only entries are held.
    """
    n = geno.n
    placed = geno.calls.select("marker_idx", "g").join(geno.markers.select("marker_idx", "chrom", "pos"), "marker_idx")

    def over(key, table):
        order = np.lexsort((table.column("marker_idx").to_numpy(), table.column("pos").to_numpy()))
        pos, ids = table.column("pos").to_numpy()[order], table.column("marker_idx").to_numpy()[order]
        raw = table.column("g").to_pylist()
        raw = [raw[i] for i in order]
        if source is None and 4 * sum(map(len, raw)) < n * len(raw):
            rows = [(key[0].as_py(), *block) for block in blocks_of_entries(raw, n, pos, rules)]
        else:
            g = np.stack([dense_row(r, n) for r in raw])
            if source is not None:
                g = source(key[0].as_py(), ids, pos, g)
            keep = g.var(1) > LEAST_VARIANCE
            g, pos = g[keep], pos[keep]
            rows = []
            for a, b in blocks(g.astype(np.float32), pos, rules) if len(g) else []:
                rows.append((key[0].as_py(), int(pos[a]), int(pos[b - 1]), b - a, effective_in_block(g[a:b].astype(np.float64), rules), int(np.diff(pos[a:b]).max(initial=0))))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
        return pa.table({f.split()[0]: pa.array([r[i] for r in rows], k) for i, (f, k) in enumerate(zip(_OUT.split(", "), kinds))})

    return placed.groupBy("chrom").applyInArrow(over, _OUT)


def effective_tests(geno: Genotypes, rules: BlockRules = BlockRules(), source: Callable | None = None) -> dict:
    """``Me`` (rounded), ``total_snps`` with unvarying ones, and per chromosome ``me``, ``n_snps``, ``n_blocks``."""
    per = {r.chrom: {"me": r.me, "n_snps": r.n, "n_blocks": r.b} for r in linkage_blocks(geno, rules, source).groupBy("chrom").agg(F.sum("me").alias("me"), F.sum("n_snps").alias("n"), F.count(F.lit(1)).alias("b")).collect()}
    total = sum(c["me"] for c in per.values())
    return {"Me": int(math.floor(total + 0.5)), "Me_exact": total, "total_snps": geno.count(), "chromosomes": per}
