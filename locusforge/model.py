"""The data model: samples in a fixed order, a marker table, and one row of calls for each marker.

Samples are hundreds to thousands and live on the driver; markers are millions and stay distributed. ``calls`` has a row
for each marker with its dosages as bytes in sample order, so a partition is a batch of markers and a scan of all markers
needs no shuffle. Where most dosages are 0 a row holds the others only, as records of place and call: it is then shorter than
the samples are many, which tells the two forms apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = -9
CALLS = "marker_idx long, chrom string, g binary"
MARKERS = "marker_idx long, marker string, chrom string, pos long, ref string, alt string"
#: Marker rows that a kernel takes at once, and cells (32 MB of them as doubles).
BATCH, CELLS = 4096, 4 << 20
#: A call that is not 0, in a row of few.
ENTRY = np.dtype([("at", "<i4"), ("call", "i1")])


@dataclass
class Sparse:
    """Markers by samples, mostly 0: ``value[k]`` stands in row ``row[k]`` at sample ``at[k]``, by row and sample."""

    shape: tuple[int, int]
    row: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return self.shape[0]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Of each row."""
        return np.bincount(self.row, weights, self.shape[0])

    def times(self, x: np.ndarray) -> np.ndarray:
        """The product with samples by columns."""
        return np.stack([self.sums(self.value * x[self.at, j]) for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros((self.shape[0], 0))


@dataclass
class Columns:
    """Few markers, samples by markers: ``cells`` at the samples ``at`` (ascending), 0 at all others."""

    n: int
    at: np.ndarray
    cells: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return self.n, self.cells.shape[1]

    def take(self, index: Sequence[int] | slice) -> Columns:
        return Columns(self.n, self.at, self.cells[:, index])

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape)
        out[self.at] = self.cells
        return out

    def correlations(self) -> np.ndarray:
        """Calls are whole numbers, so the centred products are exact up to the last division."""
        total = self.cells.sum(0)
        c = self.n * (self.cells.T @ self.cells) - np.outer(total, total)
        length = np.sqrt(np.maximum(np.diag(c), 0))
        safe = np.where(length > 0, length, 1.0)
        return np.where(np.outer(length, length) > 0, c / np.outer(safe, safe), 0.0)

    @staticmethod
    def of(rows: Sparse) -> Columns:
        at, place = np.unique(rows.at, return_inverse=True)
        cells = np.zeros((len(at), rows.shape[0]))
        cells[place, rows.row] = rows.value
        return Columns(rows.shape[1], at, cells)


@dataclass
class Genotypes:
    """``samples``: identifiers in byte order of ``g``. ``calls``: marker_idx, chrom, g. ``markers``: the marker table."""

    samples: list[str]
    calls: DataFrame
    markers: DataFrame
    imputed: bool = False
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.calls.sparkSession

    @property
    def n(self) -> int:
        return len(self.samples)

    def count(self) -> int:
        if "n_markers" not in self.metadata:
            self.metadata["n_markers"] = self.calls.count()
        return self.metadata["n_markers"]

    def take_samples(self, index: Sequence[int]) -> Genotypes:
        """The samples at the given places, in that order."""
        at = np.asarray(index, np.int64)

        n, shared, once = self.n, self.spark.sparkContext.broadcast(at.astype(np.int32)), len(np.unique(at)) == len(at)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = shared.value
            place = np.full(n, -1, np.int32)
            place[at] = np.arange(len(at), dtype=np.int32)
            for ids, chroms, g in held(batches, n) if once else decoded(batches, n):
                if isinstance(g, Sparse):
                    to = place[g.at]
                    stay = to >= 0
                    yield encoded_entries(ids, chroms, g.row[stay], to[stay], g.value[stay], len(at))
                else:
                    yield encoded(ids, chroms, g[:, at])

        calls = self.calls.select("marker_idx", "chrom", "g").mapInArrow(over, CALLS)
        return replace(self, samples=[self.samples[i] for i in at], calls=calls, metadata=dict(self.metadata))

    def take_markers(self, keep: DataFrame) -> Genotypes:
        """The markers in ``keep(marker_idx)``; indices stay those of the whole."""
        return replace(self, calls=self.calls.join(keep.select("marker_idx"), "marker_idx", "left_semi"), markers=self.markers.join(keep.select("marker_idx"), "marker_idx", "left_semi"), metadata={k: v for k, v in self.metadata.items() if k != "n_markers"})

    def columns(self, index: Sequence[int]) -> np.ndarray:
        """Samples by markers, of few markers, in the order asked for."""
        wanted = [int(i) for i in index]
        rows = {i: dense_row(g, self.n) for i, g in self._rows(wanted).items()}
        return np.stack([rows[i] for i in wanted], 1) if wanted else np.zeros((self.n, 0), np.int8)

    def sparse_columns(self, index: Sequence[int], fill: str | float = "major") -> Columns:
        """The same, missing calls replaced, without the samples at which all are 0."""
        wanted = [int(i) for i in index]
        rows = self._rows(wanted)
        parts = [filled(entries_of([rows[i]], self.n), fill) for i in wanted]
        lengths = [len(p.at) for p in parts]
        if not wanted:
            return Columns(self.n, np.zeros(0, np.int64), np.zeros((0, 0)))
        return Columns.of(Sparse((len(wanted), self.n), np.repeat(np.arange(len(wanted)), lengths), np.concatenate([p.at for p in parts]), np.concatenate([p.value for p in parts])))

    def _rows(self, wanted: list[int]) -> dict[int, bytes]:
        return {r.marker_idx: bytes(r.g) for r in self.calls.where(F.col("marker_idx").isin(sorted(set(wanted)))).select("marker_idx", "g").collect()} if wanted else {}

    def matrix(self) -> np.ndarray:
        """Samples by markers in marker order; for tests and small panels only."""
        rows = sorted(self.calls.select("marker_idx", "g").collect(), key=lambda r: r.marker_idx)
        return np.stack([dense_row(bytes(r.g), self.n) for r in rows], 1) if rows else np.zeros((self.n, 0), np.int8)

    def long(self) -> DataFrame:
        """``sample_idx, marker_idx, dosage`` with null for missing."""
        n = self.n

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, _, g in decoded(batches, n):
                flat = g.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), len(ids))), pa.array(np.repeat(ids, n)), pa.array(flat, mask=flat < 0)], names=["sample_idx", "marker_idx", "dosage"])

        return self.calls.select("marker_idx", "chrom", "g").mapInArrow(over, "sample_idx int, marker_idx long, dosage tinyint")

    @staticmethod
    def from_matrix(spark: SparkSession, matrix, *, samples: Sequence[str] | None = None, markers: pd.DataFrame | None = None, imputed: bool = False, parts: int = 4) -> Genotypes:
        """From a samples-by-markers array (NaN or -9: missing) and a marker table with MARKER, CHROM, POS."""
        m = np.asarray(matrix)
        if m.dtype.kind == "f":
            m = np.where(np.isfinite(m), m, MISSING)
        m = m.astype(np.int8)
        n, k = m.shape
        if markers is None:
            markers = pd.DataFrame({"MARKER": [f"m{i}" for i in range(k)], "CHROM": "1", "POS": np.arange(1, k + 1)})
        if len(markers) != k:
            raise ValueError(f"the map has {len(markers)} markers, the matrix {k}")
        at = lambda name, i: None if name not in markers else str(markers[name].iloc[i])
        rows = [(i, str(markers["MARKER"].iloc[i]), str(markers["CHROM"].iloc[i]), int(markers["POS"].iloc[i]), at("REF", i), at("ALT", i)) for i in range(k)]
        table = spark.createDataFrame(rows, MARKERS).repartition(max(1, min(parts, k or 1)))
        calls = spark.createDataFrame([(i, r[2], bytearray(np.ascontiguousarray(m[:, i]).tobytes())) for i, r in enumerate(rows)], CALLS)
        calls = calls.repartitionByRange(max(1, min(parts, k or 1)), "marker_idx")
        return Genotypes([str(s) for s in samples] if samples is not None else [f"s{i}" for i in range(n)], calls, table, imputed, {"n_markers": k})


def dense_row(raw: bytes, n: int) -> np.ndarray:
    """The calls of one row in either form."""
    if len(raw) == n:
        return np.frombuffer(raw, np.int8)
    out, entries = np.zeros(n, np.int8), np.frombuffer(raw, ENTRY)
    out[entries["at"]] = entries["call"]
    return out


def entries_of(rows: Sequence[bytes], n: int) -> Sparse:
    """Rows in either form as entries."""
    if all(len(raw) < n for raw in rows):
        lengths, entries = [len(raw) // ENTRY.itemsize for raw in rows], np.frombuffer(b"".join(rows), ENTRY)
        return Sparse((len(rows), n), np.repeat(np.arange(len(rows)), lengths), entries["at"].astype(np.int64), entries["call"].astype(np.int8))
    places = [np.flatnonzero(dense_row(raw, n)) for raw in rows]
    value = np.concatenate([dense_row(raw, n)[at] for raw, at in zip(rows, places)])
    return Sparse((len(rows), n), np.repeat(np.arange(len(rows)), [len(at) for at in places]), np.concatenate(places), value)


def decoded(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(marker_idx, chrom, markers by samples) of Arrow batches of calls."""
    step = max(1, min(BATCH, CELLS // max(1, n)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            if part.num_rows:
                rows = part.column("g").to_pylist()
                if any(len(raw) < n for raw in rows):
                    g = np.stack([dense_row(raw, n) for raw in rows])
                else:
                    g = np.frombuffer(b"".join(rows), np.int8).reshape(part.num_rows, n)
                yield part.column("marker_idx").to_numpy(), np.asarray(part.column("chrom").to_pylist(), object), g


def held(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | Sparse]]:
    """The same, but rows of few calls come as entries, up to an eighth of the cells of a slice at once; the rest as cells."""
    for batch in batches:
        size = pc.binary_length(batch.column("g")).to_numpy()
        few = np.flatnonzero(size < n)
        if len(few) < batch.num_rows:
            yield from decoded(iter([batch.filter(pa.array(size >= n))]), n)
        group = np.cumsum(size[few]) // (ENTRY.itemsize * (CELLS >> 3))
        for own in np.split(few, np.flatnonzero(np.diff(group)) + 1) if len(few) else []:
            for start in range(0, len(own), BATCH):
                part = batch.take(pa.array(own[start : start + BATCH]))
                yield part.column("marker_idx").to_numpy(), np.asarray(part.column("chrom").to_pylist(), object), entries_of(part.column("g").to_pylist(), n)


def encoded(ids: np.ndarray, chroms: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    rows = np.ascontiguousarray(g.astype(np.int8))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(chroms), pa.string()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["marker_idx", "chrom", "g"])


def encoded_entries(ids, chroms, row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> pa.RecordBatch:
    """Calls from entries by row; each row takes its shorter form."""
    entries = np.empty(len(row), ENTRY)
    entries["at"], entries["call"] = at, value
    if len(at) and (np.diff(row * n + at) < 0).any():
        entries = entries[np.lexsort((at, row))]
    ends = np.searchsorted(row, np.arange(len(ids) + 1))
    raw = entries.tobytes()
    rows = [raw[ENTRY.itemsize * a : ENTRY.itemsize * b] for a, b in zip(ends, ends[1:])]
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        if ENTRY.itemsize * (b - a) >= n:
            whole = np.zeros(n, np.int8)
            whole[entries["at"][a:b]] = entries["call"][a:b]
            rows[i] = whole.tobytes()
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(chroms), pa.string()), pa.array(rows, pa.binary())], names=["marker_idx", "chrom", "g"])


def map_calls(calls: DataFrame, n: int, kernel: Callable, schema: str | None = None, build: Callable | None = None) -> DataFrame:
    """Run ``kernel`` over decoded batches. Without ``schema`` it yields calls, else what ``build`` makes a batch of."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in kernel(decoded(batches, n)):
            yield encoded(*out) if build is None else build(out)

    return calls.select("marker_idx", "chrom", "g").mapInArrow(over, schema or CALLS)


def filled(g: np.ndarray | Sparse, how: str | float) -> np.ndarray | Sparse:
    """Markers by samples as floats, missing replaced: ``major`` (most frequent call, ties the smallest), ``mean``, or a number."""
    if isinstance(g, Sparse):
        return _filled_entries(g, how)
    x = g.astype(np.float64)
    gap = g < 0
    if not gap.any():
        return x
    if how == "major":
        value = major_calls(g).astype(float)
    elif how == "mean":
        count = (~gap).sum(1)
        value = np.where(count > 0, np.where(gap, 0, x).sum(1) / np.maximum(count, 1), 0.0)
    else:
        value = np.full(len(g), float(how))
    return np.where(gap, value[:, None], x)


def _filled_entries(g: Sparse, how: str | float) -> Sparse:
    x, gap = g.value.astype(np.float64), g.value < 0
    if gap.any():
        missing = g.sums(gap)
        if how == "major":
            top = max(2, int(g.value.max(initial=0)))
            counts = np.stack([g.shape[1] - g.sums(g.value != 0), *(g.sums(g.value == v) for v in range(1, top + 1))], 1)
            value = counts.argmax(1).astype(float)
        elif how == "mean":
            value = g.sums(np.where(gap, 0, x)) / np.maximum(g.shape[1] - missing, 1)
        else:
            value = np.full(len(g), float(how))
        x = np.where(gap, value[g.row], x)
    return Sparse(g.shape, g.row, g.at, x)


def major_calls(g: np.ndarray) -> np.ndarray:
    """Most frequent call of each marker; ties go to the smallest, no calls to 0."""
    top = max(2, int(g.max(initial=0)))
    counts = np.stack([(g == v).sum(1) for v in range(top + 1)], 1)
    return counts.argmax(1)


def impute_major(geno: Genotypes) -> Genotypes:
    """Missing calls replaced by each marker's most frequent call."""
    if geno.imputed:
        return geno
    calls = map_calls(geno.calls, geno.n, lambda batches: ((i, c, filled(g, "major")) for i, c, g in batches))
    return replace(geno, calls=calls, imputed=True, metadata=dict(geno.metadata))
