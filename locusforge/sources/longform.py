"""Marker rows from a long table of (sample, marker, dosage) that may leave out zeros."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.functions.labels import positional_index
from locusforge.model import CELLS, ENTRY, MARKERS, MISSING, Genotypes, encoded, encoded_entries

#: Samples up to which their places are sent to all.
SENT = 2_000_000


def from_long(long: DataFrame, samples: list[str], markers: DataFrame, *, sample: str = "sample_id", marker: str = "marker", dosage: str = "dosage", absent: int = 0) -> Genotypes:
    """``markers`` has marker, chrom, pos (ref and alt if known). A pair without a row has dosage ``absent``; null is missing.

    One shuffle by marker; a marker's rows are at most the samples. A marker takes the room of its rows, not of all samples.
    """
    spark = long.sparkSession
    have = {c: F.col(c).cast("string") if c in markers.columns else F.lit(None).cast("string") for c in ("ref", "alt")}
    table = markers.select(F.col("marker").cast("string").alias("marker"), F.col("chrom").cast("string").alias("chrom"), F.col("pos").cast("long").alias("pos"), have["ref"].alias("ref"), have["alt"].alias("alt"))
    table = positional_index(table, ["chrom", "pos", "marker"], "marker_idx").select(*[c.split()[0] for c in MARKERS.split(", ")]).persist()
    n = len(samples)
    places = spark.createDataFrame(pa.table({"_s": pa.array(map(str, samples), pa.string()), "_i": pa.array(range(n), pa.int32())}))
    rows = long.select(F.col(sample).cast("string").alias("_s"), F.col(marker).cast("string").alias("marker"), F.coalesce(F.col(dosage).cast("int"), F.lit(MISSING)).alias("_d"))
    packed = rows.join(F.broadcast(places) if n <= SENT else places, "_s").groupBy("marker").agg(F.collect_list(F.struct("_i", "_d")).alias("_c"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("_c")), 0).to_numpy().astype(np.int64)
            # A slice has an eighth of a kernel's cells: as many entries, or rows of all samples.
            wide = np.where((ENTRY.itemsize * size >= n) | (absent != 0), n, size)
            for own in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(wide) // (CELLS >> 3))) + 1):
                if len(own):
                    yield packed_rows(batch.slice(own[0], len(own)), size[own])

    def packed_rows(batch: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
        cells = batch.column("_c").flatten()
        row = np.repeat(np.arange(len(size)), size)
        at, call = cells.field("_i").to_numpy().astype(np.int64), cells.field("_d").to_numpy().astype(np.int8)
        key = row * n + at
        order = np.argsort(key, kind="stable")
        last = np.append(np.diff(key[order]) != 0, True)[: len(key)]
        row, at, call = (c[order][last] for c in (row, at, call))
        ids, chroms = batch.column("marker_idx").to_numpy(), batch.column("chrom").to_pylist()
        if absent == 0:
            some = call != 0
            return encoded_entries(ids, chroms, row[some], at[some], call[some], n)
        g = np.full((len(size), n), absent, np.int8)
        g[row, at] = call
        return encoded(ids, chroms, g)

    calls = table.join(packed, "marker", "left").select("marker_idx", "chrom", "_c").mapInArrow(over, "marker_idx long, chrom string, g binary")
    return Genotypes(list(map(str, samples)), calls, table, False)
