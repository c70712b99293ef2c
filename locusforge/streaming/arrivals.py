"""Allele counts that follow arriving calls, as a structured stream.

Counts are sums, so a stream of (marker, dosage) rows keeps one row of state a marker and never sees old rows again; what
the batch functions derive from counts (frequencies, filters) works on its output unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locusforge.operators.quality import marker_counts


def counts_of_stream(calls: DataFrame, *, marker: str = "marker", dosage: str = "dosage") -> DataFrame:
    """The streaming aggregate of ``marker_counts``; write it in update or complete mode."""
    if not calls.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return marker_counts(calls, marker, dosage)


def counts_by_time(calls: DataFrame, *, time: str, late: str = "1 hour", window: str = "1 day", marker: str = "marker", dosage: str = "dosage") -> DataFrame:
    """Counts for each marker and window of arrival; rows later than ``late`` are left out, so state is bounded."""
    d = F.when(F.col(dosage) >= 0, F.col(dosage))
    grouped = calls.withWatermark(time, late).groupBy(F.window(time, window).alias("period"), marker)
    return grouped.agg(F.count(d).alias("n_valid"), F.count(F.lit(1)).alias("n_samples"), F.coalesce(F.sum(d.cast("long")), F.lit(0)).alias("alleles"))


def keep_counts(calls: DataFrame, path: str, checkpoint: str, **names: str) -> StreamingQuery:
    """Process what is there and keep the counts as a table: each batch writes a whole new version under ``path/v=N``.

    The checkpoint makes restarts go on where they were; a batch that is repeated writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number:08d}")

    stream = counts_of_stream(calls, **names).writeStream.outputMode("complete").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark, path: str) -> DataFrame:
    """The last version that ``keep_counts`` wrote."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("v")).first()[0]
    return every.where(F.col("v") == last).drop("v")
