"""Tables that plots are drawn from: genome layout, decimated points, quantile and density data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusforge.functions.labels import natural_key_column
from locusforge.operators.statistics import p_histogram, qq_histogram, usable

#: Points with -log10 p of at least this are all kept.
KEEP_FROM = 1.0


def minus_log10(p: Column) -> Column:
    return F.when(usable(p), -F.log10(p))


def genome_layout(markers: DataFrame, gap_share: float = 0.01) -> DataFrame:
    """``chrom, code, first, last, offset, tick``: chromosomes in natural order side by side with gaps. A row each."""
    per = markers.where(F.col("pos").isNotNull()).groupBy("chrom").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    length = (F.col("last") - F.col("first") + 1).cast("double")
    order = Window.orderBy("_key", "chrom")
    gap = F.sum(length).over(Window.partitionBy()) * gap_share
    out = per.withColumn("_key", natural_key_column(F.col("chrom"))).withColumns({"_len": length, "_gap": gap})
    out = out.withColumn("code", F.row_number().over(order))
    before = F.coalesce(F.sum(F.col("_len") + F.col("_gap")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return out.withColumn("offset", before).select("chrom", "code", "first", "last", "offset", (F.col("offset") + F.col("_len") / 2).alias("tick"))


def manhattan_points(results: DataFrame, markers: DataFrame, *, p: str = "p", gap_share: float = 0.01) -> DataFrame:
    """``marker_idx, chrom, code, x, y`` of tested markers; the layout has a row for each chromosome."""
    layout = genome_layout(markers, gap_share)
    placed = results.where(usable(F.col(p))).join(markers.select("marker_idx", "chrom", "pos"), "marker_idx").join(layout, "chrom")
    return placed.select("marker_idx", "chrom", "code", (F.col("pos") - F.col("first") + F.col("offset")).alias("x"), minus_log10(F.col(p)).alias("y"))


def decimate(points: DataFrame, *, share: float = 0.1, least: int = 1000, seed: int = 42, y: str = "y") -> DataFrame:
    """All points from ``KEEP_FROM`` up; of the others a share drawn by hash, at least ``least``."""
    low = points.where(F.col(y) < KEEP_FROM)
    count = low.count()
    rate = min(1.0, max(share, least / max(1, count)))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "marker_idx"), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))
    return points.where((F.col(y) >= KEEP_FROM) | drawn)


def capped_by_height(points: DataFrame, *, top: int = 10_000, per_bin: int = 1000, width: float = 0.1, y: str = "y") -> DataFrame:
    """The ``top`` highest points, and up to ``per_bin`` of each stretch of heights. The caps are what the plot is for."""
    highest = points.orderBy(F.desc(y), "marker_idx").limit(top).select("marker_idx")
    each = Window.partitionBy(F.floor(F.col(y) / width)).orderBy(F.xxhash64("marker_idx"))
    some = points.withColumn("_n", F.row_number().over(each)).where(F.col("_n") <= per_bin).select("marker_idx")
    return points.join(highest.union(some).distinct(), "marker_idx", "left_semi")


def rmip_points(markers: DataFrame, shares: DataFrame) -> DataFrame:
    """Every marker with its resampling share, 0 where it was never found."""
    return markers.join(shares.select("marker_idx", "rmip"), "marker_idx", "left").withColumn("rmip", F.coalesce("rmip", F.lit(0.0)))


def panels(results: dict[str, DataFrame], markers: DataFrame, p: str = "p") -> DataFrame:
    """Points of several methods under each other, with the column ``method``."""
    out = None
    for name, found in results.items():
        one = manhattan_points(found, markers, p=p).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no results")
    return out


def density(results: DataFrame, p: str = "p") -> dict[str, DataFrame]:
    """Histograms of p and of -log10 p in fifty bins."""
    logs = results.select(minus_log10(F.col(p)).alias("y")).where("y is not null")
    high = logs.agg(F.max("y")).first()[0] or 1.0
    return {"p": p_histogram(results, p), "log": logs.select(F.least(F.floor(F.col("y") / high * 50), F.lit(49)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))}


quantiles = qq_histogram
