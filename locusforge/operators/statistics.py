"""Multiple testing, inflation, quantile plots and result tables as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusforge.functions.tails import CHI2_MEDIAN, normal_critical



def usable(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & (p > 0) & (p <= 1)


def bonferroni(results: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adds ``p_bonferroni``, ``threshold`` and ``significant``; the number of tests is that of the rows."""
    total = results.count()
    limit = alpha / max(1, total)
    return results.withColumns({"p_bonferroni": F.least(F.col(p) * total, F.lit(1.0)), "threshold": F.lit(limit), "significant": F.col(p) <= limit})


def benjamini_hochberg(results: DataFrame, p: str = "p", alpha: float = 0.05, tie: str = "marker_idx") -> DataFrame:
    """Adds ``p_fdr`` and ``reject``: p times n over rank, with a running minimum from the largest p.

    Rows are range-partitioned by p, ranks come from the partitions' counts, and each partition's minimum is carried to the
    ones before it, so no task holds all rows.
    """
    return fdr_by_ranges(results, p, alpha, tie, results.count())


def fdr_by_ranges(results: DataFrame, p: str, alpha: float, tie: str, total: int) -> DataFrame:
    from locusforge.functions.labels import positional_index

    ranked = positional_index(results, [p, tie], "_rank").withColumn("_raw", F.col(p) * total / (F.col("_rank") + 1))
    ranked = ranked.withColumn("_bucket", F.spark_partition_id())
    least = {r["_bucket"]: r["m"] for r in ranked.groupBy("_bucket").agg(F.min("_raw").alias("m")).collect()}
    after, low = {}, 1.0
    for bucket in sorted(least, reverse=True):  # one number for each partition
        after[bucket], low = low, min(low, least[bucket])
    later = F.create_map(*[F.lit(x) for kv in after.items() for x in kv])[F.col("_bucket")] if after else F.lit(1.0)
    own = F.min("_raw").over(Window.partitionBy("_bucket").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("p_fdr", F.least(own, later, F.lit(1.0)))
    return out.withColumn("reject", F.col("p_fdr") <= alpha).drop("_rank", "_raw", "_bucket")


def genomic_inflation(results: DataFrame, p: str = "p") -> float:
    """Median chi-square of the usable p over its null median; 1.0 without any. Only the middle p values are inverted."""
    ok = results.where(usable(F.col(p)))
    low, high = ok.agg(F.expr(f"percentile_disc(0.5) within group (order by {p})"), F.expr(f"percentile_disc(0.5) within group (order by {p} desc)")).first()
    if low is None:
        return 1.0
    return (normal_critical(low) ** 2 + normal_critical(high) ** 2) / 2 / CHI2_MEDIAN


def inflation_of_statistics(results: DataFrame, statistic: str) -> float:
    middle = results.agg(F.median(statistic)).first()[0]
    return 1.0 if middle is None else middle / CHI2_MEDIAN


def qq_points(results: DataFrame, p: str = "p", tie: str = "marker_idx") -> DataFrame:
    """``rank, expected, observed``: sorted usable p against rank / (n + 1)."""
    from locusforge.functions.labels import positional_index

    ok = results.where(usable(F.col(p)))
    total = ok.count()
    ranked = positional_index(ok, [p, tie], "_at").select((F.col("_at") + 1).alias("rank"), F.col(p).alias("observed"))
    return ranked.select("rank", (F.col("rank") / (total + 1)).alias("expected"), "observed")


def qq_histogram(results: DataFrame, p: str = "p") -> DataFrame:
    """Quantile points for many markers: log10 p in up to 2000 bins, each at the middle of its share of ranks."""
    ok = results.where(usable(F.col(p))).select(F.log10(p).alias("l"))
    n, low = ok.agg(F.count(F.lit(1)), F.min("l")).first()
    if not n:
        return ok.select(F.lit(0).alias("bin"), "l", F.lit(0.0).alias("expected"), F.lit(0).cast("long").alias("n")).limit(0)
    bins = int(min(2000, max(50, n**0.5)))
    low = min(low, -1e-12)
    binned = ok.select(F.least(F.floor((F.col("l") - low) / -low * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2
    return binned.select("bin", (low + (F.col("bin") + 0.5) * (-low) / bins).alias("l"), (before / (n + 1)).alias("expected"), "n")


def p_histogram(results: DataFrame, p: str = "p", bins: int = 50) -> DataFrame:
    """``bin, n``: counts of usable p in equal bins of 0 to 1."""
    return results.where(usable(F.col(p))).select(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def run_summary(results: DataFrame, *, p: str = "p", effect: str = "effect", threshold: float = 5e-8, suggestive: float = 1e-5) -> DataFrame:
    """One row: markers, hits below the threshold and the suggestive one, least and middle p, effects."""
    ok = usable(F.col(p))
    return results.agg(
        F.count(F.when(ok, 1)).alias("n_markers"), F.count(F.when(ok & (F.col(p) < threshold), 1)).alias("n_significant"),
        F.count(F.when(ok & (F.col(p) < suggestive), 1)).alias("n_suggestive"), F.min(F.when(ok, F.col(p))).alias("min_p"),
        F.median(F.when(ok, F.col(p))).alias("median_p"), F.avg(effect).alias("mean_effect"), F.min(effect).alias("min_effect"), F.max(effect).alias("max_effect"),
    )


def pad(results: DataFrame, markers: DataFrame) -> DataFrame:
    """Every marker of the map; those not tested have nulls."""
    return markers.join(results, "marker_idx", "left")


def merge_methods(markers: DataFrame, results: dict[str, DataFrame], *, with_se: bool = False, p: str = "p") -> DataFrame:
    """The map with ``{method}_P``, ``{method}_Effect`` and, if asked for, ``{method}_SE`` for each method."""

    def add(table: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, found = item
        columns = [F.col(p).alias(f"{name}_P"), F.col("effect").alias(f"{name}_Effect")] + ([F.col("se").alias(f"{name}_SE")] if with_se else [])
        return table.join(found.select("marker_idx", *columns), "marker_idx", "left")

    return reduce(add, results.items(), markers)


def significant(merged: DataFrame, thresholds: dict[str, float], strict: bool = False) -> DataFrame:
    """Rows that any method finds, with ``Method``: its names joined by ``|``. ``p <= threshold``, or below it if strict."""
    hits = [F.when(F.col(f"{m}_P") < t if strict else F.col(f"{m}_P") <= t, F.lit(m)) for m, t in thresholds.items()]
    return merged.withColumn("Method", F.array_join(F.array_compact(F.array(*hits)), "|")).where("Method <> ''")


def best_per_bin(results: DataFrame, bin_size: float, *, score: str = "abs_t", chrom_rank: str = "chrom_rank", pos: str = "pos") -> DataFrame:
    """The marker with the highest score of each stretch of the genome; the smallest index of equals. Combines before the shuffle."""
    place = F.floor((F.col(pos) + F.col(chrom_rank) * F.lit(1e10)) / F.lit(float(bin_size))).cast("long")
    best = results.where(F.col(score).isNotNull()).groupBy(place.alias("bin")).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col("marker_idx")).alias("i"))).alias("b"))
    return best.select("bin", (-F.col("b.i")).alias("marker_idx"), F.col("b.s").alias(score))


def apply_prior(results: DataFrame, prior: DataFrame, p: str = "p") -> DataFrame:
    """p times the marker's weight; markers without one keep theirs."""
    return results.join(prior.select("marker", F.col("weight").alias("_w")), "marker", "left").withColumn(p, F.col(p) * F.coalesce("_w", F.lit(1.0))).drop("_w")


def resampling_share(hits: DataFrame, runs: int, marker: str = "marker_idx") -> DataFrame:
    """``rmip``: the share of runs in which a marker was found."""
    return hits.groupBy(marker).agg((F.countDistinct("run") / F.lit(runs)).alias("rmip"))
