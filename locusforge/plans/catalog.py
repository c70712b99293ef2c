"""Registered queries over the driver's tables and their DuckDB equivalents.

The tables hold no genotypes, so calls are derived from sales: a sample is a customer, a marker a supplier or a part, and
the dosage how often the customer bought there, at most 2. Pairs without a sale have dosage 0 and no row. The trait is the
account balance; a chromosome is the supplier's nation or the part's size, a position the key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.functions.calls import gt_dosage
from locusforge.functions.labels import length_rank, natural_key_column
from locusforge.functions.tails import CHI2_MEDIAN, erfc_sql, normal_p
from locusforge.model import Genotypes, dense_row
from locusforge.operators import bayes, glm, mlm, multilocus, plotdata, quality, statistics, structure
from locusforge.operators.effective import correlation_pairs, linkage_blocks
from locusforge.sources.longform import from_long

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


# ---------------------------------------------------------------- derived tables


def dosage(spark: SparkSession, sf_dir: str, marker: str = "l_suppkey") -> DataFrame:
    sales = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return sales.groupBy(F.col("o_custkey").alias("sample_id"), F.col(marker).alias("marker")).agg(F.least(F.lit(2), F.count(F.lit(1))).cast("int").alias("dosage"))


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").cast("double").alias("nation"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("marker"), F.col("s_nationkey").cast("string").alias("chrom"), (F.col("s_suppkey") * 1000).alias("pos"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("marker"), (F.col("p_size") % 5).cast("string").alias("chrom"), (F.col("p_partkey") * 1000).alias("pos"))


def scan(spark: SparkSession, sf_dir: str, marker: str = "l_partkey", covariates: tuple[str, ...] = ()) -> DataFrame:
    return glm.native_scan(dosage(spark, sf_dir, marker), traits(spark, sf_dir), covariates=covariates)


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part scan in the columns of a result table, with place."""
    return scan(spark, sf_dir).withColumn("marker_idx", F.col("marker")).withColumn("chrom", (F.col("marker") % 22 + 1).cast("string")).withColumn("pos", F.col("marker") * 100_000)


DOSAGE = """dosage AS (SELECT o_custkey AS sample_id, {marker} AS marker, CAST(least(2, count(*)) AS INTEGER) AS dosage
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
 traits AS (SELECT c_custkey AS sample_id, c_acctbal AS y, CAST(c_nationkey AS DOUBLE) AS nation FROM customer)"""
COUNTS = """counts AS (SELECT marker, (SELECT count(*) FROM traits) AS n, CAST(sum(dosage) AS BIGINT) AS alleles, CAST(sum(dosage * dosage) AS BIGINT) AS squares,
  (SELECT count(*) FROM traits) - count(*) AS n0, count(*) FILTER (dosage = 1) AS n1, count(*) FILTER (dosage = 2) AS n2 FROM dosage GROUP BY marker)"""
TAIL = "least(1.0, " + erfc_sql("abs(t)/1.4142135623730951") + ")"
GLM = (
    """tot AS (SELECT count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM traits),
 sums AS (SELECT marker, sum(dosage) AS g, sum(dosage * dosage) AS gg, sum(dosage * y) AS gy FROM dosage JOIN traits USING (sample_id) GROUP BY marker),
 fit AS (SELECT marker, g, n - 2 AS df, gg - g * g * 1.0 / n AS lv, gy - g * sy / n AS cv, syy - sy * sy / n AS yv FROM sums, tot),
 est AS (SELECT marker, CAST(g AS BIGINT) AS n_alleles, df, cv / lv AS effect, sqrt(greatest(0, (yv - cv * cv / lv) / df) / lv) AS se FROM fit),
 tt AS (SELECT *, abs(effect / se) AS t FROM est),
 res AS (SELECT marker, n_alleles, effect, se, t, df, """
    + TAIL
    + """ AS p FROM tt)"""
)
PARTS = "WITH " + DOSAGE.format(marker="l_partkey") + ", " + GLM
SUPPLIERS = "WITH " + DOSAGE.format(marker="l_suppkey") + ", " + GLM
INDEXED = PARTS + ", idx AS (SELECT *, marker AS marker_idx, CAST(marker % 22 + 1 AS VARCHAR) AS chrom, marker * 100000 AS pos FROM res)"

_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        _REGISTRY[f.__name__] = (f, oracle)
        return f

    return add


# ---------------------------------------------------------------- counts, filters, imputation


@query("WITH " + DOSAGE.format(marker="l_suppkey") + " SELECT * FROM dosage")
def dosage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dosage(spark, sf_dir)


@query(
    "WITH " + DOSAGE.format(marker="l_partkey") + ", " + COUNTS + """ SELECT marker, n AS n_valid, alleles, n0, n1, n2,
  round(alleles / (2.0 * n), 6) AS frequency, round(least(alleles / (2.0 * n), 1 - alleles / (2.0 * n)), 6) AS maf,
  CAST(least(alleles, 2 * n - alleles) AS DOUBLE) AS mac, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS major, (n0 = n OR n2 = n) AS monomorphic FROM counts"""
)
def marker_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality.with_zeros(quality.marker_counts(dosage(spark, sf_dir, "l_partkey")), traits(spark, sf_dir).count())
    return c.select("marker", "n_valid", "alleles", "n0", "n1", "n2", r(quality.allele_frequency()).alias("frequency"), r(quality.maf()).alias("maf"), quality.mac().alias("mac"), quality.major_allele().alias("major"), quality.monomorphic().alias("monomorphic"))


@query("WITH " + DOSAGE.format(marker="l_partkey") + ", " + COUNTS + " SELECT marker, alleles FROM counts WHERE least(alleles, 2 * n - alleles) >= 30")
def mac_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality.with_zeros(quality.marker_counts(dosage(spark, sf_dir, "l_partkey")), traits(spark, sf_dir).count())
    return quality.filter_markers(c, min_mac=30).select("marker", "alleles")


_EVENT_CALLS = "calls AS (SELECT user_id AS sample_id, event_type AS marker, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(event_id % 5 % 3 AS INTEGER) END AS dosage FROM events)"


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with gaps: a fifth of the events is missing."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("marker"), F.when(F.col("event_id") % 5 != 4, F.col("event_id") % 5 % 3).cast("int").alias("dosage"))


@query("WITH " + _EVENT_CALLS + """ SELECT marker, count(*) AS n_samples, count(dosage) AS n_valid, round(1 - count(dosage) * 1.0 / count(*), 6) AS missing_rate,
  round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 6) AS maf, round(least(sum(dosage), 2 * count(dosage) - sum(dosage)) / (2.0 * count(*)), 6) AS maf_over_all
  FROM calls GROUP BY marker HAVING 1 - count(dosage) * 1.0 / count(*) <= 0.25""")  # fmt: skip
def missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality.filter_markers(quality.marker_counts(event_calls(spark, sf_dir)), max_missing=0.25)
    return c.select("marker", "n_samples", "n_valid", r(quality.missing_rate()).alias("missing_rate"), r(quality.maf()).alias("maf"), r(quality.maf_over_all()).alias("maf_over_all"))


@query("WITH " + _EVENT_CALLS + """, tally AS (SELECT marker, dosage AS d, count(*) AS c FROM calls WHERE dosage IS NOT NULL GROUP BY 1, 2),
  major AS (SELECT marker, d AS major FROM tally QUALIFY row_number() OVER (PARTITION BY marker ORDER BY c DESC, d) = 1)
  SELECT sample_id, marker, coalesce(dosage, major) AS dosage, count(*) AS n FROM calls JOIN major USING (marker) GROUP BY 1, 2, 3""")  # fmt: skip
def major_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.impute_long(event_calls(spark, sf_dir)).groupBy("sample_id", "marker", "dosage").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, round(avg(value), 6) AS value FROM events GROUP BY user_id")
def duplicate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.mean_per_id(table(spark, sf_dir, "events"), "user_id", ["value"]).select("user_id", r(F.col("value")).alias("value"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def duplicate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_per_id(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


_GT = "CAST(l_linenumber % 3 AS VARCHAR) || CASE WHEN l_orderkey % 2 = 0 THEN '/' ELSE '|' END || CASE WHEN l_suppkey % 7 = 0 THEN '.' ELSE CAST(l_partkey % 2 AS VARCHAR) END"


@query(f"""WITH c AS (SELECT {_GT} AS gt FROM lineitem), d AS (SELECT gt, CASE WHEN gt LIKE '%2%' OR gt LIKE '%.%' THEN -9
  ELSE CAST(length(gt) - length(replace(gt, '1', '')) AS INTEGER) END AS dosage FROM c) SELECT gt, dosage, count(*) AS n FROM d GROUP BY 1, 2""")  # fmt: skip
def call_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = F.concat((F.col("l_linenumber") % 3).cast("string"), F.when(F.col("l_orderkey") % 2 == 0, "/").otherwise("|"), F.when(F.col("l_suppkey") % 7 == 0, ".").otherwise((F.col("l_partkey") % 2).cast("string")))
    return table(spark, sf_dir, "lineitem").select(gt.alias("gt")).select("gt", F.coalesce(gt_dosage(F.col("gt")), F.lit(-9)).alias("dosage")).groupBy("gt", "dosage").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS sample_id, c_acctbal AS y, row_number() OVER (ORDER BY c_custkey) - 1 AS sample_idx FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def sample_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusforge.operators.align import align_samples

    genotyped = [x.k for x in table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().orderBy("k").collect()]
    pheno = traits(spark, sf_dir).select(F.col("sample_id").cast("string").alias("ID"), "y")
    rows, _, _, _ = align_samples(pheno, genotyped)
    return spark.createDataFrame(pd.DataFrame({"sample_id": rows["ID"].astype("int64"), "y": rows["y"].astype(float), "sample_idx": np.arange(len(rows), dtype=np.int64)}))


@query("SELECT c_custkey AS sample_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def samples_without_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"))
    return traits(spark, sf_dir).select("sample_id").join(orders, "sample_id", "left_anti")


# ---------------------------------------------------------------- linear models

_SHOWN = "marker, n_alleles, round(effect, 4) AS effect, round(se, 4) AS se, round(t, 5) AS t, CAST(df AS BIGINT) AS df, round(p, 5) AS p"


def shown(found: DataFrame) -> DataFrame:
    return found.select("marker", "n_alleles", r(F.col("effect"), 4).alias("effect"), r(F.col("se"), 4).alias("se"), r(F.col("t"), 5).alias("t"), "df", r(F.col("p"), 5).alias("p"))


@query(f"{PARTS} SELECT {_SHOWN} FROM res")
def glm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan(spark, sf_dir))


_WITH_NATION = (
    "WITH " + DOSAGE.format(marker="l_partkey") + """, tot AS (SELECT count(*) AS n, sum(y) AS sy, sum(nation) AS sx, sum(nation * nation) AS sxx, sum(nation * y) AS sxy, sum(y * y) AS syy FROM traits),
 sums AS (SELECT marker, sum(dosage) AS g, sum(dosage * dosage) AS gg, sum(dosage * y) AS gy, sum(dosage * nation) AS gx FROM dosage JOIN traits USING (sample_id) GROUP BY marker),
 c AS (SELECT marker, g, n - 3 AS df, gg - g * g * 1.0 / n AS cgg, gy - g * sy / n AS cgy, gx - g * sx / n AS cgx, sxx - sx * sx / n AS cxx, sxy - sx * sy / n AS cxy, syy - sy * sy / n AS cyy FROM sums, tot),
 fit AS (SELECT marker, g, df, cgg - cgx * cgx / cxx AS lv, cgy - cgx * cxy / cxx AS cv, cyy - cxy * cxy / cxx AS yv FROM c),
 est AS (SELECT marker, CAST(g AS BIGINT) AS n_alleles, df, cv / lv AS effect, sqrt(greatest(0, (yv - cv * cv / lv) / df) / lv) AS se FROM fit),
 tt AS (SELECT *, abs(effect / se) AS t FROM est), res AS (SELECT *, """ + TAIL + " AS p FROM tt)"
)


@query(f"{_WITH_NATION} SELECT {_SHOWN} FROM res")
def glm_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan(spark, sf_dir, covariates=("nation",)))


@query(f"{PARTS} SELECT CAST(marker AS VARCHAR) AS marker, round(effect, 4) AS effect, round(se, 4) AS se, round(p, 5) AS p FROM res")
def glm_marker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model over marker rows."""
    geno, y = part_genotypes(spark, sf_dir)
    found = glm.scan(geno, y)
    found = found.join(geno.markers.select("marker_idx", "marker"), "marker_idx")
    return found.select("marker", r(F.col("effect"), 4).alias("effect"), r(F.col("se"), 4).alias("se"), r(normal_p(F.col("t")), 5).alias("p"))


_SECOND = "WITH " + DOSAGE.format(marker="l_suppkey").replace("c_acctbal AS y", "coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) + 0.0 AS y") + ", " + GLM


@query(f"{SUPPLIERS} SELECT 'balance' AS trait, marker, round(effect, 4) AS effect, round(p, 5) AS p FROM res UNION ALL ({_SECOND} SELECT 'orders', marker, round(effect, 4), round(p, 5) FROM res)")
def glm_two_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two traits over marker rows in one pass."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("orders"))
    found = traits(spark, sf_dir).join(counts, "sample_id", "left").select("sample_id", "y", F.coalesce("orders", F.lit(0)).cast("double").alias("orders"))
    found = found.toArrow().sort_by([("sample_id", "ascending"), ("y", "ascending")])
    geno = from_long(dosage(spark, sf_dir), found.column("sample_id").to_pylist(), suppliers(spark, sf_dir))
    y = np.column_stack([found.column("y").to_numpy(), found.column("orders").to_numpy()])
    found = glm.scan(geno, y, traits=("balance", "orders")).join(geno.markers.select("marker_idx", "marker"), "marker_idx")
    return found.select("trait", F.col("marker").cast("long").alias("marker"), r(F.col("effect"), 4).alias("effect"), r(normal_p(F.col("t")), 5).alias("p"))


# ---------------------------------------------------------------- multiple testing and tables


@query(f"{INDEXED}, c AS (SELECT count(*) AS m FROM idx) SELECT marker, round(p, 5) AS p, round(least(p * m, 1), 5) AS p_bonferroni, p <= 0.05 / m AS significant FROM idx, c")
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.bonferroni(indexed(spark, sf_dir)).select("marker", r(F.col("p"), 5).alias("p"), r(F.col("p_bonferroni"), 5).alias("p_bonferroni"), "significant")


@query(f"""{INDEXED}, k AS (SELECT *, row_number() OVER (ORDER BY p, marker) AS k, count(*) OVER () AS m FROM idx)
  SELECT marker, round(least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 5) AS p_fdr FROM k""")  # fmt: skip
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.benjamini_hochberg(indexed(spark, sf_dir), tie="marker").select("marker", r(F.col("p_fdr"), 5).alias("p_fdr"))


@query(f"""{INDEXED}, k AS (SELECT *, row_number() OVER (ORDER BY p, marker) AS k, count(*) OVER () AS m FROM idx)
  SELECT marker, round(least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 5) AS p_fdr FROM k""")  # fmt: skip
def benjamini_hochberg_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for many rows."""
    found = indexed(spark, sf_dir).persist()
    return statistics.fdr_by_ranges(found, "p", 0.05, "marker", found.count()).select("marker", r(F.col("p_fdr"), 5).alias("p_fdr"))


@query(f"{INDEXED}, k AS (SELECT p, row_number() OVER (ORDER BY p, marker) AS rank, count(*) OVER () AS m FROM idx WHERE p > 0 AND p <= 1) SELECT rank, round(rank / (m + 1.0), 6) AS expected, round(p, 5) AS observed FROM k")
def qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.qq_points(indexed(spark, sf_dir)).select("rank", r(F.col("expected")).alias("expected"), r(F.col("observed"), 5).alias("observed"))


@query(f"{INDEXED} SELECT CAST(least(floor(p * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM idx WHERE p > 0 AND p <= 1 GROUP BY 1")
def p_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.p_histogram(indexed(spark, sf_dir))


@query(f"""{INDEXED} SELECT count(*) AS n_markers, count(*) FILTER (p < 0.01) AS n_significant, count(*) FILTER (p < 0.05) AS n_suggestive, round(min(p), 5) AS min_p,
  round(median(p), 5) AS median_p, round(avg(effect), 4) AS mean_effect, round(min(effect), 4) AS min_effect, round(max(effect), 4) AS max_effect FROM idx""")  # fmt: skip
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.run_summary(indexed(spark, sf_dir), threshold=0.01, suggestive=0.05)
    return s.select("n_markers", "n_significant", "n_suggestive", *[r(F.col(c), d).alias(c) for c, d in (("min_p", 5), ("median_p", 5), ("mean_effect", 4), ("min_effect", 4), ("max_effect", 4))])


@query(f"{INDEXED} SELECT round(median(t * t) / {CHI2_MEDIAN}, 4) AS inflation FROM idx")
def inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(statistics.genomic_inflation(indexed(spark, sf_dir)), 4),)], "inflation double")


_RANKS = "ranks AS (SELECT chrom, row_number() OVER (ORDER BY length(chrom), chrom) AS chrom_rank FROM (SELECT DISTINCT chrom FROM idx))"


@query(f"{INDEXED}, {_RANKS} SELECT CAST(floor((pos + chrom_rank * 1e10) / 5e6) AS BIGINT) AS bin, marker_idx, round(t, 5) AS abs_t FROM idx JOIN ranks USING (chrom) QUALIFY row_number() OVER (PARTITION BY bin ORDER BY t DESC, marker_idx) = 1")
def best_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexed(spark, sf_dir)
    ranked = found.join(length_rank(found), "chrom").withColumnRenamed("t", "abs_t")
    return statistics.best_per_bin(ranked, 5e6).select("bin", "marker_idx", r(F.col("abs_t"), 5).alias("abs_t"))


@query(f"{INDEXED} SELECT marker, round(p, 5) AS p FROM idx ORDER BY p, marker LIMIT 25")
def top_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).orderBy("p", "marker").limit(25).select("marker", r(F.col("p"), 5).alias("p"))


@query(f"{INDEXED} SELECT marker, round(p * coalesce(CASE WHEN p_size > 40 THEN 0.5 END, 1.0), 5) AS p FROM idx JOIN part ON marker = p_partkey")
def prior_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("marker"), F.lit(0.5).alias("weight"))
    return statistics.apply_prior(indexed(spark, sf_dir), prior).select("marker", r(F.col("p"), 5).alias("p"))


_KEPT = f"{INDEXED}, kept AS (SELECT * FROM idx WHERE n_alleles >= 30)"


@query(f"{_KEPT} SELECT p_partkey AS marker_idx, p_name, round(effect, 4) AS effect, round(p, 5) AS p FROM part LEFT JOIN kept ON p_partkey = marker_idx")
def padded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = indexed(spark, sf_dir).where("n_alleles >= 30").select("marker_idx", "effect", "p")
    whole = statistics.pad(kept, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("marker_idx"), "p_name"))
    return whole.select("marker_idx", "p_name", r(F.col("effect"), 4).alias("effect"), r(F.col("p"), 5).alias("p"))


_TWO = f"{PARTS}, a AS (SELECT * FROM res), " + _WITH_NATION[len("WITH " + DOSAGE.format(marker="l_partkey")) + 2 :].replace("tot AS", "tot2 AS").replace("sums, tot)", "sums2, tot2)").replace("sums AS", "sums2 AS").replace("fit AS", "fit2 AS").replace("FROM fit)", "FROM fit2)").replace("est AS", "est2 AS").replace("FROM est)", "FROM est2)").replace("tt AS", "tt2 AS").replace("FROM tt)", "FROM tt2)").replace("res AS", "b AS")


@query(f"{_TWO} SELECT p_partkey AS marker_idx, round(a.p, 5) AS \"GLM_P\", round(a.effect, 4) AS \"GLM_Effect\", round(b.p, 5) AS \"CV_P\", round(b.effect, 4) AS \"CV_Effect\" FROM part LEFT JOIN a ON a.marker = p_partkey LEFT JOIN b ON b.marker = p_partkey")
def merged_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("marker_idx", *[r(F.col(c), 5 if c.endswith("P") else 4).alias(c) for c in ("GLM_P", "GLM_Effect", "CV_P", "CV_Effect")])


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("marker_idx"))
    found = {"GLM": indexed(spark, sf_dir), "CV": scan(spark, sf_dir, covariates=("nation",)).withColumnRenamed("marker", "marker_idx")}
    return statistics.merge_methods(markers, found)


@query(f"{_TWO} SELECT a.marker AS marker_idx, CASE WHEN a.p <= 0.01 AND b.p <= 0.01 THEN 'GLM|CV' WHEN a.p <= 0.01 THEN 'GLM' ELSE 'CV' END AS \"Method\" FROM a JOIN b USING (marker) WHERE a.p <= 0.01 OR b.p <= 0.01")
def significant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.significant(merged(spark, sf_dir), {"GLM": 0.01, "CV": 0.01}).select("marker_idx", "Method")


@query(f"""WITH h AS (SELECT marker, run FROM (SELECT l_partkey AS marker, l_linenumber AS run FROM lineitem)) SELECT marker, round(count(DISTINCT run) / 7.0, 6) AS rmip FROM h GROUP BY marker""")
def resampling_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("marker"), F.col("l_linenumber").alias("run"))
    return statistics.resampling_share(hits, 7, "marker").select("marker", r(F.col("rmip")).alias("rmip"))


# ---------------------------------------------------------------- layout and labels


@query(f"""{INDEXED}, per AS (SELECT chrom, min(pos) AS first, max(pos) AS last, CAST(max(pos) - min(pos) + 1 AS DOUBLE) AS len FROM idx GROUP BY chrom),
  g AS (SELECT *, sum(len) OVER () * 0.01 AS gap, row_number() OVER (ORDER BY CAST(chrom AS INTEGER)) AS code FROM per)
  SELECT chrom, CAST(code AS INTEGER) AS code, first, last, round(coalesce(sum(len + gap) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS "offset" FROM g""")  # fmt: skip
def genome_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.genome_layout(indexed(spark, sf_dir)).select("chrom", "code", "first", "last", r(F.col("offset"), 2).alias("offset"))


@query("SELECT s_name, CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS natural_rank FROM supplier")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, sf_dir, "supplier").select("s_name", F.row_number().over(Window.orderBy(natural_key_column(F.col("s_name")))).alias("natural_rank"))


@query("SELECT n AS chrom, row_number() OVER (ORDER BY length(n), n) AS chrom_rank FROM (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS n FROM supplier)")
def chromosome_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_rank(suppliers(spark, sf_dir))


# ---------------------------------------------------------------- relationships

_NATIONS = """nat AS (SELECT c_nationkey AS s, l_suppkey AS m, count(*) % 3 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
 ss AS (SELECT n_nationkey AS s FROM nation), mm AS (SELECT DISTINCT m FROM nat),
 full_ AS (SELECT ss.s, mm.m, coalesce(d, 0) AS d, CAST(s_nationkey % 5 AS VARCHAR) AS chrom FROM ss CROSS JOIN mm LEFT JOIN nat ON nat.s = ss.s AND nat.m = mm.m JOIN supplier ON s_suppkey = mm.m),
 z AS (SELECT s, m, chrom, d - avg(d) OVER (PARTITION BY m) AS z, d FROM full_)"""


def nation_genotypes(spark: SparkSession, sf_dir: str) -> Genotypes:
    """Nations as samples and suppliers as markers: a small panel whose relationship matrix SQL can check."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    long = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    long = long.groupBy(F.col("c_nationkey").alias("sample_id"), F.col("l_suppkey").alias("marker")).agg((F.count(F.lit(1)) % 3).cast("int").alias("dosage"))
    samples = [x.n for x in table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n")).orderBy("n").collect()]
    markers = long.select("marker").distinct().join(suppliers(spark, sf_dir), "marker").withColumn("chrom", (F.col("chrom").cast("int") % 5).cast("string"))
    return from_long(long, samples, markers)


def pairs(spark: SparkSession, geno: Genotypes, k: np.ndarray, name: str, digits: int = 6) -> DataFrame:
    rows = [(int(a), int(b), float(round(k[i, j], digits)) + 0.0) for i, a in enumerate(geno.samples) for j, b in enumerate(geno.samples)]
    return spark.createDataFrame(rows, f"a int, b int, {name} double")


@query(f"""WITH {_NATIONS}, g AS (SELECT x.s AS a, y.s AS b, sum(x.z * y.z) AS g FROM z x JOIN z y USING (m) GROUP BY 1, 2)
  SELECT a, b, round(g / (SELECT avg(g) FROM g WHERE a = b), 6) AS k FROM g""")  # fmt: skip
def kinship_vanraden(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno = nation_genotypes(spark, sf_dir)
    return pairs(spark, geno, structure.vanraden(geno), "k")


@query(f"WITH {_NATIONS} SELECT x.s AS a, y.s AS b, round(1 - sum(abs(x.d - y.d)) / (2.0 * count(*)), 6) AS ibs FROM z x JOIN z y USING (m) GROUP BY 1, 2")
def kinship_ibs(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno = nation_genotypes(spark, sf_dir)
    return pairs(spark, geno, structure.ibs(geno), "ibs")


@query(f"""WITH {_NATIONS}, g AS (SELECT x.s AS a, y.s AS b, x.chrom, sum(x.z * y.z) AS g FROM z x JOIN z y USING (m) GROUP BY 1, 2, 3),
  l AS (SELECT t.a, t.b, c.chrom, sum(t.g) AS k FROM g t, (SELECT DISTINCT chrom FROM g) c WHERE t.chrom <> c.chrom GROUP BY 1, 2, 3)
  SELECT a, b, chrom, round(k / (SELECT avg(k) FROM l d WHERE d.a = d.b AND d.chrom = l.chrom), 6) AS k FROM l""")  # fmt: skip
def kinship_loco(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno = nation_genotypes(spark, sf_dir)
    loco = structure.loco_kinship(geno)
    out = None
    for chrom in loco.chromosomes:
        one = pairs(spark, geno, loco.without(chrom), "k").withColumn("chrom", F.lit(chrom))
        out = one if out is None else out.union(one)
    return out


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno = nation_genotypes(spark, sf_dir)
    pcs = structure.components(geno, count=3)
    return spark.createDataFrame([(int(s), *map(float, row)) for s, row in zip(geno.samples, pcs)], "sample int, " + ", ".join(f"pc{i + 1} double" for i in range(pcs.shape[1])))


# ---------------------------------------------------------------- models beyond SQL


def part_genotypes(spark: SparkSession, sf_dir: str) -> tuple[Genotypes, np.ndarray]:
    people, y = balances(spark, sf_dir)
    return from_long(dosage(spark, sf_dir, "l_partkey"), people, parts(spark, sf_dir)), y


def balances(spark: SparkSession, sf_dir: str) -> tuple[list[int], np.ndarray]:
    """Samples in order, and the trait."""
    found = traits(spark, sf_dir).select("sample_id", "y").toArrow().sort_by([("sample_id", "ascending"), ("y", "ascending")])
    return found.column("sample_id").to_pylist(), found.column("y").to_numpy()


def supplier_panel(spark: SparkSession, sf_dir: str) -> tuple[Genotypes, np.ndarray]:
    """Parts as markers, and a trait that one of them moves."""
    geno, y = part_genotypes(spark, sf_dir)
    geno.calls = geno.calls.persist()
    return geno, y + 9000.0 * geno.columns([7])[:, 0]


@query()
def mlm_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno, y = supplier_panel(spark, sf_dir)
    return mlm.scan_global(geno, y, structure.vanraden(geno))


@query()
def mlm_loco(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno, y = supplier_panel(spark, sf_dir)
    return mlm.scan_loco(geno, y)


@query()
def farmcpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno, y = supplier_panel(spark, sf_dir)
    return multilocus.farmcpu(geno, y).results


@query()
def blink(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno, y = supplier_panel(spark, sf_dir)
    return multilocus.blink(geno, y).results


@query()
def bayes_loco(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the small panel of nations, whose trait is their customers' mean balance."""
    geno, y = nation_panel(spark, sf_dir)
    return bayes.bayes_loco(geno, y)[0]


#: The linear model on the panel of nations. Where no relationship is left, and before any marker is chosen, the mixed and the
#: multi-locus models come down to it.
_NATION_FIT = f"""WITH {_NATIONS}, t AS (SELECT n_nationkey AS s, coalesce((SELECT avg(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey), 0) AS y FROM nation),
  tot AS (SELECT count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM t),
  sums AS (SELECT m, sum(d) AS g, sum(d * d) AS gg, sum(d * y) AS gy FROM full_ JOIN t USING (s) GROUP BY m),
  fit AS (SELECT m, n, gg - g * g * 1.0 / n AS lv, gy - g * sy / n AS cv, syy - sy * sy / n AS yv FROM sums, tot),
  est AS (SELECT m, n, lv, cv / lv AS effect, yv, sqrt((yv - cv * cv / lv) / (n - 2) / lv) AS se FROM fit WHERE lv > 1e-9)"""


def nation_panel(spark: SparkSession, sf_dir: str) -> tuple[Genotypes, np.ndarray]:
    geno = nation_genotypes(spark, sf_dir)
    mean = {x.c_nationkey: x.y for x in table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("y")).collect()}
    return geno, np.array([mean.get(int(s), 0.0) for s in geno.samples])


def by_marker(geno: Genotypes, found: DataFrame, *columns: Column) -> DataFrame:
    """Of markers that vary: the marker's name and columns of its result."""
    kept = found.where(F.col("se").isNotNull() & ~F.isnan("se") & (F.col("se") > 0))
    return kept.join(geno.markers.select("marker_idx", F.col("marker").cast("string").alias("m")), "marker_idx").select("m", *columns)


@query(f"{_NATION_FIT} SELECT CAST(m AS VARCHAR) AS m, round(effect, 3) AS effect, round(sqrt(yv / (n - 1) / lv), 3) AS se, round(abs(effect) / sqrt(yv / (n - 1) / lv), 5) AS t FROM est")
def mlm_unrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed model with samples that are not related: the variance is that of the trait, whatever its parts."""
    geno, y = nation_panel(spark, sf_dir)
    found = mlm.scan_global(geno, y, np.eye(geno.n))
    return by_marker(geno, found, *[r(F.col(c), k).alias(c) for c, k in (("effect", 3), ("se", 3), ("t", 5))])


_FIRST_SCAN = f"{_NATION_FIT} SELECT CAST(m AS VARCHAR) AS m, round(effect, 3) AS effect, round(se, 3) AS se, round(abs(effect / se), 5) AS t FROM est"


@query(_FIRST_SCAN)
def farmcpu_first_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FarmCPU where no marker reaches its first threshold."""
    geno, y = nation_panel(spark, sf_dir)
    found = multilocus.farmcpu(geno, y, p_threshold=1e-300).results
    return by_marker(geno, found, r(F.col("effect"), 3).alias("effect"), r(F.col("se"), 3).alias("se"), r(F.abs(F.col("effect") / F.col("se")), 5).alias("t"))


@query(_FIRST_SCAN)
def blink_first_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLINK where no marker reaches its first threshold."""
    geno, y = nation_panel(spark, sf_dir)
    found = multilocus.blink(geno, y, p_threshold=1e-300).results
    return by_marker(geno, found, r(F.col("effect"), 3).alias("effect"), r(F.col("se"), 3).alias("se"), r(F.abs(F.col("effect") / F.col("se")), 5).alias("t"))


@query(f"""WITH {_NATIONS}, v AS (SELECT m, chrom, s, z, sum(z * z) OVER (PARTITION BY m) AS zz FROM z)
  SELECT CAST(x.m AS VARCHAR) AS a, CAST(y.m AS VARCHAR) AS b, round(sum(x.z * y.z) / sqrt(any_value(x.zz) * any_value(y.zz)), 6) + 0.0 AS correlation
  FROM v x JOIN v y ON x.s = y.s AND x.chrom = y.chrom AND x.m < y.m WHERE x.zz > 1e-9 AND y.zz > 1e-9 AND x.chrom = '0' AND y.chrom = '0' GROUP BY x.m, y.m""")  # fmt: skip
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the markers of one chromosome, as the effective number of tests reads them."""
    geno, _ = nation_panel(spark, sf_dir)
    own = geno.take_markers(geno.markers.where("chrom = '0'"))
    found = own.calls.select("marker_idx", "g").join(own.markers.select("marker_idx", F.col("marker").cast("long").alias("m")), "marker_idx").orderBy("m").toArrow()
    g = np.array([dense_row(raw, geno.n) for raw in found.column("g").to_pylist()], float).reshape(-1, geno.n)
    varies = g.var(1) > 0
    return correlation_pairs(spark, g[varies], [str(m) for m, v in zip(found.column("m").to_pylist(), varies) if v])


@query("""WITH h AS (SELECT l_partkey AS marker_idx, l_linenumber AS iteration, l_discount + l_orderkey / 1e9 AS p, l_tax AS effect, l_quantity AS se FROM lineitem)
  SELECT marker_idx, round(min(p), 6) AS p, round(arg_min(effect, p), 6) AS effect, round(arg_min(se, p), 6) AS se FROM h GROUP BY 1""")  # fmt: skip
def substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    h = li.select(F.col("l_partkey").alias("marker_idx"), F.col("l_linenumber").alias("iteration"), (F.col("l_discount") + F.col("l_orderkey") / 1e9).alias("p"), F.col("l_tax").alias("effect"), F.col("l_quantity").alias("se"))
    return multilocus.substitute_history(h).select("marker_idx", *[r(F.col(c)).alias(c) for c in ("p", "effect", "se")])


@query()
def farmcpu_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno, y = supplier_panel(spark, sf_dir)
    return multilocus.resample(geno, y, seed=1)


@query()
def effective_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno, _ = part_genotypes(spark, sf_dir)
    return linkage_blocks(geno)


@query(f"""{INDEXED}, ok AS (SELECT log10(p) AS l FROM idx WHERE p > 0 AND p <= 1), edge AS (SELECT count(*) AS n, least(min(l), -1e-12) AS low,
    CAST(least(2000, greatest(50, floor(sqrt(count(*))))) AS INTEGER) AS bins FROM ok),
  binned AS (SELECT CAST(least(floor((l - low) / -low * bins), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM ok, edge GROUP BY 1)
  SELECT bin, CAST(round(low + (bin + 0.5) * (-low) / bins, 5) AS DOUBLE) AS l, CAST(round((sum(b.n) OVER (ORDER BY bin) - b.n / 2.0) / (edge.n + 1), 6) AS DOUBLE) AS expected, b.n AS n FROM binned b, edge""")  # fmt: skip
def qq_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.qq_histogram(indexed(spark, sf_dir))
    return found.select("bin", r(F.col("l"), 5).alias("l"), r(F.col("expected")).alias("expected"), "n")


@query(f"""{INDEXED}, per AS (SELECT chrom, min(pos) AS first, max(pos) AS last FROM idx GROUP BY 1),
  laid AS (SELECT *, row_number() OVER (ORDER BY CAST(chrom AS INTEGER)) AS code, last - first + 1 + (SELECT sum(last - first + 1) FROM per) * 0.01 AS own FROM per),
  placed AS (SELECT *, coalesce(sum(own) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM laid)
  SELECT marker_idx, chrom, CAST(code AS INTEGER) AS code, CAST(round(pos - first + start, 2) AS DOUBLE) AS x, round(-log10(p), 4) AS y FROM idx JOIN placed USING (chrom) WHERE p > 0 AND p <= 1""")  # fmt: skip
def manhattan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexed(spark, sf_dir)
    points = plotdata.manhattan_points(found.select("marker_idx", "p"), found.select("marker_idx", "chrom", "pos"))
    return points.select("marker_idx", "chrom", F.col("code").cast("int").alias("code"), r(F.col("x"), 2).alias("x"), r(F.col("y"), 4).alias("y"))


@query()
def manhattan_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexed(spark, sf_dir)
    return plotdata.decimate(plotdata.manhattan_points(found.select("marker_idx", "p"), found.select("marker_idx", "chrom", "pos")))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql is not None}
