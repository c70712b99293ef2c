"""Linear models, one test a marker.

Covariates are projected out by block inversion: with X = [1 | covariates] and a marker g, all that is needed of g are its
inner products with X, y and itself. Natively these are sums of one aggregation by marker; over marker rows they are
matrix products in a narrow pass. Several traits share a pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.functions.tails import NORMAL_FROM_DF, linear_tail, normal_p
from locusforge.model import Columns, Genotypes, Sparse, filled, held

#: Variation of a marker, beside the covariates, at or below which it is not tested.
LEAST_VARIATION = 1e-8
RESULT = "marker_idx long, trait string, effect double, se double, t double, p double"


@dataclass
class Wide:
    """A design of columns of all samples, ``x``, beside markers of few calls."""

    x: np.ndarray
    markers: Columns

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.x), self.x.shape[1] + self.markers.shape[1]

    def gram(self) -> np.ndarray:
        cross = self.x[self.markers.at].T @ self.markers.cells
        return np.block([[self.x.T @ self.x, cross], [cross.T, self.markers.cells.T @ self.markers.cells]])

    def dot(self, y: np.ndarray) -> np.ndarray:
        return np.concatenate([self.x.T @ y, self.markers.cells.T @ y[self.markers.at]])

    def residual(self, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
        k = self.x.shape[1]
        out = y - self.x @ beta[:k]
        out[self.markers.at] -= self.markers.cells @ beta[k:]
        return out

    def rank(self) -> int:
        """Samples at which all markers are 0 turn into as many rows as ``x`` has columns: an orthogonal map keeps the rank."""
        rest = np.ones(len(self.x), bool)
        rest[self.markers.at] = False
        own = np.linalg.qr(self.x[rest], mode="r") if rest.any() else np.zeros((0, self.x.shape[1]))
        small = np.block([[own, np.zeros((len(own), self.markers.shape[1]))], [self.x[self.markers.at], self.markers.cells]])
        s = np.linalg.svd(small, compute_uv=False)
        return int((s > s.max(initial=0) * max(self.shape) * np.finfo(float).eps).sum())


@dataclass
class Design:
    """The sample side of a linear model."""

    x: np.ndarray
    inverse: np.ndarray
    y: np.ndarray
    b: np.ndarray
    yy: np.ndarray
    df: int
    xy: np.ndarray
    markers: Columns


def design(y: np.ndarray, covariates: np.ndarray | None = None, markers: Columns | None = None) -> Design:
    """``y``: samples, or samples by traits; ``markers``: further covariates. A singular design gets a pseudo-inverse; no
    residual freedom is an error."""
    y = np.asarray(y, float).reshape(len(y), -1)
    if not np.isfinite(y).all():
        raise ValueError("the phenotype has missing values")
    x = np.ones((len(y), 1)) if covariates is None else np.column_stack([np.ones(len(y)), np.asarray(covariates, float)])
    wide = Wide(x, Columns(len(y), np.zeros(0, np.int64), np.zeros((0, 0))) if markers is None else markers)
    df = len(y) - wide.shape[1] - 1
    if df <= 0:
        raise ValueError("no residual degrees of freedom")
    gram, xy = wide.gram(), wide.dot(y)
    inverse = np.linalg.inv(gram) if np.linalg.matrix_rank(gram) == len(gram) else np.linalg.pinv(gram, rcond=1e-10)
    return Design(x, inverse, y, inverse @ xy, (y * y).sum(0), df, xy, wide.markers)


def _products(g: np.ndarray | Sparse, d: Design) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of markers (rows) with the design, with themselves and with the traits."""
    at, cells = d.markers.at, d.markers.cells
    if isinstance(g, Sparse):
        beside = np.zeros((len(g), cells.shape[1]))
        if len(at):
            place = np.minimum(np.searchsorted(at, g.at), len(at) - 1)
            both = at[place] == g.at
            np.add.at(beside, g.row[both], g.value[both, None] * cells[place[both]])
        return np.column_stack([g.times(d.x), beside]), g.sums(g.value * g.value), g.times(d.y)
    return np.column_stack([g @ d.x, g[:, at] @ cells]), np.einsum("ij,ij->i", g, g), g @ d.y


def fit_markers(g: np.ndarray | Sparse, d: Design) -> dict[str, np.ndarray]:
    """Effects, standard errors and t of markers (rows of ``g``) by trait, and parts from which covariate terms follow."""
    s, square, gy = _products(g, d)
    behind = s @ d.inverse
    left = square - np.einsum("ij,ij->i", behind, s)
    ok = left > LEAST_VARIATION
    safe = np.where(ok, left, 1.0)
    effect = (gy - s @ d.b) / safe[:, None]
    fitted = np.einsum("kt,kt->t", d.b, d.xy)[None] - effect * (behind @ d.xy) + effect * gy
    variance = np.maximum(0.0, (d.yy[None] - fitted) / d.df)
    se = np.sqrt(variance / safe[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.abs(effect / se)
    t = np.where(np.isnan(t), 0.0, t)
    effect, t = np.where(ok[:, None], effect, 0.0), np.where(ok[:, None], t, 0.0)
    se = np.where(ok[:, None], se, np.nan)
    return {"effect": effect, "se": se, "t": t, "ok": ok, "behind": behind, "left": safe, "variance": variance}


def covariate_terms(f: dict[str, np.ndarray], d: Design, trait: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Effect, standard error and |t| of each column of X beside each marker: markers by columns."""
    beta = d.b[:, trait][None] - f["effect"][:, [trait]] * f["behind"]
    spread = np.diag(d.inverse)[None] + np.where(f["ok"][:, None], f["behind"] ** 2 / f["left"][:, None], 0.0)
    se = np.sqrt(np.maximum(f["variance"][:, [trait]] * spread, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.abs(beta / se)
    return beta, se, np.nan_to_num(t)


def scan(geno: Genotypes, y: np.ndarray, covariates: np.ndarray | None = None, *, markers: Columns | None = None, traits: Sequence[str] = ("trait",), fill: float | str = 1.0) -> DataFrame:
    """``marker_idx, trait, effect, se, t, p`` of every marker and trait in one narrow pass.

    Missing calls count as ``fill``. A marker without variation beside the covariates has effect 0, no standard error and
    p 1. Below fifty residual degrees of freedom tails are Student's, else normal.
    """
    d = design(y, covariates, markers)
    names, n, spark = list(traits), geno.n, geno.spark
    if d.y.shape[1] != len(names) or len(d.y) != n:
        raise ValueError("traits and samples must match the phenotype")
    shared = spark.sparkContext.broadcast(d)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for ids, _, g in held(batches, n):
            f = fit_markers(filled(g, fill), d)
            p = np.where(f["ok"][:, None], linear_tail(f["t"], d.df), 1.0)
            k = len(names)
            flat = lambda a: pa.array(a.ravel(), from_pandas=True)  # noqa: E731  NaN to null
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(names * len(ids)), flat(f["effect"]), flat(f["se"]), flat(f["t"]), flat(p)], names=[c.split()[0] for c in RESULT.split(", ")])

    return geno.calls.select("marker_idx", "chrom", "g").mapInArrow(over, RESULT)


def scan_terms(geno: Genotypes, y: np.ndarray, covariates: np.ndarray | None = None, *, fill: float | str = 1.0) -> DataFrame:
    """``marker_idx, terms``: effect, standard error, |t| and p of the intercept, each covariate and the marker itself."""
    d = design(y, covariates)
    n = geno.n
    shared = geno.spark.sparkContext.broadcast(d)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for ids, _, g in held(batches, n):
            f = fit_markers(filled(g, fill), d)
            beta, se, t = covariate_terms(f, d)
            effect, error, stat = np.column_stack([beta, f["effect"][:, 0]]), np.column_stack([se, f["se"][:, 0]]), np.column_stack([t, f["t"][:, 0]])
            p = linear_tail(stat, d.df)
            flat = [pa.array(c.ravel(), from_pandas=True) for c in (effect, error, stat, p)]
            cells = pa.StructArray.from_arrays(flat, names=["effect", "se", "t", "p"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cells) + 1, effect.shape[1]), pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["marker_idx", "terms"])

    return geno.calls.select("marker_idx", "chrom", "g").mapInArrow(over, "marker_idx long, terms array<struct<effect:double,se:double,t:double,p:double>>")


_TERMS = "term int, n long, effect double, square double, least double, most double, total double"


def scan_with_terms(geno: Genotypes, y: np.ndarray, covariates: np.ndarray, *, markers: Columns | None = None, fill: float | str = 1.0) -> tuple[DataFrame, DataFrame]:
    """The scan of one trait, and for each column of X over all markers: mean effect, mean squared error, least, most and
    mean |t|. The second is reduced in each batch before anything moves."""
    d = design(y, covariates, markers)
    n = geno.n
    shared = geno.spark.sparkContext.broadcast(d)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for _, _, g in held(batches, n):
            f = fit_markers(filled(g, fill), d)
            beta, se, t = covariate_terms(f, d)
            cols = [np.arange(beta.shape[1]), np.full(beta.shape[1], len(beta)), beta.sum(0), (se * se).sum(0), t.min(0), t.max(0), t.sum(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), *[pa.float64()] * 5))], names=[c.split()[0] for c in _TERMS.split(", ")])

    terms = geno.calls.select("marker_idx", "chrom", "g").mapInArrow(over, _TERMS).groupBy("term")
    terms = terms.agg(F.sum("n").alias("n"), (F.sum("effect") / F.sum("n")).alias("effect"), F.sqrt(F.sum("square") / F.sum("n")).alias("se"), F.min("least").alias("least_t"), F.max("most").alias("most_t"), (F.sum("total") / F.sum("n")).alias("mean_t"))
    return scan(geno, y, covariates, markers=markers, fill=fill), terms


# ---- native, over (sample, marker, dosage) rows that may leave out zeros


def _exact_parts(y: Column, most: float, n: int) -> tuple[Column, Column]:
    """``y`` as two numbers on grids so coarse that doubles add up n of each, times calls of up to 2, without rounding: a sum
    then does not hang on the order of its rows, and markers with the same calls have the same p to the last bit. What is left
    out is under 2^-60 of the largest ``y`` for a million samples."""
    if not 0 < most < 2.0**900:
        return y, F.lit(0.0)
    room = math.ceil(math.log2(max(2, n))) + 2
    first = math.frexp(most)[1] + room - 52
    second = first - 1 + room - 52
    if second < -1000:
        return y, F.lit(0.0)
    on = lambda c, k: F.rint(c * F.lit(2.0**-k)) * F.lit(2.0**k)
    high = on(y, first)
    return high, on(y - high, second)


def native_scan(long: DataFrame, samples: DataFrame, *, covariates: Sequence[str] = (), sample: str = "sample_id", marker: str = "marker", dosage: str = "dosage", y: str = "y") -> DataFrame:
    """``marker, n_alleles, effect, se, t, df, p`` by one aggregation; rows with dosage 0 may be absent.

    ``samples`` has a row for each sample with ``y`` and the covariates. Its size is that of the sample side, which its own
    count bounds: above two million rows it is joined by shuffle instead of being sent to all.
    """
    names = list(covariates)
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    p = len(terms)
    sums = samples.agg(F.count(F.lit(1)), F.sum(F.col(y) * F.col(y)), *[F.sum(F.col(y) * t) for t in terms], *[F.sum(terms[i] * terms[j]) for i in range(p) for j in range(p)], F.max(F.abs(y))).first()
    n, yy, xy, most = sums[0], float(sums[1] or 0), np.array(sums[2 : 2 + p], float), float(sums[-1] or 0)
    gram = np.array(sums[2 + p : -1], float).reshape(p, p)
    df = n - p - 1
    if df <= 0:
        raise ValueError("no residual degrees of freedom")
    inverse = np.linalg.inv(gram) if np.linalg.matrix_rank(gram) == p else np.linalg.pinv(gram, rcond=1e-10)
    b = inverse @ xy
    high, low = _exact_parts(F.col(y).cast("double"), most, n)
    side = samples.select(F.col(sample), high.alias("_yh"), low.alias("_yl"), *names)
    side = F.broadcast(side) if n <= 2_000_000 else side
    g = F.col(dosage).cast("double")
    by = long.join(side, sample).groupBy(marker).agg(F.sum(g).alias("_g0"), F.sum(g * g).alias("_gg"), (F.sum(g * F.col("_yh")) + F.sum(g * F.col("_yl"))).alias("_gy"), *[F.sum(g * F.col(c)).alias(f"_g{i + 1}") for i, c in enumerate(names)])
    s = [F.col(f"_g{i}") for i in range(p)]
    dot = lambda columns, numbers: sum((c * F.lit(float(v)) for c, v in zip(columns, numbers)), F.lit(0.0))
    behind = [dot(s, inverse[:, j]) for j in range(p)]
    left: Column = F.col("_gg") - sum((x * c for x, c in zip(behind, s)), F.lit(0.0))
    first = by.select(marker, F.col("_g0").alias("n_alleles"), "_gy", left.alias("_left"), dot(s, b).alias("_sb"), dot(behind, xy).alias("_bxy"))
    ok = F.col("_left") > LEAST_VARIATION
    second = first.withColumn("effect", F.when(ok, (F.col("_gy") - F.col("_sb")) / F.col("_left")).otherwise(F.lit(0.0)))
    fitted = F.lit(float(b @ xy)) - F.col("effect") * F.col("_bxy") + F.col("effect") * F.col("_gy")
    third = second.withColumn("se", F.when(ok, F.sqrt(F.greatest(F.lit(0.0), (F.lit(yy) - fitted) / df) / F.col("_left"))))
    fourth = third.withColumn("t", F.when(ok, F.coalesce(F.abs(F.try_divide(F.col("effect"), F.col("se"))), F.lit(0.0))).otherwise(F.lit(0.0)))
    out = fourth.select(marker, "n_alleles", "effect", "se", "t", F.lit(df).cast("long").alias("df"), F.when(ok, normal_p(F.col("t"))).otherwise(F.lit(1.0)).alias("p"))
    if df < NORMAL_FROM_DF:
        raise ValueError("below fifty residual degrees of freedom use scan(), which has Student's tail")
    return out
