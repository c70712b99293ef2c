"""Sparse Bayesian regression with leave-one-chromosome-out tests.

Each marker's effect comes from a wide or a narrow normal distribution. Mean-field coordinate ascent updates markers one
after the other, each against the residual that the ones before have left, so a fit is one task and holds all markers as
bytes; candidates of the prior are fitted side by side, one task each. Then every marker is tested against what the
markers of other chromosomes leave of the trait.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.functions.tails import CHI2_MEDIAN, chi2_tail
from locusforge.model import Genotypes, dense_row, filled


@dataclass(frozen=True)
class BayesConfig:
    pi_grid: tuple[float, ...] = (0.005, 0.02, 0.05)
    slab_scale_grid: tuple[float, ...] = (0.75, 1.25)
    validation_share: float = 0.1
    score: str = "nll"
    max_epochs: int = 120
    patience: int = 8
    elbo_tolerance: float = 1e-4
    screen_after: int = 6
    screen_phi: float = 3e-3
    screen_top: int = 5000
    full_sweep_every: int = 8
    spike_share: float = 0.01
    test: str = "score"
    calibration: str = "none"
    unrelated: tuple[int, ...] = field(default_factory=tuple)
    refine: bool = False
    min_maf: float = 0.0
    max_missing: float = 1.0
    seed: int = 42

    def __post_init__(self):
        if not self.pi_grid or not all(0 < p < 1 for p in self.pi_grid):
            raise ValueError("pi_grid needs shares between 0 and 1")
        if not self.slab_scale_grid or not all(s > 0 for s in self.slab_scale_grid):
            raise ValueError("slab_scale_grid needs positive numbers")
        if not 0 <= self.validation_share < 0.9 or self.max_epochs < 1 or self.patience < 1 or self.elbo_tolerance <= 0:
            raise ValueError("validation_share, max_epochs, patience or elbo_tolerance is out of range")
        for name, value, known in (("score", self.score, ("nll", "mse")), ("test", self.test, ("score", "robust")), ("calibration", self.calibration, ("none", "gc", "unrelated"))):
            if value not in known:
                raise ValueError(f"{name} is one of {known}")
        if self.calibration == "unrelated" and not self.unrelated:
            raise ValueError("calibration by unrelated samples needs their places")

    @staticmethod
    def of(value) -> BayesConfig:
        if value is None:
            return BayesConfig()
        if isinstance(value, BayesConfig):
            return value
        names = {f.name for f in fields(BayesConfig)}
        unknown = set(value) - names
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return BayesConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class State:
    m: np.ndarray
    v: np.ndarray
    phi: np.ndarray
    residual: np.ndarray
    noise: float
    elbo: float = -math.inf
    epochs: int = 0


def heritability(z: np.ndarray, y: np.ndarray, seed: int, most: int = 2000) -> float:
    """Moment estimate: products of traits on relationships, over up to ``most`` markers drawn by seed."""
    rng = np.random.default_rng(seed)
    use = z if len(z) <= most else z[np.sort(rng.choice(len(z), most, replace=False))]
    k = use.T @ use / max(1, len(use))
    s = (y - y.mean()) / (y.std() or 1.0)
    off = ~np.eye(len(y), dtype=bool)
    down = float((k[off] ** 2).sum())
    return float(np.clip((k * np.outer(s, s))[off].sum() / down if down > 0 else 0.5, 0.01, 0.99))


def ascend(z: np.ndarray, y: np.ndarray, pi: float, slab: float, spike: float, c: BayesConfig, start: State | None = None) -> State:
    """Coordinate ascent over standardised markers (rows) until the bound stops rising."""
    m, n = z.shape
    d = (z * z).sum(1)
    s = start or State(np.zeros(m), np.zeros(m), np.full(m, pi), y.copy(), float(y.var()) or 1.0)
    odds = math.log(pi / (1 - pi))
    wait, best = 0, -math.inf
    for epoch in range(c.max_epochs):
        active = np.arange(m)
        if epoch >= c.screen_after and (epoch - c.screen_after) % c.full_sweep_every:
            # All above the threshold, and the likeliest few besides; all markers where that is none.
            held = s.phi >= c.screen_phi
            if c.screen_top > 0:
                held[np.argsort(-s.phi, kind="stable")[: c.screen_top]] = True
            active = np.flatnonzero(held) if held.any() else active
        s1, s0 = 1.0 / (d / s.noise + 1.0 / slab), 1.0 / (d / s.noise + 1.0 / spike)
        shift = odds + 0.5 * (np.log(s1 / slab) - np.log(s0 / spike))
        r = s.residual
        for j in active:
            zj = z[j]
            u = float(zj @ r) + d[j] * s.m[j]
            mu1, mu0 = s1[j] * u / s.noise, s0[j] * u / s.noise
            x = shift[j] + 0.5 * (mu1 * mu1 / s1[j] - mu0 * mu0 / s0[j])
            phi = 1.0 / (1.0 + math.exp(-min(60.0, max(-60.0, x))))
            mean = phi * mu1 + (1 - phi) * mu0
            r -= zj * (mean - s.m[j])
            s.v[j] = phi * (s1[j] + mu1 * mu1) + (1 - phi) * (s0[j] + mu0 * mu0) - mean * mean
            s.m[j], s.phi[j] = mean, phi
        spread = float(r @ r + d @ s.v)
        s.noise = max(spread / n, 1e-10)
        s.epochs = epoch + 1
        p = np.clip(s.phi, 1e-12, 1 - 1e-12)
        second = s.v + s.m**2
        own = p * (0.5 * np.log(s1 / slab) + 0.5 - 0.5 * second / slab) + (1 - p) * (0.5 * np.log(s0 / spike) + 0.5 - 0.5 * second / spike)
        s.elbo = float(-0.5 * n * math.log(2 * math.pi * s.noise) - 0.5 * spread / s.noise + own.sum() - (p * np.log(p / pi) + (1 - p) * np.log((1 - p) / (1 - pi))).sum())
        if s.elbo > best + c.elbo_tolerance * max(1.0, abs(best)) or not math.isfinite(best):
            best, wait = s.elbo, 0
        else:
            wait += 1
            if wait >= c.patience:
                break
    return s


class Panel:
    """Markers of a task without covariates and mean, scaled to unit variance; those that fail the filters are out."""

    def __init__(self, g: np.ndarray, x: np.ndarray, c: BayesConfig):
        missing = (g < 0).mean(1)
        full = filled(g, "major")
        f = full.mean(1) / 2
        q, _ = np.linalg.qr(x)
        left = full - (full @ q) @ q.T
        self.sd = left.std(1)
        self.keep = (self.sd > 1e-8) & (np.minimum(f, 1 - f) >= c.min_maf) & (missing <= c.max_missing)
        self.z = left[self.keep] / self.sd[self.keep][:, None]
        self.q = q

    def trait(self, y: np.ndarray) -> np.ndarray:
        return y - self.q @ (self.q.T @ y)


def _prior(y: np.ndarray, h2: float, pi: float, kappa: float, m: int, c: BayesConfig) -> tuple[float, float]:
    slab = kappa * h2 * float(y.var()) / max(pi * m, 1.0)
    slab = max(slab, 1e-12)
    return slab, min(c.spike_share, 0.1) * slab


def validation_score(panel: Panel, y: np.ndarray, pi: float, kappa: float, c: BayesConfig) -> float:
    """Loss on samples held out of a fit; lower is better."""
    n = len(y)
    rng = np.random.default_rng(c.seed)
    held = np.zeros(n, bool)
    held[rng.choice(n, max(1, int(n * c.validation_share)), replace=False)] = True
    z, r = panel.z, panel.trait(y)
    slab, spike = _prior(r[~held], heritability(z[:, ~held], r[~held], c.seed), pi, kappa, len(z), c)
    s = ascend(z[:, ~held], r[~held], pi, slab, spike, c)
    error = r[held] - s.m @ z[:, held]
    mse = float((error**2).mean())
    return mse if c.score == "mse" else float(0.5 * math.log(2 * math.pi * s.noise) + 0.5 * mse / s.noise)


def test_markers(panel: Panel, chroms: np.ndarray, y: np.ndarray, pi: float, kappa: float, c: BayesConfig) -> dict[str, np.ndarray]:
    """Fit, then test each chromosome's markers on the residual of the others' predictions."""
    z, r = panel.z, panel.trait(y)
    own = chroms[panel.keep]
    n = len(y)
    d = (z * z).sum(1)
    slab, spike = _prior(r, heritability(z, r, c.seed), pi, kappa, len(z), c)
    s = ascend(z, r, pi, slab, spike, c)
    total = s.m @ z
    effect, se, stat = (np.full(len(z), np.nan) for _ in range(3))
    for chrom in sorted(set(own.tolist())):
        at = own == chrom
        if c.refine and (~at).any():
            part = ascend(z[~at], r, pi, slab, spike, c)
            left, doubt = r - part.m @ z[~at], float((part.v * d[~at]).sum() / n)
        else:
            left, doubt = r - (total - s.m[at] @ z[at]), float((s.v[~at] * d[~at]).sum() / n)
        base = max(float(left.var()), 1e-12)
        u = z[at] @ left
        if c.test == "robust":
            beta = u / d[at]
            e = left[None] - beta[:, None] * z[at]
            spread = ((z[at] * e) ** 2).sum(1) * n / max(1, n - 1 - panel.q.shape[1]) / d[at] ** 2
            stat[at], effect[at], se[at] = beta**2 / spread, beta, np.sqrt(spread)
        else:
            variance = base * (1 + doubt / base)
            stat[at], effect[at], se[at] = u**2 / (variance * d[at]), u / d[at], np.sqrt(variance / d[at])
    sd = panel.sd[panel.keep]
    return {"effect": effect / sd, "se": se / sd, "stat": stat, "phi": s.phi, "epochs": np.full(len(z), s.epochs), "noise": np.full(len(z), s.noise)}


_RESULT = "marker_idx long, effect double, se double, stat double, phi double, epochs int, pi double, kappa double"


def bayes_loco(geno: Genotypes, y: np.ndarray, covariates: np.ndarray | None = None, config=None) -> tuple[DataFrame, dict]:
    """``marker_idx, effect, se, stat, phi, p`` and what the run chose. Traits of only 0 and 1 are not offered."""
    c = BayesConfig.of(config)
    y = np.asarray(y, float)
    if set(np.unique(y).tolist()) <= {0.0, 1.0}:
        raise NotImplementedError("only quantitative traits")
    if not np.isfinite(y).all():
        raise ValueError("the phenotype has missing values")
    n = geno.n
    x = np.ones((n, 1)) if covariates is None else np.column_stack([np.ones(n), np.asarray(covariates, float)])
    shared = geno.spark.sparkContext.broadcast((x, y, c))
    grid = [(float(p), float(k)) for p in c.pi_grid for k in c.slab_scale_grid]

    def opened(data: pa.Table) -> tuple[Panel, np.ndarray, np.ndarray, np.ndarray, BayesConfig]:
        x, y, c = shared.value
        order = np.argsort(data.column("marker_idx").to_numpy(), kind="stable")
        raw = data.column("g").to_pylist()
        g = np.stack([dense_row(raw[i], n) for i in order])
        chroms = np.asarray(data.column("chrom").to_pylist(), object)[order]
        return Panel(g, x, c), chroms, data.column("marker_idx").to_numpy()[order], y, c

    def tune(key, data):
        panel, _, _, y, c = opened(data)
        p, k = grid[key[0].as_py()]
        return pa.table({"candidate": pa.array([key[0].as_py()], pa.int32()), "loss": [validation_score(panel, y, p, k, c)]})

    scores: dict[int, float] = {0: 0.0}
    if len(grid) > 1 and c.validation_share > 0:
        each = geno.calls.select("marker_idx", "chrom", "g", F.explode(F.array(*[F.lit(i) for i in range(len(grid))])).alias("candidate"))
        scores = {r.candidate: r.loss for r in each.groupBy("candidate").applyInArrow(tune, "candidate int, loss double").collect()}
    best = min(scores, key=lambda i: (scores[i], i)) if scores else 0
    p, k = grid[best]

    def final(key, data):
        panel, chroms, ids, y, c = opened(data)
        out = test_markers(panel, chroms, y, p, k, c)
        kept = ids[panel.keep]
        return pa.table({"marker_idx": kept, "effect": out["effect"], "se": out["se"], "stat": out["stat"], "phi": out["phi"], "epochs": pa.array(out["epochs"], pa.int32()), "pi": np.full(len(kept), p), "kappa": np.full(len(kept), k)})

    found = geno.calls.select("marker_idx", "chrom", "g", F.lit(0).alias("_all")).groupBy("_all").applyInArrow(final, _RESULT).persist()
    scale = 1.0
    if c.calibration == "gc":
        scale = max(1.0, (found.agg(F.median("stat")).first()[0] or CHI2_MEDIAN) / CHI2_MEDIAN)
    elif c.calibration == "unrelated":
        part, _ = bayes_loco(geno.take_samples(c.unrelated), y[list(c.unrelated)], None if covariates is None else np.asarray(covariates)[list(c.unrelated)], {"pi_grid": (p,), "slab_scale_grid": (k,), "seed": c.seed})
        scale = max(1.0, (part.agg(F.median("stat")).first()[0] or CHI2_MEDIAN) / CHI2_MEDIAN)
    stats = found.withColumn("stat", F.col("stat") / scale)

    def tails(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(chi2_tail(b.column("stat").to_numpy()), from_pandas=True)], names=["marker_idx", "effect", "se", "stat", "phi", "p"])

    out = stats.select("marker_idx", "effect", "se", "stat", "phi").mapInArrow(tails, "marker_idx long, effect double, se double, stat double, phi double, p double")
    meta = {"pi": p, "kappa": k, "losses": [scores.get(i) for i in range(len(grid))], "calibration": c.calibration, "scale": scale, "n_samples": n, "seed": c.seed}
    return out, meta


def lambda_of(stats: Sequence[float]) -> float:
    return float(np.median(stats)) / CHI2_MEDIAN
