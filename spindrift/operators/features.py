"""Features of snippets: temporal principal components, a pipeline of steps over columns, and the matrix that clusterers read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, signed_log1p
from ..session import ship
from .sums import summed


def moments(rows: DataFrame, v: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of arrays: sums and products are added up in the executors. Rows with a null or a value that isn't finite are left out."""
    ship(rows.sparkSession)

    def part(batches):
        n, s, q = 0, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[v].to_numpy()).astype(float)
            x = x[np.isfinite(x).all(1)]
            s, q = (x.sum(0), x.T @ x) if s is None else (s + x.sum(0), q + x.T @ x)
            n += len(x)
        return np.concatenate([s, q.ravel(), [n]]) if n else None

    flat = summed(rows.where(F.col(v).isNotNull()).select(F.col(v).cast("array<double>").alias(v)), part)
    if not len(flat):
        return 0, np.zeros(0), np.zeros((0, 0))
    n, k = int(flat[-1]), int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    mean = flat[:k] / n
    return n, mean, flat[k:-1].reshape(k, k) / n - np.outer(mean, mean)



@dataclass
class TemporalBasis:
    """Components (rank, samples) and mean of single-channel snippets; `start` and `stop` are the samples that are read."""

    components: np.ndarray
    mean: np.ndarray
    start: int = 0
    stop: int | None = None

    @classmethod
    def fit(cls, rows: DataFrame, rank: int, v: str = "v", centred: bool = True, start: int = 0, stop: int | None = None) -> TemporalBasis:
        """Leading directions of the covariance, or of the second moments if not centred; the largest entry of each is positive."""
        cut = rows if stop is None and not start else rows.withColumn(v, F.slice(v, start + 1, (F.size(v) if stop is None else F.lit(stop)) - start))
        n, mean, cov = moments(cut, v)
        if not centred:
            cov, mean = cov + np.outer(mean, mean), np.zeros_like(mean)
        _, vectors = np.linalg.eigh(cov)
        basis = vectors[:, ::-1][:, :rank].T
        basis = basis * np.sign(np.take_along_axis(basis, np.abs(basis).argmax(1)[:, None], 1)) if len(basis) else basis
        return cls(basis, mean, start, stop)

    def _rows(self, m: np.ndarray) -> Column:
        return F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in m))

    def _times(self, x: Column, m: np.ndarray) -> Column:
        """m x as an array, in one expression of the JVM."""
        return F.transform(self._rows(m), lambda r: dot(r, x))

    def read(self, v: str) -> Column:
        x = F.col(v).cast("array<double>")
        return x if self.stop is None and not self.start else F.slice(x, self.start + 1, F.lit((self.stop if self.stop is not None else self.start + len(self.mean)) - self.start))

    def embed(self, v: str = "v", centred: bool = True) -> Column:
        x = self.read(v)
        if centred:
            x = F.zip_with(x, F.array(*(F.lit(float(m)) for m in self.mean)), lambda a, b: a - b)
        return self._times(x, self.components)

    def invert(self, features: str = "pcs") -> Column:
        back = self._times(F.col(features), self.components.T)
        return F.zip_with(back, F.array(*(F.lit(float(m)) for m in self.mean)), lambda a, b: a + b)

    def project(self, v: str = "v") -> Column:
        """What the components keep of a snippet: mean + (v - mean) W' W."""
        w = self.components.T @ self.components
        x = F.zip_with(self.read(v), F.array(*(F.lit(float(m)) for m in self.mean)), lambda a, b: a - b)
        return F.zip_with(self._times(x, w), F.array(*(F.lit(float(m)) for m in self.mean)), lambda a, b: a + b)


@dataclass
class Step:
    """A step of a pipeline: fit(df) gives its state; column(state) the new column. A step named as the snippets rewrites them, any other adds a feature."""

    name: str
    column: Callable
    fit: Callable | None = None


class Pipeline:
    """Steps in order; each is fitted on what the ones before it make of the rows."""

    def __init__(self, steps: list[Step], v: str = "v"):
        names = [s.name for s in steps if s.name != v]
        if repeated := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"features of one name: {sorted(repeated)}")
        self.steps, self.v, self.states = steps, v, [None] * len(steps)

    def fit(self, rows: DataFrame) -> Pipeline:
        for k, s in enumerate(self.steps):
            self.states[k] = s.fit(rows) if s.fit else None
            rows = rows.withColumn(s.name, s.column(self.states[k]))
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        for s, state in zip(self.steps, self.states):
            rows = rows.withColumn(s.name, s.column(state))
        return rows

    def features(self) -> list[str]:
        return [s.name for s in self.steps if s.name != self.v]


def basic_steps(rank: int, trough: int, v: str = "v", denoise: bool = False) -> list[Step]:
    """Voltage at the trough, peak to peak, components, and if asked for the snippets' projection on them."""
    steps = [
        Step("voltage", lambda _: F.element_at(v, trough + 1).cast("double")),
        Step("ptp", lambda _: (F.array_max(v) - F.array_min(v)).cast("double")),
        Step("pcs", lambda basis: basis.embed(v), lambda rows: TemporalBasis.fit(rows, rank, v)),
    ]
    return steps + ([Step(v, lambda basis: basis.project(v), lambda rows: TemporalBasis.fit(rows, rank, v))] if denoise else [])


def matrix(spikes: DataFrame, z: str = "z", x: str = "x", amplitude: str = "amplitude", signed: str = "voltage", pcs: str = "pcs", x_scale: float = 1.0, log_scale: float = 5.0, pc_scale: float = 1.0) -> DataFrame:
    """feature: depth, scaled x, scaled log amplitude, signed log of the voltage and scaled components; rows with a value that isn't finite are dropped."""
    parts = [F.col(z).cast("double"), F.col(x).cast("double") * x_scale, F.log1p(F.abs(amplitude)) * log_scale, signed_log1p(F.col(signed)) * log_scale]
    out = spikes.withColumn("feature", F.concat(F.array(*parts), F.transform(pcs, lambda c: c.cast("double") * pc_scale)))
    return out.where(~F.exists("feature", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def denoising_score(v: str, denoised: str) -> Column:
    """sqrt |2 <w, d> - <d, d>|."""
    return F.sqrt(F.abs(2 * dot(F.col(v), F.col(denoised)) - dot(F.col(denoised), F.col(denoised))))


def residual_decrease(v: str, denoised: str, threshold: float, objective: str = "deconv") -> Column:
    """Whether subtracting the denoised snippet lowers the residual by more than the threshold: its square (deconv and normsq, against the threshold's) or its norm."""
    d, w = F.col(denoised), F.col(v)
    if objective == "deconv":
        return 2 * dot(w, d) - dot(d, d) > threshold**2
    left = F.zip_with(w, d, lambda a, b: a.cast("double") - b)
    if objective == "normsq":
        return dot(w, w) - dot(left, left) > threshold**2
    return F.sqrt(dot(w, w)) - F.sqrt(dot(left, left)) > threshold


def tapered(v: str, rise: int, fall: int) -> Column:
    """Raised cosines over the first and last samples, whose ends become 0."""
    n, pi = F.size(v), float(np.pi)

    def weigh(x, i):
        up = (F.cos(F.lit(-pi) + i * (pi / max(rise - 1, 1))) + 1) / 2
        down = (F.cos((i - (n - fall)) * (-pi / max(fall - 1, 1))) + 1) / 2
        return x.cast("double") * F.when(i < rise, up).when(i >= n - fall, down).otherwise(1.0)

    return F.transform(v, weigh)


def sign(x: Column) -> Column:
    """1 or -1; that of 0 is 1."""
    return F.when(x < 0, -1).otherwise(1)


def flat_index(shape: list[int], *parts: Column) -> Column:
    out = F.lit(0)
    for size, p in zip(shape, parts):
        out = out * size + p
    return out


def resampled(v: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling along the last axis to n samples."""
    old = v.shape[-1]
    spec = np.fft.rfft(v)
    out = np.zeros((*v.shape[:-1], n // 2 + 1), complex)
    k = min(old, n) // 2 + 1
    out[..., :k] = spec[..., :k]
    if min(old, n) % 2 == 0 and n != old:
        # the middle frequency stands for both of its signs
        out[..., k - 1] *= 0.5 if n > old else 2.0
    return np.fft.irfft(out, n) * (n / old)


def positive_definite(m: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """The symmetric part with eigenvalues of eps at least."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(values, eps)) @ vectors.T


def gaussian_log_likelihood(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Of rows of x."""
    gap = x - mean
    _, log_det = np.linalg.slogdet(cov)
    return -0.5 * (np.einsum("ij,ij->i", gap, np.linalg.solve(cov, gap.T).T) + log_det + x.shape[1] * np.log(2 * np.pi))


def low_rank_log_likelihood(x: np.ndarray, mean: np.ndarray, w: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Of rows of x under N(mean, noise + w w'), by the Woodbury identity: only matrices of w's rank are solved beyond the noise's inverse."""
    gap, inv = x - mean, np.linalg.inv(noise)
    core = np.eye(w.shape[1]) + w.T @ inv @ w
    half = gap @ inv @ w
    quad = np.einsum("ij,ij->i", gap @ inv, gap) - np.einsum("ij,ij->i", half, np.linalg.solve(core, half.T).T)
    return -0.5 * (quad + np.linalg.slogdet(noise)[1] + np.linalg.slogdet(core)[1] + x.shape[1] * np.log(2 * np.pi))


def low_rank_divergence(mean_a: np.ndarray, wa: np.ndarray, mean_b: np.ndarray, wb: np.ndarray) -> float:
    """KL divergence of N(mean_a, 1 + wa wa') from N(mean_b, 1 + wb wb')."""
    n, gap = len(mean_a), mean_b - mean_a
    core = np.eye(wb.shape[1]) + wb.T @ wb
    apply = lambda m: m - wb @ np.linalg.solve(core, wb.T @ m)
    trace = n - np.trace(np.linalg.solve(core, wb.T @ wb)) + np.sum(wa * apply(wa))
    log_a = np.linalg.slogdet(np.eye(wa.shape[1]) + wa.T @ wa)[1]
    return float(0.5 * (trace + gap @ apply(gap) - n + np.linalg.slogdet(core)[1] - log_a))
