"""Noise in the space of features, interpolation over channels, and rates that switch between states: small matrices on the driver, rows by broadcast."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class EmbeddedNoise:
    """Mean (rank, channels) and covariance of noise features over rank and channels: "scalar" (one variance), "rank" (one for each rank), "factorized" (rank by channel) or "full"."""

    mean: np.ndarray
    kind: str
    parts: tuple[np.ndarray, ...]

    @classmethod
    def estimate(cls, x: np.ndarray, kind: str = "factorized", shrinkage: float = 0.0) -> EmbeddedNoise:
        """From snippets' features (rows, rank, channels)."""
        n, rank, channels = x.shape
        mean = x.mean(0)
        gap = x - mean
        if kind == "scalar":
            return cls(mean, kind, (np.array(gap.var()),))
        if kind == "rank":
            return cls(mean, kind, (gap.var(axis=(0, 2)),))
        if kind == "full":
            flat = gap.reshape(n, -1)
            cov = flat.T @ flat / n
            return cls(mean, kind, ((1 - shrinkage) * cov + shrinkage * np.eye(len(cov)) * np.trace(cov) / len(cov),))
        if kind != "factorized":
            raise ValueError(f"no kind {kind!r}")
        by_rank = np.einsum("nrc,nsc->rs", gap, gap) / (n * channels)
        # channels after the ranks' covariance is taken out, of mean variance 1
        white = np.linalg.inv(np.linalg.cholesky(by_rank)) @ gap
        by_channel = np.einsum("nrc,nrd->cd", white, white) / (n * rank)
        return cls(mean, kind, (by_rank, (1 - shrinkage) * by_channel + shrinkage * np.eye(channels)))

    def covariance(self, channels: np.ndarray | None = None) -> np.ndarray:
        """Of the features on some channels (default: all), flattened with the rank first."""
        rank, every = self.mean.shape
        at = np.arange(every) if channels is None else np.asarray(channels)
        if self.kind == "scalar":
            return np.eye(rank * len(at)) * self.parts[0]
        if self.kind == "rank":
            return np.kron(np.diag(self.parts[0]), np.eye(len(at)))
        if self.kind == "factorized":
            return np.kron(self.parts[0], self.parts[1][np.ix_(at, at)])
        flat = (np.arange(rank)[:, None] * every + at[None]).ravel()
        return self.parts[0][np.ix_(flat, flat)]

    def whiten(self, x: np.ndarray, channels: np.ndarray | None = None) -> np.ndarray:
        """Features (rows, rank, channels) of those channels, with the identity as covariance."""
        at = np.arange(self.mean.shape[1]) if channels is None else np.asarray(channels)
        flat = (x - self.mean[:, at]).reshape(len(x), -1)
        return (flat @ np.linalg.inv(np.linalg.cholesky(self.covariance(at))).T).reshape(x.shape)

    def log_likelihood(self, x: np.ndarray, channels: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(self.mean.shape[1]) if channels is None else np.asarray(channels)
        white = self.whiten(x, at).reshape(len(x), -1)
        return -0.5 * ((white**2).sum(1) + np.linalg.slogdet(self.covariance(at))[1] + white.shape[1] * np.log(2 * np.pi))

    def imputed(self, x: np.ndarray, seen: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The mean of features on missing channels given those on the channels seen (rows, rank, seen): (rows, rank, missing)."""
        rank = self.mean.shape[0]
        both = self.covariance(np.concatenate([seen, missing]))
        n = len(seen) + len(missing)
        a = (np.arange(rank)[:, None] * n + np.arange(len(seen))[None]).ravel()
        b = (np.arange(rank)[:, None] * n + np.arange(len(seen), n)[None]).ravel()
        gap = (x - self.mean[:, seen]).reshape(len(x), -1)
        return (gap @ np.linalg.solve(both[np.ix_(a, a)], both[np.ix_(a, b)])).reshape(len(x), rank, len(missing)) + self.mean[:, missing]

    def detection_prior(self, templates: np.ndarray, threshold: float = 10.0) -> np.ndarray:
        """The log probability, for each template (units, rank, channels), that subtracting it lowers the square of pure noise by more than threshold^2: that the noise's product with the template exceeds half of
        threshold^2 + |template|^2, a normal variable's tail. Of a blank template it is -inf."""
        flat = np.asarray(templates, float).reshape(len(templates), -1)
        scale = np.sqrt(np.maximum(np.einsum("nc,cd,nd->n", flat, self.covariance(), flat), 0))
        need = ((flat**2).sum(1) + threshold**2) / 2
        return log_tail(np.divide(need, scale, out=np.full(len(flat), np.inf), where=scale > 0))

    def channel_prior(self, threshold: float = 4.0, draws: int = 65_536, seed: int = 0) -> np.ndarray:
        """The log probability, for each channel, that the norm of its noise over the ranks exceeds threshold, by seeded draws along the covariance's axes."""
        unit = np.random.default_rng(seed).normal(size=(draws, self.mean.shape[0])) ** 2
        with np.errstate(divide="ignore"):
            return np.log([(unit @ np.maximum(np.linalg.eigvalsh(self.covariance([c])), 0) > threshold**2).mean() for c in range(self.mean.shape[1])])

    def greatest_prior(self, threshold: float, channels: np.ndarray | None = None, draws: int = 65_536, seed: int = 0) -> float:
        """The log probability that the greatest of those channels' norms, correlated as they are, exceeds threshold, by seeded draws."""
        rank, at = self.mean.shape[0], np.arange(self.mean.shape[1]) if channels is None else np.asarray(channels)
        root = np.linalg.cholesky(self.covariance(at) + 1e-12 * np.eye(rank * len(at)))
        rng, hits, left = np.random.default_rng(seed), 0, draws
        while left:
            n = min(left, 8192)
            x = (rng.normal(size=(n, len(root))) @ root.T).reshape(n, rank, len(at))
            hits, left = hits + int(((x**2).sum(1).max(1) > threshold**2).sum()), left - n
        return float(np.log(hits / draws)) if hits else -np.inf

    def precisions(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """The inverse covariance of each set of channels."""
        return [np.linalg.inv(self.covariance(s)) for s in sets]


def log_tail(z: np.ndarray) -> np.ndarray:
    """Log of a standard normal variable's probability to exceed z, also where that underflows."""
    near = [math.log(0.5 * math.erfc(min(x, 25.0) / math.sqrt(2))) for x in np.asarray(z, float)]
    far = np.maximum(z, 25.0)
    with np.errstate(invalid="ignore"):
        tail = -0.5 * far**2 - np.log(far * np.sqrt(2 * np.pi)) + np.log1p(-1 / far**2 + 3 / far**4)
    return np.where(np.asarray(z) < 25.0, near, np.where(np.isinf(far), -np.inf, tail))


def factorized_noise(times: np.ndarray, space: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Normal noise (length, channels) whose spectrum's square root is `times` (of rfft frequencies) and whose channels' covariance has the root `space`."""
    r = np.random.default_rng(seed)
    white = np.fft.rfft(r.normal(size=(length, len(space))), axis=0)
    gain = np.interp(np.linspace(0, 1, len(white)), np.linspace(0, 1, len(times)), times)
    return np.fft.irfft(white * gain[:, None], length, axis=0) @ space.T


def smooth_root(places: np.ndarray, bandwidth: float = 15.0) -> tuple[np.ndarray, np.ndarray]:
    """(std, vectors): roots of the eigenvalues of a Gaussian kernel over places and its eigenvectors as rows, so noise = normal * std @ vectors."""
    d2 = ((places[:, None] - places[None]) ** 2).sum(2) / (2 * bandwidth**2)
    values, vectors = np.linalg.eigh(np.exp(-d2))
    return np.sqrt(np.maximum(values, 0)), vectors.T


def polyharmonic(source: np.ndarray, target: np.ndarray | None = None, sigma: float = 1.0, order: int = 2) -> np.ndarray:
    """r^order for odd orders, r^order log r (0 at r = 0) for even ones, r being the distance over sigma."""
    target = source if target is None else target
    r = np.sqrt(((source[:, None] - target[None]) ** 2).sum(2)) / sigma
    if order % 2:
        return r**order
    return np.where(r > 0, r**order * np.log(np.where(r > 0, r, 1.0)), 0.0)


def beyond(source: np.ndarray, target: np.ndarray, eps: float = 1e-3) -> np.ndarray:
    """Which targets (x, z) lie outside the depths that the sources of their column span; a column without sources is wholly outside."""
    out = np.ones(len(target), bool)
    for x in np.unique(source[:, 0]):
        z = source[np.isclose(source[:, 0], x), 1]
        own = np.isclose(target[:, 0], x)
        out[own] = (target[own, 1] < z.min() - eps) | (target[own, 1] > z.max() + eps)
    return out


def linear_matrix(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(targets, sources): linear interpolation in one dimension, constant beyond the ends; sources rise."""
    out = np.zeros((len(target), len(source)))
    at = np.clip(np.searchsorted(source, target, side="right") - 1, 0, max(len(source) - 2, 0))
    if len(source) == 1:
        return np.ones((len(target), 1))
    share = np.clip((target - source[at]) / (source[at + 1] - source[at]), 0, 1)
    rows = np.arange(len(target))
    out[rows, at], out[rows, at + 1] = 1 - share, share
    return out


def switching_rates(bins: int, units: int, affinity: float, least: float, down_most: float, up_least: float, most: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(states, rates (bins, units)): a population with two states drawn bin by bin. A share of the units is up in the first state and down in the second, an equal share the reverse, and the rest keep one rate."""
    if not 2 * affinity < 1:
        raise ValueError("the two shares must leave some units to the rest")
    r = np.random.default_rng(seed)
    states, kind = r.integers(0, 2, bins), r.choice(3, units, p=[affinity, affinity, 1 - 2 * affinity])
    down, up, any_ = r.uniform(least, down_most, units), r.uniform(up_least, most, units), r.uniform(least, most, units)
    table = np.stack([np.where(kind == 2, any_, np.where(kind == s, up, down)) for s in (0, 1)])
    return states, table[states]
