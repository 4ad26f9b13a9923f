"""Whether a sample in one dimension has one mode or two about a cut: smoothed densities against isotonic ones, for a unit's few thousand values."""

from __future__ import annotations

import numpy as np


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The nearest rising sequence in weighted squares, by pooling neighbours that fall."""
    w = np.ones(len(y)) if w is None else w
    level, weight, size = [], [], []
    for a, b in zip(y.astype(float), w.astype(float)):
        level.append(a), weight.append(b), size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            a, b, n = level.pop(), weight.pop(), size.pop()
            total = weight[-1] + b
            level[-1] = (level[-1] * weight[-1] + a * b) / total
            weight[-1], size[-1] = total, size[-1] + n
    return np.repeat(level, size)


def up_down(y: np.ndarray) -> np.ndarray:
    """The nearest sequence that rises and then falls: the best of all places for its top."""
    best, out = np.inf, y
    for k in range(len(y) + 1):
        fit = np.concatenate([isotonic(y[:k]), -isotonic(-y[k:])])
        if (e := float(((fit - y) ** 2).sum())) < best - 1e-15:
            best, out = e, fit
    return out


def unimodal_right(x: np.ndarray, density: np.ndarray, cut: float) -> np.ndarray:
    """One mode left of the cut: what lies right of it falls."""
    right = x >= cut
    out = density.astype(float).copy()
    out[right] = -isotonic(-density[right])
    return out


def bimodal_at(x: np.ndarray, density: np.ndarray, cut: float) -> np.ndarray:
    """A mode on either side of the cut."""
    left = x < cut
    return np.concatenate([up_down(density[left]), up_down(density[~left])])


def smoothed(samples: np.ndarray, grid: np.ndarray, width: float) -> np.ndarray:
    """Gaussian density on a grid, from a histogram on it."""
    step = grid[1] - grid[0]
    at = np.clip(np.floor((samples - grid[0]) / step + 0.5).astype(int), 0, len(grid) - 1)
    h = np.bincount(at, minlength=len(grid)).astype(float)
    reach = max(1, int(np.ceil(4 * width / step)))
    kernel = np.exp(-((np.arange(-reach, reach + 1) * step) ** 2) / (2 * width**2))
    h = np.convolve(h, kernel / kernel.sum(), "full")[reach : reach + len(grid)]
    return h / (h.sum() * step)


def dip(samples: np.ndarray, cut: float | None = None, bins: int = 256) -> float:
    """How far the smoothed density is from one that has one mode left or right of the cut, in total variation (0: one mode). Without a cut, it is the lowest place between the peaks
    nearest to 0 on either side. Fewer than three samples, or all equal ones, score 0."""
    samples = np.sort(samples[np.isfinite(samples)].astype(float))
    if len(samples) < 3 or samples[0] == samples[-1]:
        return 0.0
    width = 0.5 * 1.06 * samples.std() * len(samples) ** -0.2
    grid = np.linspace(samples[0] - 3 * width, samples[-1] + 3 * width, bins)
    f = smoothed(samples, grid, width)
    if cut is None:
        peaks = np.flatnonzero((f[1:-1] > f[:-2]) & (f[1:-1] >= f[2:])) + 1
        low, high = grid[peaks][grid[peaks] < 0], grid[peaks][grid[peaks] > 0]
        between = (grid >= (low.max() if len(low) else 0.0)) & (grid <= (high.min() if len(high) else 0.0))
        cut = float(grid[between][f[between].argmin()]) if between.any() else 0.0
    step = grid[1] - grid[0]
    fits = [unimodal_right(grid, f, cut), unimodal_right(-grid[::-1], f[::-1], -cut)[::-1]]
    return min(0.5 * float(np.abs(g - f).sum() * step) for g in fits)
