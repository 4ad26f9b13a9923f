"""Matching with sub-sample phases: low-rank templates, their products with a recording and with each other, greedy pursuit with fine matches, passes that choose each spike anew, and templates that follow the drift.

Templates are a unit table. What a chunk needs (samples with margins, products of all units) is bounded by its length; pair products are kept for pairs whose templates meet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .detect import with_halo

SCHEMA = "chunk long, t long, unit int, phase int, objective double, scaling double"


def cubic_taps(fraction: float) -> np.ndarray:
    """Weights of the samples at -1, 0, 1 and 2 for a value at `fraction` between 0 and 1: cubic convolution with a = -0.5."""
    out = []
    for d in (1 + fraction, fraction, 1 - fraction, 2 - fraction):
        out.append(1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2)
    return np.array(out)


def delayed(waves: np.ndarray, phases: int) -> np.ndarray:
    """(..., phases, length): waves (..., length) delayed by p / phases of a sample, zeros beyond the ends."""
    out = np.zeros((*waves.shape[:-1], phases, waves.shape[-1]))
    padded = np.concatenate([np.zeros((*waves.shape[:-1], 2)), waves, np.zeros((*waves.shape[:-1], 2))], -1)
    n = waves.shape[-1]
    for p in range(phases):
        # the value at t - f lies a share 1 - f after t - 1
        for k, w in enumerate(cubic_taps(1 - p / phases) if p else (0.0, 0.0, 1.0, 0.0)):
            out[..., p, :] += w * padded[..., k : k + n]
    return out


def overlap_correlate(x: np.ndarray, kernel: np.ndarray, block: int = 4096) -> np.ndarray:
    """Sums of x[..., i + k] kernel[..., k] over k for all i with a full kernel, by Fourier transforms of blocks; leading axes are broadcast."""
    n, length = x.shape[-1] - kernel.shape[-1] + 1, kernel.shape[-1]
    shape = np.broadcast_shapes(x.shape[:-1], kernel.shape[:-1])
    out = np.zeros((*shape, max(n, 0)))
    size = block + length - 1
    spectrum = np.conj(np.fft.rfft(kernel, size))
    for a in range(0, max(n, 0), block):
        m = min(block, n - a)
        out[..., a : a + m] = np.fft.irfft(np.fft.rfft(x[..., a : a + m + length - 1], size) * spectrum, size)[..., :m]
    return out


@dataclass(frozen=True)
class Bank:
    """temporal (units, phases, rank, length) with the singular values, spatial (units, rank, channels), names of units and the sample of the trough."""

    temporal: np.ndarray
    spatial: np.ndarray
    units: list[int]
    trough: int

    @classmethod
    def of(cls, templates: np.ndarray, units: list[int], trough: int, rank: int = 5, phases: int = 8) -> Bank:
        """From templates (units, length, channels): their leading parts of a singular value decomposition."""
        u, s, v = np.linalg.svd(templates, full_matrices=False)
        r = min(rank, s.shape[1])
        return cls(delayed(np.swapaxes(u[:, :, :r] * s[:, None, :r], 1, 2), phases).swapaxes(1, 2), v[:, :r], units, trough)

    @property
    def length(self) -> int:
        return self.temporal.shape[-1]

    @property
    def phases(self) -> int:
        return self.temporal.shape[1]

    def full(self, unit: int, phase: int = 0) -> np.ndarray:
        """(length, channels)."""
        return self.temporal[unit, phase].T @ self.spatial[unit]

    def squares(self) -> np.ndarray:
        """(units, phases)."""
        gram = np.einsum("krc,ksc->krs", self.spatial, self.spatial)
        return np.einsum("kprt,kpst,krs->kp", self.temporal, self.temporal, gram)

    def spectra(self) -> np.ndarray:
        """Of the temporal parts of phase 0, long enough for all lags of two templates: (units, rank, frequencies)."""
        return np.fft.rfft(self.temporal[:, 0], 1 << (2 * self.length - 1).bit_length())

    def products(self, x: np.ndarray) -> np.ndarray:
        """(units, times): products of the templates of phase 0 with x (times, channels) at each start; channels first, then times."""
        out = np.zeros((len(self.units), max(len(x) - self.length + 1, 0)))
        for k in range(len(self.units)):
            out[k] = overlap_correlate(self.spatial[k] @ x.T, self.temporal[k, 0]).sum(0)
        return out

    def on(self, channels: np.ndarray) -> Bank:
        """The same on other channels, given as indices into these; -1 is a channel where all templates are 0."""
        spatial = np.where(channels >= 0, self.spatial[:, :, np.maximum(channels, 0)], 0.0)
        return Bank(self.temporal, spatial, self.units, self.trough)


def pair_products(bank: Bank, a: int, b: int, least: float = 0.0) -> np.ndarray | None:
    """(phases, 2 length - 1): products of a's phase 0 with b's phases, a starting from length - 1 samples before b to as many after; None if none exceeds least."""
    cross = bank.spatial[a] @ bank.spatial[b].T
    n = bank.length
    mixed = np.einsum("rs,pst->prt", cross, bank.temporal[b])
    padded = np.pad(mixed, ((0, 0), (0, 0), (n - 1, n - 1)))
    out = overlap_correlate(padded, bank.temporal[a, 0][None]).sum(1)
    return out if np.abs(out).max(initial=0) > least else None


def unit_products(bank: Bank, b: int, least: float = 0.0, spectra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(others, table): pair_products(bank, a, b) of all units a that meet b, in one go; table is (others, phases, 2 length - 1). spectra: bank.spectra(), if at hand."""
    n = bank.length
    ta = bank.spectra() if spectra is None else spectra
    cross = np.einsum("arc,sc->ars", bank.spatial, bank.spatial[b])
    near = np.flatnonzero(np.abs(cross).max((1, 2), initial=0) > 0)
    size = 2 * (ta.shape[-1] - 1)
    tb = np.fft.rfft(bank.temporal[b], size)
    mixed = np.einsum("arf,ars->asf", ta[near].conj(), cross[near], optimize=True)
    full = np.fft.irfft(np.einsum("asf,psf->apf", mixed, tb, optimize=True), size)
    table = np.concatenate([full[..., size - (n - 1) :], full[..., :n]], -1)
    meets = np.abs(table).max((1, 2), initial=0) > least if len(near) else np.zeros(0, bool)
    return near[meets], table[meets]


def pair_table(spark: SparkSession, bank: Bank, least: float = 0.0) -> DataFrame:
    """(a, b, phase, lag, product) of all pairs of units that meet, entries above least in size; pairs are dealt over tasks."""
    ship(spark)
    k, n = len(bank.units), bank.length

    def run(batches):
        spectra = bank.spectra()
        for pdf in batches:
            for b in pdf["id"]:
                others, table = unit_products(bank, int(b), least, spectra)
                for a, got in zip(others, table):
                    p, lag = np.nonzero(np.abs(got) > least)
                    yield pd.DataFrame({"a": bank.units[a], "b": bank.units[b], "phase": p, "lag": lag - n + 1, "product": got[p, lag]})

    return spark.range(0, k, 1, max(1, min(k, spark.sparkContext.defaultParallelism * 4))).mapInPandas(run, "a int, b int, phase int, lag int, product double")


class Pursuit:
    """Greedy pursuit in a trace (times, channels). Each step takes the times that are highest within a template's length and exceed the threshold, finds unit by phase 0, then phase, sample and scaling, and
    subtracts; products of all units follow from the pair products. Each pass thereafter puts every spike back by itself and takes the best unit, phase and time within `reach` of it, so the residual's square never rises.

    scale_sd and boundary as in matching.pursuit. A unit isn't found twice within the dead time. A unit's pair products are computed when it is first found, for all units that it meets at once, and at most `held` bytes of them are kept,
    so setting up grows with the number of units alone.
    """

    def __init__(self, bank: Bank, threshold: float, refractory: int = 10, scale_sd: float = 0.0, boundary: float = 0.5, passes: int = 1, reach: int = 2, least: float = 0.0, held: int = 256 << 20) -> None:
        self.bank, self.threshold, self.dead, self.passes, self.reach = bank, threshold, refractory, passes, reach
        self.inv = 1 / scale_sd**2 if scale_sd else 0.0
        self.low, self.high = (1 / (1 + boundary), 1 + boundary) if scale_sd else (1.0, 1.0)
        self.square = bank.squares()
        self.least, self.held, self.spectra = least, held, bank.spectra()
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.bytes = 0

    def meeting(self, unit: int) -> tuple[np.ndarray, np.ndarray]:
        """The units that a unit meets, and its products with them."""
        if (got := self.pairs.pop(unit, None)) is None:
            got = unit_products(self.bank, unit, self.least, self.spectra)
            self.bytes += got[1].nbytes
            while self.pairs and self.bytes > self.held:
                self.bytes -= self.pairs.pop(next(iter(self.pairs)))[1].nbytes
        self.pairs[unit] = got  # the last one used goes last
        return got

    def score(self, conv: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.inv:
            return 2 * conv - square, np.ones_like(conv)
        s = np.clip((conv + self.inv) / (square + self.inv), self.low, self.high)
        return 2 * s * conv - s**2 * square - self.inv * (s - 1) ** 2, s

    def _apply(self, at: int, unit: int, phase: int, scale: float, sign: int) -> None:
        n, total = self.bank.length, self.conv.shape[1]
        self.x[at : at + n] -= sign * scale * self.bank.full(unit, phase)
        a, b = max(0, at - n + 1), min(total, at + n)
        others, table = self.meeting(unit)
        self.conv[others, a:b] -= sign * scale * table[:, phase, a - at + n - 1 : b - at + n - 1]
        self.barred[unit, max(0, at - self.dead) : at + self.dead + 1] += sign

    def _fine(self, at: int, units: list[int], reach: int) -> tuple[float, int, int, int, float]:
        """(objective, start, unit, phase, scaling), the best within reach; on ties the first."""
        n, best = self.bank.length, (-np.inf, at, units[0] if units else -1, 0, 1.0)
        for start in range(max(0, at - reach), min(self.conv.shape[1] - 1, at + reach) + 1):
            piece = self.x[start : start + n]
            free = [u for u in units if not self.barred[u, start]]
            if not free:
                continue
            obj, scale = self.score(np.einsum("kprt,krt->kp", self.bank.temporal[free], self.bank.spatial[free] @ piece.T), self.square[free])
            k, p = np.unravel_index(int(obj.argmax()), obj.shape)
            if obj[k, p] > best[0]:
                best = (float(obj[k, p]), start, free[k], int(p), float(scale[k, p]))
        return best

    def run(self, x: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """(time of the trough, unit, phase, objective, scaling) by time; self.x is the residual afterwards."""
        bank, n = self.bank, self.bank.length
        self.x = x.astype(float).copy()
        if len(x) < n or not bank.units:
            return []
        self.conv = bank.products(self.x)
        self.barred = np.zeros(self.conv.shape, np.int32)
        found: list[tuple[float, int, int, int, float]] = []
        # each step bars a time of a unit at least, so this ends
        while True:
            obj, _ = self.score(self.conv, self.square[:, :1])
            obj[self.barred > 0] = -np.inf
            best = obj.argmax(0)
            top = obj[best, np.arange(obj.shape[1])]
            taken, last = [], -n
            for at in np.flatnonzero(top > self.threshold**2):
                if at - last >= n and top[at] >= top[max(0, at - n + 1) : at + n].max():
                    taken.append(int(at))
                    last = at
            if not taken:
                break
            for at in taken:
                got = self._fine(at, [int(best[at])], 1)
                self._apply(got[1], got[2], got[3], got[4], 1)
                found.append(got)
        for _ in range(self.passes - 1):
            changed = False
            for i, (_, at, unit, phase, scale) in enumerate(found):
                self._apply(at, unit, phase, scale, -1)
                near = sorted({*self.meeting(unit)[0].tolist(), unit})
                got = self._fine(at, near, self.reach)
                changed |= got[1:4] != (at, unit, phase)
                self._apply(got[1], got[2], got[3], got[4], 1)
                found[i] = got
            if not changed:
                break
        self.found = sorted(found, key=lambda f: (f[1], f[2]))
        return [(at + bank.trough, bank.units[u], p, v, s) for v, at, u, p, s in self.found]

    def cleaned(self) -> np.ndarray:
        """(spikes, length, channels): each spike's snippet with all others subtracted, in the order of run's result."""
        n = self.bank.length
        return np.stack([self.x[at : at + n] + s * self.bank.full(u, p) for _, at, u, p, s in self.found]) if self.found else np.zeros((0, n, self.x.shape[1]))


def match(samples: DataFrame, bank: Bank, threshold: float, chunk: int = 30_000, shift: Callable[[int], int] | None = None, channels: dict[int, list[int]] | None = None, names: list[int] | None = None, **options) -> DataFrame:
    """Spikes (chunk, t, unit, phase, objective, scaling) of samples (t, channel, v), chunk by chunk with margins of two templates; samples that are missing count as 0.

    With shift (a chunk's number to its shift) and channels (a shift to the bank's channels of each channel of the recording, -1 for none) templates follow the drift. names are the recording's channels.
    """
    ship(samples.sparkSession)
    margin = 2 * bank.length
    own = names if names is not None else list(range(bank.spatial.shape[2]))
    at = pd.Series(range(len(own)), index=own)

    made: dict[int, Pursuit] = {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["chunk"].iloc[0])
        k = shift(number) if shift else 0
        if k not in made:
            # one shift's pair products at a time
            made.clear()
            made[k] = Pursuit(bank.on(np.array(channels[k])) if channels else bank, threshold, **options)
        first = number * chunk - margin
        x = np.zeros((chunk + 2 * margin, len(own)))
        col = pdf["channel"].map(at)
        ok = col.notna().to_numpy()
        x[(pdf["t"].to_numpy() - first)[ok], col[ok].astype(int)] = pdf["v"].to_numpy(float)[ok]
        rows = [(number, first + t, u, p, o, s) for t, u, p, o, s in made[k].run(x) if margin <= t < margin + chunk]
        return pd.DataFrame(rows, columns=["chunk", "t", "unit", "phase", "objective", "scaling"])

    return with_halo(samples.select("t", "channel", "v"), chunk, margin).groupBy("chunk").applyInPandas(run, SCHEMA)


def false_positives(spark: SparkSession, bank: Bank, noise: Callable[[int, int], np.ndarray], threshold: float = 5.0, blocks: int = 100, length: int = 4096, **options) -> DataFrame:
    """(block, unit, objective) of what is found in drawn noise: noise(length, seed) gives (length, channels) for each block, whose number is the seed. Dealt over tasks."""
    ship(spark)

    def run(batches):
        find = Pursuit(bank, threshold, **options)
        for pdf in batches:
            for i in pdf["id"]:
                got = find.run(noise(length, int(i)))
                yield pd.DataFrame({"block": [i] * len(got), "unit": [g[1] for g in got], "objective": [g[3] for g in got]}).astype({"unit": "int32", "block": "int64", "objective": float})

    return spark.range(blocks).mapInPandas(run, "block long, unit int, objective double")


def shared_basis(templates: np.ndarray, rank: int) -> np.ndarray:
    """(rank, length): the leading temporal components of all templates (units, length, channels) together, uncentred; their signs make the entry of largest size positive."""
    flat = templates.transpose(0, 2, 1).reshape(-1, templates.shape[1])
    v = np.linalg.svd(flat, full_matrices=False)[2][:rank]
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def compressed(templates: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(units, rank, channels): templates in a shared orthonormal basis."""
    return np.einsum("rt,ktc->krc", basis, templates)


def pair_shifts(shifts: DataFrame, table: DataFrame) -> DataFrame:
    """Lookups (a, b, phase, lag) in a pair table; pairs that don't meet have product 0."""
    return shifts.join(table, ["a", "b", "phase", "lag"], "left").withColumn("product", F.coalesce("product", F.lit(0.0)))
