"""Subtraction and shaving of spikes from samples: detect, denoise, take away what lowers the residual enough, look again; and fitting the denoiser on what a bounded subtraction finds.

Samples (t, channel, v) are only ever grouped by chunks of bounded length with margins. In a chunk spikes are taken one after the other, the highest first, each from the residual that the ones before it left, and a spike whose denoised
snippet would lower the square of that residual by no more than the threshold's square is put back at once; so the residual's norm falls with each spike that is kept and is exactly untouched by all others. `shave` is one such
round, `subtract` repeats them until none is kept. Chunks agree as far as their margins do: what a chain of overlapping spikes longer than the margin decides may differ from one cut to another.

`fit` alternates: snippets at peaks above the threshold give a first temporal basis, a subtraction of a bounded number of chunks with it gives cleaned snippets, these the next basis, until it stays the same. Sums
are added up in executors, and each round's basis is a file that a run which starts again reads instead.

Defined cases: null and missing samples are 0; spikes whose snippet doesn't lie within the chunk and its margins are not taken; of equal heights the earlier, then the lesser channel is first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..staging import stage
from .detect import _dense, peaks_by_chunk, with_halo
from .features import TemporalBasis
from .recordings import peel_some

SCHEMA = "kind string, chunk long, t long, channel int, height double, decrease double, near array<int>, v array<double>"


@dataclass(frozen=True)
class Settings:
    """before, length, radii in samples; sign -1 for troughs, 1 for peaks, 0 for both; threshold in the samples' unit, decrease in its root of summed squares; realign: how far a spike's time may follow its denoised snippet."""

    before: int = 42
    length: int = 121
    threshold: float = 5.0
    decrease: float = 10.0
    sign: int = 0
    peak_radius: int = 5
    dedup_radius: int = 7
    realign: int = 0
    rounds: int = 50

    def margin(self) -> int:
        return 2 * self.length + self.peak_radius


@dataclass(frozen=True)
class Projection:
    """A denoiser: what a temporal basis keeps of each channel's snippet."""

    components: np.ndarray
    mean: np.ndarray

    def __call__(self, w: np.ndarray) -> np.ndarray:
        return self.mean[:, None] + self.components.T @ (self.components @ (w - self.mean[:, None]))


@dataclass(frozen=True)
class Pursuit:
    """A denoiser: on each channel the one shape, scaled, that explains most of the snippet."""

    shapes: np.ndarray

    def __call__(self, w: np.ndarray) -> np.ndarray:
        unit = self.shapes / np.maximum(np.sqrt((self.shapes**2).sum(1, keepdims=True)), 1e-300)
        dots = unit @ w
        best = np.abs(dots).argmax(0)
        return unit[best].T * np.take_along_axis(dots, best[None], 0)


def extrema(h: np.ndarray, radius: int, threshold: float) -> np.ndarray:
    """(n, 2) of time and channel: values above threshold that none of the channel within radius exceeds, the earlier of equal ones; highest first."""
    top = h > threshold
    for k in range(1, radius + 1):
        top[k:] &= h[k:] > h[:-k]
        top[:-k] &= h[:-k] >= h[k:]
    t, c = np.nonzero(top)
    return np.stack([t, c], 1)[np.lexsort((c, t, -h[t, c]))]


def _heights(x: np.ndarray, sign: int) -> np.ndarray:
    return np.abs(x) if sign == 0 else x * sign


def one_round(x: np.ndarray, s: Settings, near: list[np.ndarray], denoise: Callable[[np.ndarray], np.ndarray], barred: set) -> list[tuple]:
    """Takes spikes from x, in place: (time, channel, height, decrease, denoised snippet). What is put back is added to `barred` and not tried again."""
    free, kept = np.ones(x.shape, bool), []
    for t, c in extrema(_heights(x, s.sign), s.peak_radius, s.threshold):
        if not free[t, c] or (int(t), int(c)) in barred:
            continue
        free[max(t - s.dedup_radius, 0) : t + s.dedup_radius + 1, near[c]] = False
        at, height = int(t), float(x[t, c])
        if at < s.before or at - s.before + s.length > len(x):
            continue
        w = x[at - s.before : at - s.before + s.length, near[c]]
        d = denoise(w)
        if s.realign:
            main = d[s.before - s.realign : s.before + s.realign + 1, int(np.flatnonzero(near[c] == c)[0])]
            moved = at + int((main * (np.sign(height) if s.sign == 0 else s.sign)).argmax()) - s.realign
            if moved != at and s.before <= moved <= len(x) - s.length + s.before:
                other = x[moved - s.before : moved - s.before + s.length, near[c]]
                e = denoise(other)
                if 2 * (other * e).sum() - (e * e).sum() > 2 * (w * d).sum() - (d * d).sum():
                    at, w, d = moved, other, e
        gain = 2 * float((w * d).sum()) - float((d * d).sum())
        if gain > s.decrease**2:
            x[at - s.before : at - s.before + s.length, near[c]] -= d
            kept.append((at, int(c), height, gain, d))
        else:
            barred.add((int(t), int(c)))
    return kept


def kernel(channels: list[int], near: dict[int, list[int]], s: Settings, denoise: Callable, chunk: int, residual: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The function over a chunk of detect.peel: its spikes with their cleaned snippets, and if asked for its residual, a row a channel."""
    around = [np.array(sorted(channels.index(n) for n in near[c])) for c in channels]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["core"].any():  # margins of its neighbours alone
            return pd.DataFrame(columns=[f.split()[0] for f in SCHEMA.split(", ")])
        first, x = _dense(pdf.assign(v=pdf["v"].fillna(0.0)), channels)
        k = int(pdf["chunk"].iloc[0])
        found, barred = [], set()
        for _ in range(s.rounds):
            kept = one_round(x, s, around, denoise, barred)
            found += kept
            if not kept:
                break
        rows = []
        for at, c, height, gain, d in sorted(found, key=lambda r: r[:2]):
            if (first + at) // chunk == k:
                clean = d + x[at - s.before : at - s.before + s.length, around[c]]
                rows.append(("spike", k, first + at, channels[c], height, gain, [channels[i] for i in around[c]], clean.T.ravel()))
        if residual:
            a, b = max(k * chunk - first, 0), min((k + 1) * chunk - first, len(x))
            rows += [("residual", k, first + a, name, None, None, None, x[a:b, i].copy()) for i, name in enumerate(channels)]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return run


def near_of(index: DataFrame) -> dict[int, list[int]]:
    """A channel index (channel, neighbor), a small table, as a dictionary."""
    out: dict[int, list[int]] = {}
    for r in index.select("channel", "neighbor").distinct().collect():
        out.setdefault(r.channel, []).append(r.neighbor)
    return out


def subtract(samples: DataFrame, index: DataFrame, denoise: Callable, s: Settings = Settings(), chunk: int = 30_000, residual: bool = True) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(spikes, residual). spikes: t, channel, height (as met), decrease (of the residual's square), near, v (cleaned snippets of the channels `near`, one after the other); residual: t, channel, v."""
    ship(samples.sparkSession)
    near = near_of(index)
    halo = with_halo(samples.select("t", F.col("channel").cast("int").alias("channel"), F.col("v").cast("double").alias("v")), chunk, s.margin())
    both, _ = stage(halo.groupBy("chunk").applyInPandas(kernel(sorted(near), near, s, denoise, chunk, residual), SCHEMA), "subtracted")
    left = both.where("kind = 'residual'").select(F.col("t").alias("_t"), "channel", F.posexplode("v").alias("_k", "v"))
    return both.where("kind = 'spike'").select("t", "channel", "height", "decrease", "near", "v"), left.select((F.col("_t") + F.col("_k")).alias("t"), "channel", "v")


def balance(samples: DataFrame, index: DataFrame, denoise: Callable, s: Settings = Settings(), chunk: int = 30_000) -> DataFrame:  # noqa: B008
    """(chunk, spikes, before, after, decrease): the square of each chunk with its margins before and after its subtraction, and what the spikes taken there, also those of margins, lowered it by; the last is the difference of the first two."""
    ship(samples.sparkSession)
    near = near_of(index)
    channels = sorted(near)
    around = [np.array(sorted(channels.index(n) for n in near[c])) for c in channels]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["core"].any():  # margins of its neighbours alone
            return pd.DataFrame({c: [] for c in ("chunk", "spikes", "before", "after", "decrease")})
        _, x = _dense(pdf.assign(v=pdf["v"].fillna(0.0)), channels)
        before, barred, gains = float((x * x).sum()), set(), []
        for _ in range(s.rounds):
            kept = one_round(x, s, around, denoise, barred)
            gains += [k[3] for k in kept]
            if not kept:
                break
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "spikes": [len(gains)], "before": [before], "after": [float((x * x).sum())], "decrease": [float(sum(gains))]})

    halo = with_halo(samples.select("t", F.col("channel").cast("int").alias("channel"), F.col("v").cast("double").alias("v")), chunk, s.margin())
    return halo.groupBy("chunk").applyInPandas(run, "chunk long, spikes long, before double, after double, decrease double")


def shave(samples: DataFrame, index: DataFrame, denoise: Callable, s: Settings = Settings(), chunk: int = 30_000) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """subtract in a single round, as for what a pass before it left over."""
    return subtract(samples, index, denoise, Settings(**{**s.__dict__, "rounds": 1}), chunk)


def snippets(spikes: DataFrame, length: int) -> DataFrame:
    """(v): each channel's cleaned snippet of each spike, as a row."""
    return spikes.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("near") - 1), lambda i: F.slice("v", i * length + 1, F.lit(length)))).alias("v"))


def threshold_snippets(samples: DataFrame, s: Settings, chunk: int, near: dict[int, list[int]], chunks: list[int] | None = None) -> DataFrame:
    """(v): the snippets at peaks above the threshold on their own channel, without any subtraction: what a first basis is fitted to."""
    from .detect import grab

    some = samples.select("t", F.col("channel").cast("int").alias("channel"), F.col("v").cast("double").alias("v"))
    peaks = peaks_by_chunk(some, chunk, s.peak_radius, s.threshold, s.sign)
    if chunks is not None:
        peaks = peaks.where(F.floor(F.col("t") / chunk).isin(chunks))
    spikes = peaks.select(F.xxhash64("t", "channel").alias("spike_id"), "t", "channel")
    return grab(some, spikes, {c: [c] for c in near}, s.before, s.length, chunk).select("v")


def angle(a: np.ndarray, b: np.ndarray) -> float:
    """The sine of the greatest angle between the spaces of two orthonormal bases."""
    if a.shape != b.shape:
        return 1.0
    least = np.linalg.svd(a @ b.T, compute_uv=False).min()
    return float(np.sqrt(max(1 - least**2, 0.0)))


def fit(samples: DataFrame, index: DataFrame, rank: int, s: Settings = Settings(), chunk: int = 30_000, chunks: Iterable[int] | None = None, enough: int = 50_000, most: int = 5, tol: float = 0.05, folder: str | None = None, seed: int = 0) -> tuple[Projection, list[float]]:  # noqa: B008
    """The denoiser that a subtraction with it reproduces, and how far each round's basis turned from the one before it.

    Each round subtracts chunks in a drawn order until there are `enough` spikes, so its work has a documented bound; `chunks`, by default all, are those it may draw. `folder`, shared by all machines, keeps each round's basis.
    """
    spark, near = ship(samples.sparkSession), near_of(index)
    every = sorted(r[0] for r in samples.select(F.floor(F.col("t") / chunk)).distinct().collect()) if chunks is None else list(chunks)
    own = samples.select("t", F.col("channel").cast("int").alias("channel"), F.col("v").cast("double").alias("v"))

    def kept(k: int, make: Callable[[], TemporalBasis]) -> Projection:
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/basis-{k}/_SUCCESS")
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                r = spark.read.parquet(f"{folder}/basis-{k}").first()
                return Projection(np.array(r["components"], float).reshape(-1, s.length), np.array(r["mean"], float))
        basis = make()
        if folder:
            row = [(np.asarray(basis.components, float).ravel().tolist(), np.asarray(basis.mean, float).tolist())]
            spark.createDataFrame(row, "components array<double>, mean array<double>").write.mode("overwrite").parquet(f"{folder}/basis-{k}")
        return Projection(np.asarray(basis.components), np.asarray(basis.mean))

    start = every if len(every) <= 32 else [every[i] for i in np.random.default_rng(seed).permutation(len(every))[:32]]
    now = kept(0, lambda: TemporalBasis.fit(threshold_snippets(own, s, chunk, near, start), rank, centred=False))
    turned: list[float] = []
    for k in range(1, most + 1):
        if not len(now.components):
            break

        def make(now=now) -> TemporalBasis:
            run = kernel(sorted(near), near, s, now, chunk, False)
            found = peel_some(own, chunk, s.margin(), run, SCHEMA, every, enough, seed=seed)
            return TemporalBasis.fit(snippets(found, s.length), rank, centred=False)

        new = kept(k, make)
        turned.append(angle(now.components, new.components))
        if not len(new.components):
            break
        now = new
        if turned[-1] < tol:
            break
    return now, turned
