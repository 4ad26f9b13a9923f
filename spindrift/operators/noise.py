"""Noise of channels: robust levels, references, covariance, spectra, whitening and high-pass filters.

Tables of channels and matrices of them are small and only they reach the driver; samples never do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Standard deviations of a normal distribution in one median absolute deviation.
MAD_SCALE = 1.4826


def levels(samples: DataFrame, channel: str = "channel", v: str = "v") -> DataFrame:
    """(channel, centre, level): median and scaled median absolute deviation. Partial aggregation counts distinct values, so digitised samples shrink before the shuffle."""
    centre = samples.groupBy(channel).agg(F.median(v).alias("centre"))
    off = samples.join(centre, channel).withColumn("_d", F.abs(F.col(v) - F.col("centre")))
    return off.groupBy(channel).agg(F.first("centre").alias("centre"), (F.median("_d") * MAD_SCALE).alias("level"))


def standardize(samples: DataFrame, channel: str = "channel", v: str = "v", to: str = "z") -> DataFrame:
    """Samples over their channel's noise level; null where the level is 0."""
    return samples.join(levels(samples, channel, v).select(channel, "level"), channel).withColumn(to, F.try_divide(F.col(v).cast("double"), F.col("level"))).drop("level")


def median_reference(samples: DataFrame, t: str = "t", v: str = "v", to: str = "ref") -> DataFrame:
    """Samples less the median over the channels of their time; a group is at most the channels of one time."""
    return samples.withColumn(to, F.col(v) - F.median(v).over(Window.partitionBy(t)))


def channel_covariance(samples: DataFrame, t: str = "t", channel: str = "channel", v: str = "v") -> DataFrame:
    """(i, j, cov, n) for i <= j: mean products over the times that have both channels. One shuffle gathers a time's channels, then pairs are summed partially."""
    x = samples.groupBy(t).agg(F.sort_array(F.collect_list(F.struct(F.col(channel).alias("c"), F.col(v).cast("double").alias("x")))).alias("a"))
    first = x.select(F.posexplode("a").alias("k", "p"), "a")
    both = first.select("p", F.explode(F.slice("a", F.col("k") + 1, F.size("a"))).alias("q"))
    return both.groupBy(F.col("p.c").alias("i"), F.col("q.c").alias("j")).agg(F.avg(F.col("p.x") * F.col("q.x")).alias("cov"), F.count(F.lit(1)).alias("n"))


def matrix(pairs: DataFrame, value: str = "cov") -> tuple[list, np.ndarray]:
    """A pair table (i, j, value) as channels and a symmetric matrix; it has a row for two channels."""
    got = pairs.select("i", "j", value).toPandas()
    names = sorted({*got["i"], *got["j"]})
    at = {c: k for k, c in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    i, j = got["i"].map(at).to_numpy(int), got["j"].map(at).to_numpy(int)
    out[i, j] = out[j, i] = got[value]
    return names, out


def zca(cov: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """The symmetric inverse square root of a covariance."""
    w, u = np.linalg.eigh(cov)
    return (u / np.sqrt(np.maximum(w, 0) + eps)) @ u.T


def local_zca(cov: np.ndarray, neighbours: list[list[int]], eps: float = 1e-6) -> np.ndarray:
    """Each row is that of the whitener of the channel's own neighbourhood (which holds the channel), zero elsewhere."""
    out = np.zeros_like(cov)
    for c, near in enumerate(neighbours):
        out[c, near] = zca(cov[np.ix_(near, near)], eps)[near.index(c)]
    return out


def local_cholesky(cov: np.ndarray, neighbours: list[list[int]], eps: float = 1e-6) -> np.ndarray:
    """A lower triangular whitener: each channel less its regression on the neighbours before it, over the remaining standard deviation."""
    out = np.zeros_like(cov)
    for c, near in enumerate(neighbours):
        before = [n for n in near if n < c]
        coef = np.linalg.solve(cov[np.ix_(before, before)] + eps * np.eye(len(before)), cov[before, c]) if before else np.zeros(0)
        scale = np.sqrt(max(cov[c, c] - float(coef @ cov[before, c]), 0) + eps)
        out[c, before], out[c, c] = -coef / scale, 1 / scale
    return out


def apply_matrix(rows: DataFrame, m: np.ndarray, v: str = "v", to: str = "white") -> DataFrame:
    """m times each row's array, in Arrow batches; the matrix of channels goes along with the function."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def times(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()).astype(float) @ m.T)) if len(x) else x

    return rows.withColumn(to, times(F.col(v)))


def spectrum(rows: DataFrame, length: int, v: str = "v") -> DataFrame:
    """(freq, power): mean periodogram of the arrays' half-overlapping Hann-windowed segments of `length`; an array shorter than that adds nothing."""
    ship(rows.sparkSession)

    def part(batches):
        window = np.hanning(length + 2)[1:-1]
        power, n = np.zeros(length // 2 + 1), 0
        for pdf in batches:
            for x in pdf[v]:
                for a in range(0, len(x) - length + 1, max(length // 2, 1)):
                    power += np.abs(np.fft.rfft(np.asarray(x[a : a + length], float) * window)) ** 2
                    n += 1
        yield pd.DataFrame({"freq": np.arange(len(power)), "p": power / (window @ window), "n": n})

    parts = rows.select(v).mapInPandas(part, "freq int, p double, n long")
    return parts.groupBy("freq").agg(F.try_divide(F.sum("p"), F.sum("n")).alias("power"))


def whitening_kernel(power: np.ndarray, taps: int, eps: float = 1e-12) -> np.ndarray:
    """A symmetric filter of an odd number of taps whose gain is near 1 / sqrt(power)."""
    full = np.fft.fftshift(np.fft.irfft(1 / np.sqrt(power + eps)))
    mid = len(full) // 2
    return full[mid - taps // 2 : mid + taps // 2 + 1]


def highpass_kernel(cutoff: float, rate: float, taps: int) -> np.ndarray:
    """A windowed-sinc high-pass of an odd number of taps; its gain at 0 is exactly 0."""
    k = np.arange(taps) - taps // 2
    low = np.sinc(2 * cutoff / rate * k) * np.hamming(taps)
    return (k == 0) - low / low.sum()


def convolve(traces: DataFrame, kernel: np.ndarray, to: str = "v") -> DataFrame:
    """A filter of an odd number of taps over traces (chunk_id, channel, t0, v); beyond the first and last chunk samples count as 0.

    Each chunk sends its margins to the chunks beside it, so one shuffle by channel and chunk does and no channel is ever gathered. Chunks are longer than half the filter.
    """
    ship(traces.sparkSession)
    half = len(kernel) // 2
    v = F.col("v")
    own = traces.select("channel", "chunk_id", "t0", v.alias("_v"), F.lit(None).cast("array<float>").alias("_l"), F.lit(None).cast("array<float>").alias("_r"))
    tail, head = F.slice(v, F.greatest(F.size(v) - half + 1, F.lit(1)), half), F.slice(v, 1, half)
    none, zero = F.lit(None).cast("array<float>"), F.lit(None).cast("long")
    right = traces.select("channel", (F.col("chunk_id") + 1).alias("chunk_id"), zero.alias("t0"), none.alias("_v"), tail.cast("array<float>").alias("_l"), none.alias("_r"))
    left = traces.select("channel", (F.col("chunk_id") - 1).alias("chunk_id"), zero.alias("t0"), none.alias("_v"), none.alias("_l"), head.cast("array<float>").alias("_r"))
    met = own.unionByName(right).unionByName(left).groupBy("channel", "chunk_id").agg(*(F.max(c).alias(c) for c in ("t0",)), *(F.first(c, True).alias(c) for c in ("_v", "_l", "_r"))).where("_v is not null")

    @F.pandas_udf("array<float>")
    def run(l: pd.Series, x: pd.Series, r: pd.Series) -> pd.Series:  # noqa: E741
        out = []
        for a, b, c in zip(l, x, r):
            a = np.zeros(0) if a is None else np.asarray(a, float)
            c = np.zeros(0) if c is None else np.asarray(c, float)
            whole = np.concatenate([np.zeros(half - len(a)), a, np.asarray(b, float), c, np.zeros(half - len(c))])
            out.append(np.convolve(whole, kernel, "valid").astype("float32"))
        return pd.Series(out)

    return met.select("chunk_id", "channel", "t0", run("_l", "_v", "_r").alias(to))


def factorized(snippets: DataFrame, times: int, channels: int, v: str = "v", eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(temporal, spatial): covariances whose Kronecker product is the best rank-one form of the snippets' covariance (time-major arrays); the spatial one has mean diagonal 1."""
    from .cluster import gramian

    n = max(snippets.count(), 1)
    full = gramian(snippets, v, times * channels) / n
    mixed = full.reshape(times, channels, times, channels).transpose(0, 2, 1, 3).reshape(times * times, channels * channels)
    u, s, w = np.linalg.svd(mixed, full_matrices=False)
    temporal, spatial = u[:, 0].reshape(times, times) * s[0], w[0].reshape(channels, channels)
    scale = np.trace(spatial) / channels
    scale = scale if abs(scale) > eps else 1.0
    return temporal * scale, spatial / scale
