"""Nonrigid drift from the data: displacement by time bin and window of depth, from correlations of depth histograms and a least-squares problem over all of them.

1. `raster`: a histogram of depth for each time bin, aggregated by Spark.
2. `displacements`: chunks of time bins, each with a margin of `band` bins before it. In a chunk, every two time bins at most `band` apart are correlated at every lag, in each window of depth with its own weights; so pairs grow with the
   time, never with its square.
3. `solve`: the displacements p of bins and windows that minimise sum c (p_j - p_i - d)^2 over pairs, plus smoothness in time and across windows. Pairs reach only `band` bins back, so a chunk meets the one before it in that one's last
   `band` bins alone. Each chunk eliminates what lies within it; then `arity` chunks at a time are joined by eliminating the bins between them, level by level, until one is left; values are handed down the same way. No task
   holds more than a chunk or `arity` of their ends, and the result is that of the whole dense system.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..staging import stage

PAIR = "chunk long, i long, j long, win int, d double, c double"
PART = "seg long, level int, up long, a array<double>, b array<double>"


def raster(spikes: DataFrame, t: str, z: str, weight: str | None, t_bin: float, z_bin: float) -> DataFrame:
    """(tb, zb, w): the summed weight, or the number, of spikes by time and depth bin. Rows without a time, depth or weight are left out."""
    own = spikes.where(F.col(t).isNotNull() & F.col(z).isNotNull() & ~F.isnan(F.col(z).cast("double")))
    what = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
    return own.groupBy(F.floor(F.col(t) / t_bin).alias("tb"), F.floor(F.col(z) / z_bin).alias("zb")).agg(what.alias("w")).where("w is not null")


def window_weights(depths: np.ndarray, windows: int, step: float, scale: float) -> np.ndarray:
    """(windows, depths): normal weights about the windows' centres, each window's sum 1."""
    w = np.exp(-0.5 * ((depths[None] - (np.arange(windows) + 0.5)[:, None] * step) / scale) ** 2)
    return w / w.sum(1, keepdims=True)


def correlations(h: np.ndarray, weights: np.ndarray, first: int, band: int, most: int) -> list[tuple]:
    """(i, j, win, lag, c) for rows i < j <= i + band of h with j at or after `first`: the lag in bins, between two by the parabola about the best, at which row j looks most like row i within the window, and how much (their weighted correlation)."""
    n, width = h.shape
    mean, var = h @ weights.T, (h * h) @ weights.T
    var = np.maximum(var - mean**2, 0)
    padded = np.pad(h, ((0, 0), (most, most)))
    moved = [padded[:, most + lag : most + lag + width] for lag in range(-most, most + 1)]
    means = np.stack([m @ weights.T for m in moved])
    vars_ = np.maximum(np.stack([(m * m) @ weights.T for m in moved]) - means**2, 0)
    out = []
    for gap in range(1, min(band, n - 1) + 1):
        i = np.arange(max(0, first - gap), n - gap)
        if not len(i):
            continue
        j = i + gap
        c = np.stack([(h[i] * m[j]) @ weights.T for m in moved]) - mean[i] * means[:, j]
        scale = np.sqrt(var[i] * vars_[:, j])
        c = np.where(scale > 1e-12, c / np.maximum(scale, 1e-12), -1.0)
        best = c.argmax(0)
        peak = np.take_along_axis(c, best[None], 0)[0]
        left, right = (np.take_along_axis(c, np.clip(best + s, 0, 2 * most)[None], 0)[0] for s in (-1, 1))
        bend = left - 2 * peak + right
        inside = (best > 0) & (best < 2 * most) & (bend < -1e-12) & (left > -1) & (right > -1)
        lag = best - most + np.where(inside, 0.5 * (left - right) / np.where(inside, bend, 1.0), 0.0)
        for a, b, row, cs in zip(i.tolist(), j.tolist(), lag.tolist(), peak.tolist()):
            out += [(a, b, k, row[k], cs[k]) for k in range(len(row))]
    return out


def displacements(hist: DataFrame, z_bin: float, windows: int, step: float, scale: float, band: int, most: float, chunk: int, depth: int, least: float = 0.1, blur: float = 1.0) -> DataFrame:
    """(chunk, i, j, win, d, c): displacement of time bin j against i, j - i at most `band`, in each window, and its correlation where that is at least `least`. hist is a raster of `depth` depth bins from 0 up."""
    ship(hist.sparkSession)
    own = F.floor(F.col("tb") / chunk)
    late = F.pmod(F.col("tb"), F.lit(chunk)) >= chunk - band
    dealt = hist.withColumn("chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = window_weights((np.arange(depth) + 0.5) * z_bin, windows, step, scale)
    span = np.arange(-int(3 * blur), int(3 * blur) + 1)
    kernel = np.exp(-0.5 * (span / blur) ** 2) if blur > 0 else np.ones(1)

    def over(key, pdf):
        c = key[0]
        start = c * chunk - band
        h = np.zeros((chunk + band, depth))
        inside = pdf["zb"].between(0, depth - 1)
        h[(pdf["tb"][inside] - start).to_numpy(int), pdf["zb"][inside].to_numpy(int)] = np.log1p(np.maximum(pdf["w"][inside].to_numpy(float), 0))
        h = np.apply_along_axis(lambda row: np.convolve(row, kernel / kernel.sum(), "same"), 1, h) if len(kernel) > 1 and depth >= len(kernel) else h
        found = correlations(h, w, band, band, int(round(most / z_bin)))
        rows = [(c, a + start, b + start, k, lag * z_bin, r) for a, b, k, lag, r in found if r >= least]
        return pd.DataFrame(rows, columns=["chunk", "i", "j", "win", "d", "c"])

    return dealt.select("chunk", "tb", "zb", "w").groupBy("chunk").applyInPandas(over, PAIR)


def _system(pdf: pd.DataFrame, start: int, bins: int, windows: int, band: int, in_time: float, in_depth: float, ridge: float, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Normal matrix and right side of a chunk of `bins` bins and the `band` before it; of the first chunk those don't exist."""
    lead = 0 if first else band
    n = (lead + bins) * windows
    a, b = np.zeros((n, n)), np.zeros(n)
    at = lambda tb, k: ((tb - start + lead) * windows + k).astype(int)

    def tie(x, y, weight):
        np.add.at(a, (x, x), weight)
        np.add.at(a, (y, y), weight)
        np.add.at(a, (x, y), -weight)
        np.add.at(a, (y, x), -weight)

    if len(pdf):
        i, j, k = (pdf[c].to_numpy() for c in ("i", "j", "win"))
        x, y, c, d = at(i, k), at(j, k), pdf["c"].to_numpy(float), pdf["d"].to_numpy(float)
        tie(x, y, c)
        np.add.at(b, y, c * d)
        np.add.at(b, x, -c * d)
    t, k = (g.ravel() for g in np.meshgrid(np.arange(start, start + bins), np.arange(windows), indexing="ij"))
    later = t > (start if first else start - 1)
    tie(at(t[later] - 1, k[later]), at(t[later], k[later]), np.full(later.sum(), in_time))
    deep = k > 0
    tie(at(t[deep], k[deep] - 1), at(t[deep], k[deep]), np.full(deep.sum(), in_depth))
    np.add.at(a, (at(t, k), at(t, k)), ridge)
    return a, b


def _eliminate(a: np.ndarray, b: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The system of what is left when the inner unknowns are solved for."""
    outer = ~inner
    solved = np.linalg.solve(a[np.ix_(inner, inner)], np.column_stack([a[np.ix_(inner, outer)], b[inner]])) if inner.any() else np.zeros((0, outer.sum() + 1))
    return a[np.ix_(outer, outer)] - a[np.ix_(outer, inner)] @ solved[:, :-1], b[outer] - a[np.ix_(outer, inner)] @ solved[:, -1]


def _chain(parts: list[tuple[np.ndarray, np.ndarray]], m: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """One system of consecutive segments; neighbours share m unknowns, the first segment of all has no left end."""
    lead = 0 if first else m
    n = lead + len(parts) * m
    a, b = np.zeros((n, n)), np.zeros(n)
    for k, (x, y) in enumerate(parts):
        at = slice(max(lead + (k - 1) * m, 0), lead + (k + 1) * m)
        a[at, at] += x
        b[at] += y
    return a, b


def solve(pairs: DataFrame, chunks: int, chunk: int, windows: int, band: int, in_time: float = 1.0, in_depth: float = 1.0, ridge: float = 1e-3, arity: int = 8) -> DataFrame:
    """(t_bin, z_bin, disp) for all `chunks * chunk` time bins and all windows."""
    spark, m = pairs.sparkSession, band * windows

    def system(key_chunk, pdf):
        return _system(pdf, key_chunk * chunk, chunk, windows, band, in_time, in_depth, ridge, key_chunk == 0)

    def inner_of(first: bool) -> np.ndarray:
        inner = np.zeros(((0 if first else band) + chunk) * windows, bool)
        inner[(0 if first else m) : len(inner) - m] = True
        return inner

    # a chunk without pairs has its smoothness still
    every = spark.range(chunks).select(F.col("id").alias("chunk"))
    full = pairs.unionByName(every.select("chunk", *(F.lit(None).cast(t).alias(c) for c, t in (("i", "long"), ("j", "long"), ("win", "int"), ("d", "double"), ("c", "double")))))

    def ground(key, pdf):
        a, b = _eliminate(*system(key[0], pdf[pdf["i"].notna()]), inner_of(key[0] == 0))
        return pd.DataFrame({"seg": [key[0]], "level": [0], "up": [key[0] // arity], "a": [a.ravel()], "b": [b]})

    levels, n = [stage(full.groupBy("chunk").applyInPandas(ground, PART), "chunks")[0]], chunks

    def joined(pdf):
        pdf = pdf.sort_values("seg")
        parts = [(np.asarray(a).reshape(len(b), len(b)), np.asarray(b)) for a, b in zip(pdf["a"], pdf["b"])]
        first = int(pdf["seg"].iloc[0]) == 0
        a, b = _chain(parts, m, first)
        inner = np.zeros(len(b), bool)
        inner[(0 if first else m) : len(b) - m] = True
        return pdf, first, a, b, inner

    while n > 1:

        def join(key, pdf):
            pdf, first, a, b, inner = joined(pdf)
            a, b = _eliminate(a, b, inner)
            return pd.DataFrame({"seg": [key[0]], "level": [int(pdf["level"].iloc[0]) + 1], "up": [key[0] // arity], "a": [a.ravel()], "b": [b]})

        levels.append(stage(levels[-1].groupBy("up").applyInPandas(join, PART), "joined")[0])
        n = -(-n // arity)
    # the one segment left has no left end: its right end follows
    top = levels[-1].toPandas()
    size = len(top["b"][0])
    ends = np.linalg.solve(np.asarray(top["a"][0]).reshape(size, size), np.asarray(top["b"][0]))
    given = spark.createDataFrame([(0, [], ends.tolist())], "seg long, lo array<double>, hi array<double>")
    for level in reversed(levels[:-1]):

        def split(key, left, right):
            pdf, first, a, b, inner = joined(left)
            x = np.zeros(len(b))
            x[~inner] = np.concatenate([np.asarray(right["lo"].iloc[0], float), np.asarray(right["hi"].iloc[0], float)])
            if inner.any():
                x[inner] = np.linalg.solve(a[np.ix_(inner, inner)], b[inner] - a[np.ix_(inner, ~inner)] @ x[~inner])
            x = np.concatenate([np.zeros(m), x]) if first else x
            rows = [(int(s), [] if first and k == 0 else x[k * m : (k + 1) * m].tolist(), x[(k + 1) * m : (k + 2) * m].tolist()) for k, s in enumerate(pdf["seg"])]
            return pd.DataFrame(rows, columns=["seg", "lo", "hi"])

        given, _ = stage(level.groupBy("up").cogroup(given.withColumnRenamed("seg", "up").groupBy("up")).applyInPandas(split, "seg long, lo array<double>, hi array<double>"), "ends")

    def fill(key, left, right):
        c = key[0]
        a, b = system(c, left[left["i"].notna()])
        inner = inner_of(c == 0)
        x = np.zeros(len(b))
        x[~inner] = np.concatenate([np.asarray(right["lo"].iloc[0], float), np.asarray(right["hi"].iloc[0], float)])
        if inner.any():
            x[inner] = np.linalg.solve(a[np.ix_(inner, inner)], b[inner] - a[np.ix_(inner, ~inner)] @ x[~inner])
        own = x[len(x) - chunk * windows :].reshape(chunk, windows)
        t, k = np.meshgrid(np.arange(c * chunk, (c + 1) * chunk), np.arange(windows), indexing="ij")
        return pd.DataFrame({"t_bin": t.ravel(), "z_bin": k.ravel(), "disp": own.ravel()})

    return full.groupBy("chunk").cogroup(given.withColumnRenamed("seg", "chunk").groupBy("chunk")).applyInPandas(fill, "t_bin long, z_bin long, disp double")


def estimate(
    spikes: DataFrame, t: str, z: str, t_bin: float, z_bin: float, step: float, weight: str | None = None, scale: float | None = None, band: int = 20, most: float = 50.0, least: float = 0.1, in_time: float = 1.0, in_depth: float = 1.0,
    chunk: int = 256, blur: float = 1.0, fastest: float | None = None, arity: int = 8,
) -> DataFrame:
    """(t_bin, z_bin, disp): a field for motion.field_at and correct_field, for times and depths from 0 up (others are left out): time bins of t_bin, windows of depth of `step`; the mean over the field is 0.

    `most` is the largest displacement between two bins that are compared, `band` how many bins apart those may be. With `fastest`, values of bins that moved by more than that from the bin before are null.
    An empty table gives no rows; time bins and windows without spikes follow their neighbours.
    """
    from .motion import speed_limit

    hist, _ = stage(raster(spikes, t, z, weight, t_bin, z_bin).where("tb >= 0 and zb >= 0"), "raster")
    last, deep = hist.agg(F.max("tb"), F.max("zb")).first()
    if last is None:
        return spikes.sparkSession.createDataFrame([], "t_bin long, z_bin long, disp double")
    chunk = max(chunk, band + 1)
    windows, chunks = max(int(np.ceil((deep + 1) * z_bin / step)), 1), last // chunk + 1
    pairs, _ = stage(displacements(hist, z_bin, windows, step, scale or step / 2, band, most, chunk, deep + 1, least, blur).where(F.col("chunk") < chunks), "pairs")
    field, _ = stage(solve(pairs, chunks, chunk, windows, band, in_time, in_depth, arity=arity).where(F.col("t_bin") <= last), "field")
    mean = field.agg(F.avg("disp")).first()[0]
    field = field.withColumn("disp", F.col("disp") - mean)
    return speed_limit(field, fastest) if fastest else field


def for_motion(snippets: DataFrame, channels: DataFrame, key: str, t: str, v: str = "v", least: float = 0.0) -> DataFrame:
    """(key, t, x, z, ptp): where detected spikes lie, for estimate(). snippets: a row for each spike and channel with samples v; each channel's peak-to-peak value weighs its place. Spikes whose greatest is below `least`, or whose place lies
    beyond the channels', are left out."""
    ptp = snippets.withColumn("_p", (F.array_max(v) - F.array_min(v)).cast("double")).where("_p is not null")
    at = ptp.join(channels.select("channel", F.col("x").alias("_x"), F.col("z").alias("_z")), "channel")
    mass = F.sum("_p")
    found = at.groupBy(key, t).agg((F.sum(F.col("_p") * F.col("_x")) / mass).alias("x"), (F.sum(F.col("_p") * F.col("_z")) / mass).alias("z"), F.max("_p").alias("ptp"))
    ends = channels.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    return found.where(F.col("ptp") >= least).join(ends, F.col("z").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
