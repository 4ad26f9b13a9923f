"""Detection on ordered samples: local extrema, suppression in time and over channels, convexity, chunks with margins, peeling."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import convexity as convexity_of


#: Radii in a chunk of time that is searched by itself.
CHUNK = 256


def local_maxima(samples: DataFrame, radius: int, threshold: float, by: list[str], order: list[str], value: str = "v") -> DataFrame:
    """Samples above threshold (strictly) that no sample within radius rows exceeds; of equal ones the first; the first and last sample never."""
    w = Window.partitionBy(*by).orderBy(*order)
    ahead, behind = w.rowsBetween(1, radius), w.rowsBetween(-radius, -1)
    best_before, best_after = F.max(value).over(behind), F.max(value).over(ahead)
    marked = samples.withColumn("_b", best_before).withColumn("_a", best_after)
    return marked.where((F.col(value) > threshold) & (F.col(value) > F.col("_b")) & (F.col(value) >= F.col("_a"))).drop("_a", "_b")


def suppress(peaks: DataFrame, radius: int, t: str = "t", value: str = "v", by: list[str] = [], key: str = "spike_id") -> DataFrame:  # noqa: B006
    """Peaks that no peak within radius of time exceeds; of equal ones the earlier, then the smaller key. One window by range, no self-join; chunks with margins are
    searched apart, so the table, or one of its groups, is never in one task."""
    peaks = with_halo(peaks, CHUNK * max(1, int(radius)), radius, t)
    w = Window.partitionBy(*by, "chunk").orderBy(t).rangeBetween(-radius, radius)
    best = F.max(F.struct(F.col(value), (-F.col(t)).alias("t"), (-F.col(key)).alias("k"))).over(w)
    return peaks.withColumn("_best", best).where((F.col("_best")[value] == F.col(value)) & (F.col("_best.t") == -F.col(t)) & (F.col("_best.k") == -F.col(key)) & F.col("core")).drop("_best", "chunk", "core")


def detect_and_deduplicate(peaks: DataFrame, neighbours: DataFrame, radius: int, t: str = "t", channel: str = "channel", value: str = "v") -> DataFrame:
    """Suppression over time and neighbouring channels: a peak stays unless a neighbour's peak within radius is higher, or equal and of an earlier
    channel, or of the same channel and earlier. neighbours (channel, neighbor) is a small bridge table; each peak visits its neighbours' channels.

    Time is cut into blocks of two radii, so the times within radius of a peak are the end of one block and the beginning of the next: running maxima of each block from both ends, read off at
    t - radius and t + radius, decide. Work is a row a visit, however many peaks lie within radius.
    """
    own = F.struct(F.col(value).alias("v"), (-F.col(channel)).alias("c"), (-F.col(t)).alias("t"))
    at = lambda role, when: F.struct(F.lit(role).alias("role"), when.alias("at"))
    stand = F.array(at(0, F.col(t)))
    spread = peaks.join(F.broadcast(neighbours), channel)
    spread = spread.withColumn("_r", F.explode(F.when(F.col(channel) == F.col("neighbor"), F.concat(stand, F.array(at(1, F.col(t) + radius), at(2, F.col(t) - radius)))).otherwise(stand)))
    spread = spread.withColumns({"_block": F.floor(F.col("_r.at") / max(2 * radius, 1)), "_at": F.col("_r.at"), "_role": F.col("_r.role"), "_own": F.when(F.col("_r.role") == 0, own)}).drop("_r")
    for to, order in (("_to", F.asc("_at")), ("_from", F.desc("_at"))):
        spread = spread.withColumn(to, F.max("_own").over(Window.partitionBy("neighbor", "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)))
    read = spread.where("_role > 0").withColumn("_best", F.when(F.col("_role") == 1, F.col("_to")).otherwise(F.col("_from")))
    # two readings a peak; peaks alike in all columns are as many as they were
    best = read.groupBy(*peaks.columns).agg(F.max("_best").alias("_best"), (F.count(F.lit(1)) / 2).cast("int").alias("_n"))
    return best.where(F.col("_best") == own).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*peaks.columns)


def convexity(samples: DataFrame, radius: int, by: list[str], order: list[str], value: str = "v") -> DataFrame:
    """Convexity of the snippet of radius rows either side; rows without a full snippet are left out."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-radius, radius)
    return samples.withColumn("_snip", F.collect_list(value).over(w)).where(F.size("_snip") == 2 * radius + 1).withColumn("vexity", convexity_of(F.col("_snip"))).drop("_snip")


def time_chunks(first: int, last: int, length: int) -> list[tuple[int, int, int]]:
    """(chunk, start, end): even cuts of [first, last) into chunks of about length; a remainder above 0.66 of one makes a chunk of its own."""
    whole, rest = divmod(last - first, length)
    n = max(1, int(whole) + (rest / length > 0.66))
    edges = [first + (last - first) * i // n for i in range(n + 1)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def with_halo(samples: DataFrame, length: int, margin: int, t: str = "t") -> DataFrame:
    """Each row once for its chunk (core true) and once more for each other chunk whose margins it lies in. No join: chunks follow from the time."""
    own = F.floor(F.col(t) / length)
    first, last = F.floor((F.col(t) - margin) / length), F.floor((F.col(t) + margin) / length)
    return samples.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("core", F.col("chunk") == own)


def peel(samples: DataFrame, length: int, margin: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, t: str = "t") -> DataFrame:
    """A function over each chunk with its margins; chunks are of bounded length, so a group is a bounded number of rows."""
    return with_halo(samples, length, margin, t).groupBy("chunk").applyInPandas(fn, schema)


def subtract_peaks(threshold: float, dedup: int, kernel: list[float], t: str = "t", v: str = "v") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A peeling function: take the highest sample, subtract the scaled kernel about it, repeat until none exceeds threshold; peaks of the margins are not returned."""
    half = len(kernel) // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([t, "spike_id"]).reset_index(drop=True)
        x, times, core = pdf[v].to_numpy(float).copy(), pdf[t].to_numpy(), pdf["core"].to_numpy()
        barred, out, shape = np.zeros(len(x), bool), [], np.asarray(kernel, float)
        ids, chunk = pdf["spike_id"].to_numpy(), int(pdf["chunk"].iloc[0]) if len(pdf) else 0
        # highest first, of equals the first; what was subtracted from since is no longer as high as its entry says and has a new one
        heap = [(-x[i], i) for i in np.flatnonzero(x > threshold).tolist()]
        heapq.heapify(heap)
        # each step bars a sample at least, so this ends
        while heap:
            height, best = heapq.heappop(heap)
            if barred[best] or x[best] != -height:
                continue
            height = x[best]
            a, b = max(0, best - half), min(len(x), best - half + len(shape))
            x[a:b] -= height * shape[a - best + half : b - best + half]
            barred[max(0, best - dedup) : best + dedup + 1] = True
            for i in range(a, b):
                if not barred[i] and x[i] > threshold:
                    heapq.heappush(heap, (-x[i], i))
            if core[best]:
                out.append((chunk, int(ids[best]), int(times[best]), float(height)))
        return pd.DataFrame(sorted(out, key=lambda r: (r[2], r[1])), columns=["chunk", "spike_id", "t", "height"])

    return run


def peaks_by_chunk(samples: DataFrame, length: int, radius: int, threshold: float, sign: int = -1, t: str = "t", channel: str = "channel", v: str = "v") -> DataFrame:
    """(t, channel, v): local extrema of each channel, of height v; sign -1 takes troughs, 1 peaks, 0 both. Chunks with margins are searched apart, so no channel is ever in one task."""
    height = F.abs(F.col(v)) if sign == 0 else F.col(v) * sign
    cut = with_halo(samples.select(F.col(t).alias("t"), F.col(channel).alias("channel"), height.cast("double").alias("v")), length, radius + 1)
    return local_maxima(cut, radius, threshold, ["chunk", "channel"], ["t"], "v").where("core").select("t", "channel", "v")


def _at_chunks(samples: DataFrame, spikes: DataFrame, fn: Callable, schema: str, length: int, margin: int) -> DataFrame:
    own = spikes.withColumn("chunk", F.floor(F.col("t") / length))
    return own.groupBy("chunk").cogroup(with_halo(samples.select("t", "channel", "v"), length, margin).groupBy("chunk")).applyInPandas(fn, schema)


def _dense(samples: pd.DataFrame, channels: list[int]) -> tuple[int, np.ndarray]:
    """First time and the samples as (times, channels), missing ones 0."""
    first = int(samples["t"].min())
    x = np.zeros((int(samples["t"].max()) - first + 1, len(channels)))
    col = samples["channel"].map(pd.Series(range(len(channels)), index=channels))
    ok = col.notna().to_numpy()
    x[(samples["t"].to_numpy() - first)[ok], col[ok].astype(int)] = samples["v"].to_numpy(float)[ok]
    return first, x


def _window(x: np.ndarray, start: int, length: int) -> np.ndarray:
    """length rows from start, zeros beyond the ends."""
    out = np.zeros((length, x.shape[1]))
    a, b = max(start, 0), min(start + length, len(x))
    if a < b:
        out[a - start : b - start] = x[a:b]
    return out


def grab(samples: DataFrame, spikes: DataFrame, neighbours: dict[int, list[int]], before: int, length: int, chunk: int) -> DataFrame:
    """(spike_id, t, channel, v, near, amp): each spike's snippet on its channel, and the heights on its neighbours. Spikes and samples meet by chunk, each group of bounded length."""
    channels = sorted(neighbours)
    at = {c: k for k, c in enumerate(channels)}

    def run(s: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(s) and len(x):
            first, dense = _dense(x, channels)
            for i, t, c in zip(s["spike_id"], s["t"], s["channel"]):
                w = _window(dense, int(t) - before - first, length)
                near = neighbours[int(c)]
                out.append((i, t, c, w[:, at[int(c)]], near, np.ptp(w[:, [at[n] for n in near]], axis=0)))
        return pd.DataFrame(out, columns=["spike_id", "t", "channel", "v", "near", "amp"])

    return _at_chunks(samples, spikes.select("spike_id", "t", "channel"), run, "spike_id long, t long, channel int, v array<double>, near array<int>, amp array<double>", chunk, length)


def templates_of(samples: DataFrame, spikes: DataFrame, channels: list[int], before: int, length: int, chunk: int) -> DataFrame:
    """(label, channel, v, n): mean snippets of each unit on all channels. A chunk gives one sum for a unit and channel, which are added entry by entry."""

    def run(s: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(s) and len(x):
            first, dense = _dense(x, channels)
            for u, g in s.groupby("label"):
                total = sum(_window(dense, int(t) - before - first, length) for t in g["t"])
                out += [(int(u), c, len(g), total[:, k]) for k, c in enumerate(channels)]
        return pd.DataFrame(out, columns=["label", "channel", "n", "v"])

    parts = _at_chunks(samples, spikes.where("label >= 0").select("t", F.col("label").cast("int").alias("label")), run, "label int, channel int, n long, v array<double>", chunk, length)
    by = parts.select("label", "channel", "n", F.posexplode("v").alias("k", "x")).groupBy("label", "channel", "k").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    return by.groupBy("label", "channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("v"), F.max("n").alias("n"))
