"""From labelled snippets to a library of templates: small units dropped, units realigned, noisy ones dropped, alike ones merged, the rest in order of depth; lags between templates by least squares; bases from templates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import features, labels, merging, templates


def realigned(spikes: DataFrame, width: int, centre: int, least_count: int, least_snr: float, snippets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Spikes (spike_id, t, label, v) of the units that are seen often and clearly enough, times moved so that each unit's peak lies at centre; snippets takes them anew at the new times, if given."""
    s = spikes.where("label >= 0")
    means = templates.mean(s)
    clear = templates.snr_by_channel(means, width).groupBy("label").agg(F.max("snr").alias("snr")).where(F.col("snr") >= least_snr)
    often = means.groupBy("label").agg(F.max("n").alias("n")).where(F.col("n") >= least_count)
    moves = templates.weighted_alignment(means, width, centre).select("label", "shift")
    kept = clear.join(often, "label").select("label").join(moves, "label", "left")
    out = s.join(kept, "label").withColumn("t", F.col("t") + F.coalesce("shift", F.lit(0))).drop("shift")
    return snippets(out) if snippets else out


def library(spikes: DataFrame, width: int, centre: int, least_count: int, least_snr: float, most: float, lags: int, depth: str = "z", snippets: Callable[[DataFrame], DataFrame] | None = None, method: str = "complete") -> DataFrame:
    """Spikes with `unit`: realigned, then merged where what one template leaves of another is at most `most` of it at some lag, then numbered by median depth. Spikes of dropped units aren't in it."""
    s = realigned(labels.decrumb(spikes, least_count).drop("label").withColumnRenamed("kept", "label"), width, centre, least_count, least_snr, snippets)
    arrays = templates.to_arrays(templates.mean(s))
    v = next(c for c in arrays.columns if c != "label")
    pairs = merging.residual_distances(arrays.withColumnRenamed(v, "v"), lags)
    return labels.reorder_by_depth(merging.merge_units(s, pairs, most, method), depth, "merged", "unit").drop("merged")


def pair_lags(spark: SparkSession, shapes: np.ndarray, most: int, least_cosine: float = 0.75, least_corr: float = 0.75) -> DataFrame:
    """(i, j, lag, corr), i < j: the lag of j against i at which templates (units, length, channels) agree best, as a share of the product of their norms; of equal ones the smallest, then the earlier.

    Only pairs whose amplitudes over channels have a cosine of least_cosine and that reach least_corr. Pairs are dealt over tasks.
    """
    ship(spark)
    k, n, _ = shapes.shape
    amp = np.ptp(shapes, axis=1) if n else np.zeros((k, 0))
    unit = amp / np.maximum(np.linalg.norm(amp, axis=1, keepdims=True), 1e-300)
    norm = np.maximum(np.sqrt((shapes**2).sum((1, 2))), 1e-300)
    order = sorted(range(-min(most, n - 1), min(most, n - 1) + 1), key=lambda s: (abs(s), s))

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["id"]:
                i, j = int(p) // k, int(p) % k
                if i < j and unit[i] @ unit[j] >= least_cosine:
                    dots = [float((shapes[i, max(0, -s) : n - max(0, s)] * shapes[j, max(0, s) : n + min(0, s)]).sum()) for s in order]
                    at = int(np.argmax(dots))
                    if dots[at] / (norm[i] * norm[j]) >= least_corr:
                        out.append((i, j, order[at], dots[at] / (norm[i] * norm[j])))
            yield pd.DataFrame(out, columns=["i", "j", "lag", "corr"])

    return spark.range(k * k).mapInPandas(run, "i int, j int, lag int, corr double")


def solved_shifts(pairs: list[tuple[int, int, float, float]], units: int, own: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Whole shifts of units whose differences (j's less i's) are nearest the lags, weighted by correlation. In each group that pairs connect, the mean shift under the units' weights is that of `own` (0 without), so a single unit keeps its own."""
    own = np.zeros(units) if own is None else np.asarray(own, float)
    weight = np.ones(units) if weight is None else np.asarray(weight, float)
    lap, rhs, group = np.zeros((units, units)), np.zeros(units), np.arange(units)
    for i, j, lag, w in pairs:
        lap[i, i] += w
        lap[j, j] += w
        lap[i, j] -= w
        lap[j, i] -= w
        rhs[j] += w * lag
        rhs[i] -= w * lag
        group[group == group[j]] = group[i]
    shift, out = np.linalg.pinv(lap) @ rhs, np.zeros(units, int)
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        shift[at] += np.average(own[at] - shift[at], weights=np.maximum(weight[at], 1e-300))
        # rounded about the heaviest unit, so that whole lags stay whole whatever the mean is
        first = shift[at[weight[at].argmax()]]
        out[at] = np.rint(shift[at] - first) + np.rint(first)
    return out


def basis_of(rows: DataFrame, rank: int, v: str = "v", centred: bool = False) -> np.ndarray:
    """(rank, length): leading components of arrays, from the sums of their products, one row a task; uncentred, or about their mean. The entry of largest size of each is positive."""
    n, mean, cov = features.moments(rows, v)
    if not n:
        return np.zeros((0, 0))
    value, vector = np.linalg.eigh(cov if centred else cov + np.outer(mean, mean))
    out = vector[:, np.argsort(-value, kind="stable")[:rank]].T
    return out * np.sign(out[np.arange(len(out)), np.abs(out).argmax(1)])[:, None]


def basis_of_templates(shapes: np.ndarray, rank: int, least_amplitude: float = 1.0, least_share: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """(mean, basis) of the channels' waveforms whose peak to peak reaches least_amplitude, of templates (units, length, channels); components that explain less than least_share of the spread are left out."""
    rows = shapes.transpose(0, 2, 1).reshape(-1, shapes.shape[1])
    rows = rows[np.ptp(rows, axis=1) >= least_amplitude] if len(rows) else rows
    if not len(rows):
        return np.zeros(shapes.shape[1]), np.zeros((0, shapes.shape[1]))
    mean = rows.mean(0)
    _, s, v = np.linalg.svd(rows - mean, full_matrices=False)
    share = s**2 / max((s**2).sum(), 1e-300)
    out = v[:rank][share[:rank] >= least_share]
    return mean, out * np.sign(out[np.arange(len(out)), np.abs(out).argmax(1)])[:, None]
