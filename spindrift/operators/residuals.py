"""Snippets of a recording that hold no spikes, carried to registered channels under drift and reduced to a basis: what a noise model in the space of features is estimated from.

Candidates lie on a grid of the recording's time, so no two snippets share a sample. Those that a spike comes near are left out by an anti-join on time buckets; of the others as many as are wanted are drawn by a hash of their place.
Samples are grouped by chunks of bounded length, moments are added up in executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import detect, features, interpolate
from .embedded import EmbeddedNoise


def free_starts(samples: DataFrame, spikes: DataFrame, length: int, before: int, number: int | None = None, guard: int = 0, seed: int = 0) -> DataFrame:
    """(start): starts of snippets of `length` samples, on a grid, that no spike's own snippet (from t - before, of the same length) and `guard` samples around it meet; `number` of them by hash if given (a documented bound), else all.

    Spikes without a time meet nothing; a recording without samples has no starts. Snippets begin and end within the recording.
    """
    a, b = samples.agg(F.min("t"), F.max("t")).first()
    grid = samples.sparkSession.range(0 if a is None else -(-a // length), 0 if a is None else max((b + 1) // length, -(-a // length))).withColumnRenamed("id", "_k")
    # a spike bars the one, two or more grid cells that its snippet with its guards lies in
    first, last = F.col("t") - before - guard, F.col("t") - before + length - 1 + guard
    barred = spikes.where("t is not null").select(F.explode(F.sequence(F.floor(first / length), F.floor(last / length))).alias("_k")).distinct()
    free = grid.join(barred, "_k", "left_anti").select((F.col("_k") * length).alias("start"))
    return free if number is None else free.orderBy(F.xxhash64("start", F.lit(seed)), "start").limit(number)


def snippets(samples: DataFrame, starts: DataFrame, channels: list[int], length: int, chunk: int) -> DataFrame:
    """(start, v): the samples of all channels from each start, channel by channel; missing ones are 0."""
    ship(samples.sparkSession)

    def run(s: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(s) and len(x):
            first, dense = detect._dense(x, channels)
            out = [(int(t), detect._window(dense, int(t) - first, length).T.ravel()) for t in s["t"]]
        return pd.DataFrame(out, columns=["start", "v"])

    return detect._at_chunks(samples, starts.select(F.col("start").alias("t")), run, "start long, v array<double>", chunk, length)


def registered(snips: DataFrame, components: np.ndarray, places: np.ndarray, to: np.ndarray, shift: DataFrame | None = None, t_bin: int | None = None, **how) -> DataFrame:
    """(start, v): snippets reduced to the components (rank, length) of a temporal basis on each channel and interpolated from places (channels, 2), moved in depth by their time bin's shift (t_bin, shift), to the places `to`; rank numbers for each of these.

    The components and the interpolation act on different axes, so the order makes no difference; reducing first moves rank numbers instead of a whole snippet. A time bin without a shift has shift 0. `how` goes to interpolate.to_full.
    """
    rank, length = components.shape

    def reduce(batches):
        for pdf in batches:
            x = [components @ np.asarray(v, float).reshape(-1, length).T for v in pdf["v"]]
            yield pdf.assign(v=[f.T.ravel() for f in x])

    ship(snips.sparkSession)
    rows = snips.select("start", "v").mapInPandas(reduce, "start long, v array<double>").withColumn("hood", F.lit(0))
    if shift is not None:
        moves = shift.select(F.col("t_bin").cast("long").alias("_t"), F.col("shift").cast("double").alias("shift"))
        rows = rows.withColumn("_t", F.floor(F.col("start") / t_bin)).join(moves, "_t", "left").drop("_t").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    got = interpolate.to_full(rows, places, [np.arange(len(places))], to, rank, shift="shift" if shift is not None else None, **how)
    return got.select("start", F.col("at").alias("v"))


def noise_of(rows: DataFrame, rank: int, kind: str = "full", shrinkage: float = 0.0) -> EmbeddedNoise:
    """The noise model of registered features (v, place by place): mean and covariance from sums in executors; rows with a null are left out. kind "full" or "rank" (a variance for each rank)."""
    whole = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    n, mean, cov = features.moments(whole, "v")
    places = len(mean) // rank
    # from place by place to rank by rank
    order = np.arange(len(mean)).reshape(places, rank).T.ravel()
    mean, cov = mean[order].reshape(rank, places), cov[np.ix_(order, order)]
    if kind == "rank":
        return EmbeddedNoise(mean, "rank", (np.diag(cov).reshape(rank, places).mean(1),))
    if kind != "full":
        raise ValueError(f"no kind {kind!r}")
    return EmbeddedNoise(mean, "full", ((1 - shrinkage) * cov + shrinkage * np.eye(len(cov)) * np.trace(cov) / max(len(cov), 1),))
