"""Sampling of rows, chunks and snippets. Draws follow from keys, so reruns and lost executors give the same ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def uniform(key: str, seed: int = 0) -> Column:
    """A number in (0, 1) drawn by a row's key: 52 bits of the MD5 of key and seed."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def weighted_sample(rows: DataFrame, n: int, key: str, weight: str | None = None, seed: int = 0) -> DataFrame:
    """n rows without replacement, the chance in proportion to weight: those with the smallest -ln(u) / weight. Rows of no positive weight are never drawn.

    Each task keeps its own best n before they meet.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    drawn = rows.where(w > 0).withColumn("_e", -F.ln(uniform(key, seed)) / w)
    return drawn.orderBy("_e", key).limit(n).drop("_e")


def density_weights(rows: DataFrame, value: str, width: float, most: float = 4.0, to: str = "weight") -> DataFrame:
    """Weights inverse to the density of a value, in [1 / most, most], so that rare values are drawn more often; 0 where the value is null.

    The density is a histogram of the given width, smoothed with weights 1, 2, 1; weights are in proportion to its mean over all rows.
    """
    binned = rows.withColumn("_b", F.floor(F.col(value) / width))
    counts = binned.where(F.col("_b").isNotNull()).groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.select(F.explode(F.array(*(F.struct((F.col("_b") + k).alias("_b"), (F.col("_n") * (2 - abs(k)) / 4.0).alias("_s")) for k in (-1, 0, 1)))).alias("p"))
    smooth = shares.groupBy("p._b").agg(F.sum("p._s").alias("_s")).join(counts, "_b")
    mean = smooth.agg((F.sum(F.col("_n") * F.col("_s")) / F.sum("_n")).alias("_m"))
    table = smooth.join(F.broadcast(mean)).select("_b", F.greatest(F.least(F.col("_m") / F.col("_s"), F.lit(float(most))), F.lit(1.0 / most)).alias(to))
    return binned.join(table, "_b", "left").withColumn(to, F.coalesce(to, F.lit(0.0))).drop("_b")


def finite(rows: DataFrame, v: str) -> DataFrame:
    """Rows whose array has neither null nor NaN nor infinity."""
    return rows.where(F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def spread_chunks(n: int, k: int, seed: int = 0) -> list[int]:
    """k of n chunk numbers far from each other, ascending: each next one is drawn in proportion to the squared distance to the nearest already drawn."""
    rng = np.random.default_rng(seed)
    at = np.arange(n)
    if k >= n:
        return at.tolist()
    chosen = [int(rng.integers(n))]
    d2 = (at - chosen[0]).astype(float) ** 2
    while len(chosen) < k:
        chosen.append(int(rng.choice(n, p=d2 / d2.sum())))
        d2 = np.minimum(d2, (at - chosen[-1]) ** 2)
    return sorted(chosen)


def divide_evenly(n: int, bins: int, seed: int = 0) -> np.ndarray:
    """How many of n things each bin takes: n // bins, and one more for n % bins bins drawn at random."""
    out = np.full(bins, n // bins)
    out[np.random.default_rng(seed).permutation(bins)[: n % bins]] += 1
    return out


def random_snippets(traces: DataFrame, n: int, length: int, seed: int = 0) -> DataFrame:
    """(chunk_id, channel, t, v): n snippets of each chunk that never overlap, or as many as fit, at the same times in all channels."""
    ship(traces.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for chunk, channel, t0, v in pdf.itertuples(index=False):
                many = min(n, len(v) // length)
                # many starts in what is left when the snippets are taken out, then each pushed on by those before it
                free = np.sort(np.random.default_rng([seed, int(chunk)]).integers(0, len(v) - many * length + 1, many))
                out += [(chunk, channel, t0 + a, v[a : a + length]) for a in (free + np.arange(many) * length).tolist()]
            yield pd.DataFrame(out, columns=["chunk_id", "channel", "t", "v"])

    return traces.select("chunk_id", "channel", "t0", "v").mapInPandas(run, "chunk_id long, channel int, t long, v array<float>")
