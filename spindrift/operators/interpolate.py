"""Features carried between sets of channels: by spatial kernels under a shift, or as the mean of what is missing given what is seen; and the sets of registered channels that spikes are seen on.

Rows have v (rank components for each channel of their set, channel by channel), hood (int, their set) and, where the probe moves, shift (double). There are few distinct pairs of set and shift; a task
makes each pair's matrix once. Rows without v, of another length or of an unknown set get null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import channels as channel_ops
from .embedded import beyond
from .motion import interpolation


def _mapped(rows: DataFrame, sizes: list[int], make: Callable[[int, float], np.ndarray], rank: int, shift: str | None, to: str) -> DataFrame:
    """Applies make(hood, shift), a matrix (targets, channels), to each component; targets whose row has a NaN become null."""
    ship(rows.sparkSession)

    def part(batches):
        made: dict[tuple[int, float], np.ndarray] = {}
        for pdf in batches:
            out = [None] * len(pdf)
            moves = pdf[shift].to_numpy(float) if shift else np.zeros(len(pdf))
            groups: dict[tuple[int, float], list[int]] = {}
            for i, (v, h, s) in enumerate(zip(pdf["v"], pdf["hood"], moves)):
                if v is not None and h == h and s == s and 0 <= h < len(sizes) and len(v) == sizes[int(h)] * rank:
                    groups.setdefault((int(h), float(s)), []).append(i)
            for key, at in groups.items():
                if key not in made:
                    # matrices are small; a stream of ever new shifts doesn't pile them up
                    if len(made) >= 4096:
                        made.clear()
                    made[key] = make(*key)
                x = np.stack([np.asarray(pdf["v"].iloc[i], float) for i in at]).reshape(len(at), sizes[key[0]], rank)
                y = np.einsum("tc,ncr->ntr", made[key], x).reshape(len(at), -1)
                for i, row in zip(at, y):
                    out[i] = [None if e != e else float(e) for e in row]
            yield pdf.assign(**{to: pd.Series(out, pdf.index, dtype=object)})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != to)
    return rows.drop(to).mapInPandas(part, f"{types}, `{to}` array<double>")


def interpolated(rows: DataFrame, places: np.ndarray, seen: list[np.ndarray], target_places: np.ndarray, targets: list[np.ndarray], rank: int, kind: str = "thinplate", sigma: float = 20.0, degree: int = 1, ridge: float = 0.0, shift: str | None = None, outside: bool = True, to: str = "at") -> DataFrame:
    """Each set's features at its targets, whose places are target_places[targets[hood]]; a row's own channels lie at places[seen[hood]], moved in depth by its shift. Unless outside is allowed, targets beyond the depths of their column's channels are null."""

    def make(hood: int, move: float) -> np.ndarray:
        source, target = places[seen[hood]] + np.array([0.0, move]), target_places[targets[hood]]
        m = interpolation(source, target, kind, sigma, degree, ridge)
        if not outside:
            m = np.where(beyond(source, target)[:, None], np.nan, m)
        return m

    return _mapped(rows, [len(s) for s in seen], make, rank, shift, to)


def to_full(rows: DataFrame, places: np.ndarray, seen: list[np.ndarray], registered: np.ndarray, rank: int, **how) -> DataFrame:
    """From the probe as it lies at a row's shift to all registered places."""
    return interpolated(rows, places, seen, registered, [np.arange(len(registered))] * len(seen), rank, **how)


def from_full(rows: DataFrame, registered: np.ndarray, places: np.ndarray, rank: int, shift: str = "shift", **how) -> DataFrame:
    """From all registered places (hood 0) to the probe's, which lie that shift further."""
    back = rows.withColumn("_back", -F.col(shift))
    return interpolated(back, registered, [np.arange(len(registered))], places, [np.arange(len(places))], rank, shift="_back", **how).drop("_back")


def imputed(rows: DataFrame, mean: np.ndarray, noise: np.ndarray, seen: list[np.ndarray], targets: list[np.ndarray], rank: int, to: str = "at") -> DataFrame:
    """The mean of a normal with mean (channels, rank) and covariance over entries (channel by channel) at each set's targets, given the entries seen."""
    flat = lambda c: (np.asarray(c)[:, None] * rank + np.arange(rank)).ravel()
    centre = mean.ravel()
    sizes = [len(s) * rank for s in seen]

    def make(hood: int, _: float) -> np.ndarray:
        o, t = flat(seen[hood]), flat(targets[hood])
        gain = np.linalg.solve(noise[np.ix_(o, o)], noise[np.ix_(o, t)]).T
        # a last column holds what the means leave
        return np.concatenate([gain, (centre[t] - gain @ centre[o])[:, None]], 1)

    one = rows.withColumn("_v", F.col("v")).withColumn("v", F.concat(F.col("v").cast("array<double>"), F.array(F.lit(1.0))))
    return _mapped(one, [n + 1 for n in sizes], make, 1, None, to).withColumn("v", F.col("_v")).drop("_v")


def stable_sets(spikes: DataFrame, index: DataFrame, channels: DataFrame, registered: DataFrame, pitch: float) -> tuple[DataFrame, DataFrame]:
    """(hood, channels) of the distinct sets of registered channels that spikes (channel, shift in whole pitches) are seen on, in their order, and the spikes with their hood.

    Sets follow from the few pairs of main channel and shift; neighbours that land on no site are left out. index is (channel, slot, neighbor).
    """
    pairs = spikes.select("channel", "shift").distinct()
    rows = pairs.join(F.broadcast(index.where("neighbor is not null").select("channel", "neighbor")), "channel")
    landed = channel_ops.shifted_channels(rows.withColumnRenamed("channel", "main").withColumnRenamed("neighbor", "channel"), channels, registered, pitch).where("reg_channel is not null")
    sets = landed.groupBy(F.col("main").alias("channel"), "shift").agg(F.sort_array(F.collect_set("reg_channel")).alias("channels"))
    known = sets.select("channels").distinct().withColumn("hood", (F.row_number().over(Window.orderBy("channels")) - 1).cast("int"))
    named = sets.join(known, "channels").select("channel", "shift", "hood")
    return known.select("hood", "channels"), spikes.join(named, ["channel", "shift"], "left")


def hoods_at(known: DataFrame, index: DataFrame, channels: DataFrame, registered: DataFrame, pitch: float, shift: int) -> DataFrame:
    """(channel, hood) at one shift: which fitted set each main channel's neighbours land on; null if it is none of them."""
    mains = channels.select("channel").withColumn("shift", F.lit(shift))
    sets, rows = stable_sets(mains, index, channels, registered, pitch)
    found = sets.withColumnRenamed("hood", "_new").join(known, "channels", "left").select(F.col("_new").alias("_hood"), "hood")
    return rows.withColumnRenamed("hood", "_hood").join(found, "_hood", "left").select("channel", "hood")


def missing_near(known: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """(hood, channel, seen): each set's channels, and those it doesn't see within radius of one that it does. known is (hood, channels), places (channel, x, z)."""
    own = known.select("hood", F.explode("channels").alias("channel"))
    a, b = places.select("channel", F.col("x").alias("xa"), F.col("z").alias("za")), places.select(F.col("channel").alias("near"), F.col("x").alias("xb"), F.col("z").alias("zb"))
    # depths meet by bands of one radius
    bands = a.withColumn("band", F.explode(F.array(*(F.floor(F.col("za") / radius) + k for k in (-1, 0, 1))))).join(b.withColumn("band", F.floor(F.col("zb") / radius)), "band")
    near = bands.where((F.col("xa") - F.col("xb")) ** 2 + (F.col("za") - F.col("zb")) ** 2 <= radius**2).select("channel", "near")
    around = own.join(near, "channel").select("hood", F.col("near").alias("channel")).unionByName(own).distinct()
    return around.join(own.withColumn("seen", F.lit(True)), ["hood", "channel"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
