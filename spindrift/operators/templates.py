"""Templates: averages of snippets by unit and what is read off them. Snippets come as (id, label, v array)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import peak_to_peak


def exploded(rows: DataFrame, v: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(v).alias("sample", "x")).withColumn("x", F.col("x").cast("double"))


def mean(rows: DataFrame, v: str = "v", label: str = "label", weight: str | None = None) -> DataFrame:
    """(label, sample, mean, n): weighted if asked for."""
    keep = [label] + ([weight] if weight else [])
    w = F.col(weight) if weight else F.lit(1.0)
    long = exploded(rows, v, *keep)
    return long.groupBy(label, "sample").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("mean"), F.count(F.lit(1)).alias("n"))


def median(rows: DataFrame, v: str = "v", label: str = "label") -> DataFrame:
    """(label, sample, median): the lower of the two middle values."""
    return exploded(rows, v, label).groupBy(label, "sample").agg(F.expr("percentile_disc(0.5) within group (order by x)").alias("median"))


def spread(rows: DataFrame, v: str = "v", label: str = "label") -> DataFrame:
    """(label, sample, mean, std): population standard deviation."""
    return exploded(rows, v, label).groupBy(label, "sample").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def coarsen(templates: DataFrame, unit: str, weight: str = "n", value: str = "mean") -> DataFrame:
    """Count-weighted mean of the templates (sample, value, weight) that share a unit."""
    return templates.groupBy(unit, "sample").agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight))


def to_arrays(templates: DataFrame, label: str = "label", value: str = "mean") -> DataFrame:
    """(label, v): the samples in order. A unit's template is of fixed length, so the list is bounded."""
    return templates.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", value))), lambda s: s[value]).alias("v"))


def amplitudes(templates: DataFrame, label: str = "label", value: str = "mean") -> DataFrame:
    return templates.groupBy(label).agg((F.max(value) - F.min(value)).alias("ptp"))


def snr_by_channel(templates: DataFrame, width: int, label: str = "label", value: str = "mean") -> DataFrame:
    """Peak to peak over each channel's run of `width` samples, times the square root of the count."""
    by = templates.withColumn("channel", F.floor(F.col("sample") / width)).groupBy(label, "channel")
    return by.agg(((F.max(value) - F.min(value)) * F.sqrt(F.max("n").cast("double"))).alias("snr"))


def main_channel(by_channel: DataFrame, value: str, label: str = "label") -> DataFrame:
    """The channel of the greatest value, of equals the first."""
    best = by_channel.groupBy(label).agg(F.max(F.struct(F.col(value).alias("x"), (-F.col("channel")).alias("c"))).alias("m"))
    return best.select(label, (-F.col("m.c")).alias("channel"), F.col("m.x").alias(value))


def alignment(templates: DataFrame, centre: int, trough_factor: float = 3.0, label: str = "label", value: str = "mean") -> DataFrame:
    """Offset from centre of the sample with the greatest |value|, negative values weighing trough_factor; of equals the last."""
    w = F.when(F.col(value) < 0, F.abs(F.col(value)) * trough_factor).otherwise(F.abs(F.col(value)))
    best = templates.groupBy(label).agg(F.max(F.struct(w.alias("w"), "sample")).alias("m"))
    return best.select(label, (F.col("m.sample") - centre).alias("shift"))


def amplitude_features(rows: DataFrame, v: str = "v") -> DataFrame:
    """ptp, peak and log peak-to-trough of each snippet; null where a side is missing."""
    top, low = F.array_max(v).cast("double"), F.array_min(v).cast("double")
    return rows.withColumn("ptp", peak_to_peak(F.col(v))).withColumn("peak", F.greatest(top, -low)).withColumn(
        "log_peak_to_trough", F.when((top > 0) & (low < 0), F.ln(top) - F.ln(-low))
    )


def center_of_mass(rows: DataFrame, v: str = "v", positions: list[float] | None = None) -> DataFrame:
    """Mean position of the entries weighted by |v|; positions default to 0, 1, 2, ..."""
    weights = F.transform(v, lambda x: F.abs(x.cast("double")))
    place = F.sequence(F.lit(0), F.size(v) - 1) if positions is None else F.array(*map(F.lit, positions))
    top = F.aggregate(F.zip_with(weights, place, lambda w, p: w * p.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("com", F.try_divide(top, F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)))


def weighted_alignment(templates: DataFrame, width: int, centre: int, weight: str = "ptp", least: float = 0.75, label: str = "label", value: str = "mean") -> DataFrame:
    """(label, shift): the channels' offsets of their greatest |value| from centre, averaged and rounded half to even.

    A channel weighs its peak to peak (ptp), that squared (ptpsq) or its sum of squares (normsq), over the unit's greatest; below least it weighs nothing. Of equal samples the first counts.
    """
    if weight not in ("ptp", "ptpsq", "normsq"):
        raise ValueError(f"no such weight: {weight}")
    x = templates.withColumn("channel", F.floor(F.col("sample") / width)).withColumn("_k", F.pmod(F.col("sample"), F.lit(width)))
    span = F.max(value) - F.min(value)
    w = {"ptp": span, "ptpsq": span * span, "normsq": F.sum(F.col(value) * F.col(value))}[weight]
    by = x.groupBy(label, "channel").agg(w.alias("_w"), F.max(F.struct(F.abs(F.col(value)), (-F.col("_k")).alias("k")))["k"].alias("_at"))
    rel = by.join(by.groupBy(label).agg(F.max("_w").alias("_top")), label).withColumn("_r", F.try_divide("_w", "_top")).where(F.col("_r") >= least)
    return rel.groupBy(label).agg(F.bround(F.sum(F.col("_r") * (-F.col("_at") - centre)) / F.sum("_r"), 0).cast("long").alias("shift"))


def realign(arrays: DataFrame, shifts: DataFrame, before: int, length: int, label: str = "label", v: str = "v") -> DataFrame:
    """Padded templates cut to `length` samples from before + shift; a shift beyond the padding is held at its edge, a unit without one stays."""
    start = F.greatest(F.least(F.coalesce("shift", F.lit(0)) + before, F.size(v) - length), F.lit(0))
    return arrays.join(shifts.select(label, "shift"), label, "left").withColumn(v, F.slice(v, (start + 1).cast("int"), length)).drop("shift")


def upsample_count(ptp: Column, most: int = 8) -> Column:
    """Phases a template of this height needs: 4 to the power of half its height, rounded down, in [1, most]."""
    return F.greatest(F.least(F.pow(F.lit(4.0), F.floor(F.least(ptp / 2, F.lit(31)))), F.lit(float(most))), F.lit(1.0)).cast("int")


def upsample(v: np.ndarray, phases: int) -> np.ndarray:
    """(phases, length): the natural cubic spline through a template's samples, at each sample plus i / phases; beyond the last sample its value."""
    n = len(v)
    if n < 3:
        return np.stack([np.interp(np.arange(n) + i / phases, np.arange(n), v) for i in range(phases)])
    system = np.diag(np.full(n - 2, 4.0)) + np.diag(np.ones(n - 3), 1) + np.diag(np.ones(n - 3), -1)
    bend = np.zeros(n)
    bend[1:-1] = np.linalg.solve(system, 6 * np.diff(v, 2))
    at = np.minimum(np.arange(n)[None] + np.arange(phases)[:, None] / phases, n - 1)
    k = np.minimum(at.astype(int), n - 2)
    b = at - k
    a = 1 - b
    return a * v[k] + b * v[k + 1] + ((a**3 - a) * bend[k] + (b**3 - b) * bend[k + 1]) / 6


def low_rank(template: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(temporal, singular, spatial) of a template (times, channels), each temporal component with its largest entry positive."""
    u, s, w = np.linalg.svd(template, full_matrices=False)
    u, s, w = u[:, :rank], s[:rank], w[:rank]
    sign = np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return u * sign, s, w * sign[:, None]


def spatial_mask(templates: DataFrame, mains: DataFrame, neighbours: DataFrame, label: str = "label", v: str = "v") -> DataFrame:
    """Templates (label, channel, v) with zeros on channels that are not among the neighbours of the unit's main channel."""
    near = mains.select(label, F.col("channel").alias("_m")).join(neighbours.select(F.col("channel").alias("_m"), F.col("neighbor").alias("channel")).distinct(), "_m").select(label, "channel", F.lit(True).alias("_in"))
    return templates.join(near, [label, "channel"], "left").withColumn(v, F.transform(v, lambda x: F.when(F.col("_in"), x).otherwise(x * 0))).drop("_in")
