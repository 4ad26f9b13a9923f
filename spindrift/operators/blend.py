"""Templates of sortings under drift, blended of raw and low-rank ones, and distances that heed how well a channel was seen. Templates come long: (unit, channel, sample, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def denoising_weight(sample: Column, snr: Column, length: int, trough: int, snr_threshold: float, a: float = 12.0, b: float = 12.0, d: float = 6.0, edge: str = "saturate") -> Column:
    """Weight of the raw template against the low-rank one: a logistic function that falls with the distance from the trough, as a share of that to the end on either side, and rises with the channel's
    signal to noise ratio. edge: "saturate" caps the ratio at its threshold, "inf" takes the raw template wholly from there on, "raw" takes the ratio as it is."""
    far = F.abs(sample - trough).cast("double") / F.when(sample >= trough, F.lit(max(length - 1 - trough, 1))).otherwise(F.lit(max(trough, 1)))
    s = snr if edge == "raw" else F.least(snr, F.lit(float(snr_threshold))) / snr_threshold
    weight = 1 / (1 + F.exp(d + a * far - b * s))
    return F.when(s >= 1, 1.0).otherwise(weight) if edge == "inf" else weight


def blended(raw: DataFrame, low: DataFrame, snr: DataFrame, length: int, trough: int, snr_threshold: float, **how) -> DataFrame:
    """(unit, channel, sample, v): weight * raw + (1 - weight) * low rank; snr is (unit, channel, snr)."""
    both = raw.join(low.withColumnRenamed("v", "_low"), ["unit", "channel", "sample"]).join(snr, ["unit", "channel"])
    w = denoising_weight(F.col("sample"), F.col("snr"), length, trough, snr_threshold, **how)
    return both.select("unit", "channel", "sample", (w * F.col("v") + (1 - w) * F.col("_low")).alias("v"))


def registered_average(snippets: DataFrame, median: bool = True, least_share: float = 0.0) -> DataFrame:
    """(unit, reg_channel, sample, v, n): the lower median, or mean, of snippets (unit, reg_channel, sample, v) that were moved to the registered probe; nulls and NaN aren't counted."""
    seen = snippets.where(F.col("v").isNotNull() & ~F.isnan("v"))
    value = F.expr("percentile_disc(0.5) within group (order by v)") if median else F.avg("v")
    return seen.groupBy("unit", "reg_channel", "sample").agg(value.alias("v"), F.count(F.lit(1)).alias("n"))


def registered_template(snippets: DataFrame, least_share: float = 0.5, least_count: int = 25, median: bool = True) -> DataFrame:
    """(unit, reg_channel, sample, v, n): averages of a unit's snippets (unit, spike_id, shift, reg_channel, sample, v) by shift, then their mean by spikes over the shifts that have
    a share of the unit's spikes or a count of them."""
    spikes = snippets.select("unit", "shift", "spike_id").distinct().groupBy("unit", "shift").agg(F.count(F.lit(1)).alias("c"))
    total = spikes.groupBy("unit").agg(F.sum("c").alias("total"))
    good = spikes.join(total, "unit").where((F.col("c") >= least_share * F.col("total")) | (F.col("c") >= least_count)).select("unit", "shift")
    value = F.expr("percentile_disc(0.5) within group (order by v)") if median else F.avg("v")
    seen = snippets.where(F.col("v").isNotNull() & ~F.isnan("v")).join(good, ["unit", "shift"], "left_semi")
    by = seen.groupBy("unit", "shift", "reg_channel", "sample").agg(value.alias("v"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("unit", "reg_channel", "sample").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n"))


def at_shift(templates: DataFrame, shifts: DataFrame, channels: DataFrame, registered: DataFrame, pitch: float, digits: int = 3) -> DataFrame:
    """(unit, channel, sample, v, ...): registered templates (unit, reg_channel, sample, v) as the probe sees them when each unit is moved by `shift` whole pitches (shifts: unit, shift, and what else
    tells the time); a probe's channel that a template doesn't cover has no row. An equi-join on rounded places."""
    from .channels import shifted_channels

    place = shifted_channels(channels.select("channel").join(shifts.select("shift").distinct()), channels, registered, pitch, digits).where("reg_channel is not null")
    return templates.join(shifts, "unit").join(F.broadcast(place), ["shift", "reg_channel"])


def template_places(mains: DataFrame, channels: DataFrame) -> DataFrame:
    """(unit, x, z): where each unit's main channel lies."""
    return mains.join(F.broadcast(channels.select("channel", "x", "z")), "channel").select("unit", "channel", "x", "z")


def united(first: DataFrame, second: DataFrame, unit: str = "unit") -> DataFrame:
    """Two sets of templates; the second's units follow the first's numbers."""
    shift = first.agg(F.coalesce(F.max(unit) + 1, F.lit(0)).alias("_o"))
    return first.unionByName(second.join(F.broadcast(shift)).withColumn(unit, F.col(unit) + F.col("_o")).drop("_o"))


def weighted_distance(templates: DataFrame, weights: DataFrame, least_iou: float = 0.75, kind: str = "normeuc") -> DataFrame:
    """(i, j, d): between units, by channel weights (unit, channel, w), each unit's divided by its greatest; a pair's are the lesser of both.

    normeuc: root mean square of the difference over the geometric mean of the root mean squares; normsup: greatest weighted difference over the lesser of the greatest weighted values. Pairs whose channels overlap
    too little (sum of lesser over sum of greater weights, a channel that only one unit has counting for it) are left out, that is infinitely far.
    """
    top = weights.groupBy("unit").agg(F.max("w").alias("_top"))
    scaled = weights.join(top, "unit").select("unit", "channel", (F.col("w") / F.col("_top")).alias("w"))
    sums = scaled.groupBy("unit").agg(F.sum("w").alias("s"))
    side = lambda df, i, *cols: df.select(F.col("unit").alias(i), *(F.col(c).alias(f"{c}{i}") if c in "wsv" else F.col(c) for c in cols))
    common = side(scaled, "i", "channel", "w").join(side(scaled, "j", "channel", "w"), "channel").where("i < j").groupBy("i", "j").agg(F.sum(F.least("wi", "wj")).alias("_both"))
    any_ = F.col("si") + F.col("sj") - F.col("_both")
    near = common.join(side(sums, "i", "s"), "i").join(side(sums, "j", "s"), "j").where(F.col("_both") >= least_iou * any_).select("i", "j")
    t = templates.join(scaled, ["unit", "channel"])
    both = side(t, "i", "channel", "sample", "v", "w").join(near, "i").join(side(t, "j", "channel", "sample", "v", "w"), ["j", "channel", "sample"])
    w, a, b = F.least("wi", "wj"), F.col("vi"), F.col("vj")
    if kind == "normeuc":
        d = F.sqrt(F.sum(w * (a - b) ** 2)) / F.pow(F.sum(w * a * a) * F.sum(w * b * b), F.lit(0.25))
    else:
        d = F.max(w * F.abs(a - b)) / F.least(F.max(w * F.abs(a)), F.max(w * F.abs(b)))
    return both.groupBy("i", "j").agg(d.alias("d"))


def mean_median_difference(mean: DataFrame, median: DataFrame) -> DataFrame:
    """(unit, d): how far a unit's mean and median templates are apart, against the mean's norm: great where collisions pull the mean."""
    both = mean.join(median.withColumnRenamed("v", "_m"), ["unit", "channel", "sample"])
    return both.groupBy("unit").agg(F.try_divide(F.sqrt(F.sum((F.col("v") - F.col("_m")) ** 2)), F.sqrt(F.sum(F.col("v") ** 2))).alias("d"))


def noisy_units(units: DataFrame, snr: float, count: int) -> DataFrame:
    """(unit, keep): units (unit, snr, n) seen often and clearly enough for a template."""
    return units.withColumn("keep", (F.col("snr") >= snr) & (F.col("n") >= count))
