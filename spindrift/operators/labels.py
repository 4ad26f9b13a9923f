"""Relabelling and masking a table of spikes (spike_id, t, label, ...); label -1 means none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keep(label: Column, condition: Column) -> Column:
    return F.when(condition, label).otherwise(F.lit(-1))


def flatten(spikes: DataFrame, label: str = "label", to: str = "flat") -> DataFrame:
    """Dense labels 0..K-1 in order of the old ones; -1 stays. The map has a row for each unit and joins back by broadcast or shuffle as its size asks."""
    units = spikes.where(F.col(label) >= 0).select(F.col(label)).distinct()
    names = units.withColumn(to, F.row_number().over(Window.orderBy(label)) - 1)
    return spikes.join(names, label, "left").withColumn(to, F.coalesce(F.col(to), F.lit(-1)))


def _counted(spikes: DataFrame, label: str) -> DataFrame:
    """Adds the unit's size; counted with partial aggregation, so a unit with a third of all spikes shrinks before the shuffle."""
    counts = spikes.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return spikes.join(counts, label, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))


def decrumb(spikes: DataFrame, min_size: int = 5, label: str = "label", to: str = "kept") -> DataFrame:
    """Units below min_size become -1; the others are numbered densely."""
    counts = spikes.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    names = counts.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias(to))
    return spikes.join(names, label, "left").withColumn(to, F.coalesce(F.col(to), F.lit(-1)))


def count_filter(spikes: DataFrame, least: int = 0, most: float = float("inf"), label: str = "label", to: str = "kept") -> DataFrame:
    """Units outside [least, most] become -1. Both bounds hold, also when least is 0."""
    return _counted(spikes, label).withColumn(to, _keep(F.col(label), (F.col("_n") >= least) & (F.col("_n") <= most) & (F.col(label) >= 0))).drop("_n")


def cap_per_unit(spikes: DataFrame, most: int = 256, label: str = "label", key: str = "spike_id", to: str = "kept") -> DataFrame:
    """At most `most` spikes a unit, drawn by the MD5 of their id; the others become -1."""
    w = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return spikes.withColumn(to, _keep(F.col(label), F.row_number().over(w) <= most))


def drop_doubles(spikes: DataFrame, label: str = "label", t: str = "t", key: str = "spike_id", to: str = "kept") -> DataFrame:
    """Of spikes of one unit at one time the first stays, the others become -1. Rows are told apart by their key, not by their place in the unit."""
    w = Window.partitionBy(label, t).orderBy(key)
    return spikes.withColumn(to, _keep(F.col(label), F.row_number().over(w) == 1))


def valid_times(spikes: DataFrame, first: int, last: int, t: str = "t", label: str = "label", to: str = "kept") -> DataFrame:
    """Spikes outside the closed range [first, last] become -1."""
    return spikes.withColumn(to, _keep(F.col(label), F.col(t).between(first, last)))


def time_range(spikes: DataFrame, start: int, end: float, relative: bool = True, t: str = "t", label: str = "label", to: str = "kept") -> DataFrame:
    """Spikes outside the half-open range become -1, and times are taken from its start if relative."""
    kept = spikes.withColumn(to, _keep(F.col(label), (F.col(t) >= start) & (F.col(t) < end)))
    return kept.withColumn("t_rel", F.col(t) - start) if relative else kept


def combine(first: DataFrame, second: DataFrame, key: str = "spike_id", label: str = "label", dodge: bool = True) -> DataFrame:
    """Two labelings of the same spikes laid over each other; with dodge, those of the second follow the first one's largest label."""
    top = first.agg(F.coalesce(F.max(label), F.lit(-1)).alias("_top"))
    a, b = first.select(key, F.col(label).alias("_a")), second.select(key, F.col(label).alias("_b"))
    shift = (F.col("_top") + 1) if dodge else F.lit(0)
    both = a.join(b, key, "full").join(F.broadcast(top))
    own = F.when(F.coalesce("_a", F.lit(-1)) >= 0, F.col("_a")).when(F.coalesce("_b", F.lit(-1)) >= 0, F.col("_b") + shift)
    return both.select(key, F.coalesce(own, F.lit(-1)).alias(label))


def reorder_by_depth(spikes: DataFrame, depth: str = "z", label: str = "label", to: str = "by_depth") -> DataFrame:
    """Units numbered in ascending order of their median depth, equal ones in order of their old label."""
    med = spikes.where(F.col(label) >= 0).groupBy(label).agg(F.median(depth).alias("_z"))
    names = med.select(label, (F.row_number().over(Window.orderBy("_z", label)) - 1).alias(to))
    return spikes.join(names, label, "left").withColumn(to, F.coalesce(F.col(to), F.lit(-1)))


def unit_mask(units: DataFrame, count: int, snr: float, ptp: float, always_ptp: float) -> DataFrame:
    """Units that are large, clear and high enough, or high enough to be kept in any case."""
    ok = ((F.col("n") >= count) & (F.col("snr") >= snr) & (F.col("ptp") >= ptp)) | (F.col("ptp") >= always_ptp)
    return units.withColumn("kept", ok)


def permute(spikes: DataFrame, seed: int = 0, label: str = "label", to: str = "permuted") -> DataFrame:
    """Labels exchanged among the units at random, by the MD5 of label and seed; -1 stays."""
    units = spikes.where(F.col(label) >= 0).select(label).distinct()
    by = F.md5(F.concat_ws(":", F.col(label).cast("string"), F.lit(str(seed))).cast("binary"))
    old = units.withColumn("_k", F.row_number().over(Window.orderBy(label)))
    new = units.select(F.col(label).alias(to), F.row_number().over(Window.orderBy(by, label)).alias("_k"))
    return spikes.join(old.join(new, "_k").select(label, to), label, "left").withColumn(to, F.coalesce(to, F.lit(-1)))


def collision_rates(flagged: DataFrame, label: str = "label", flag: str = "cc_flag") -> DataFrame:
    """(label, n, rate): share of a unit's spikes that are flagged."""
    return flagged.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))


def radial_weights(spikes: DataFrame, neighbours: DataFrame, label: str = "label", channel: str = "channel") -> DataFrame:
    """(label, channel, weight): spikes of a unit on a channel or its neighbours, over the unit's greatest such number."""
    own = spikes.where(F.col(label) >= 0).groupBy(label, channel).agg(F.count(F.lit(1)).alias("_n"))
    spread = own.join(neighbours.select(F.col("channel").alias(channel), "neighbor").distinct(), channel).groupBy(label, F.col("neighbor").alias("_c")).agg(F.sum("_n").alias("_s"))
    top = spread.groupBy(label).agg(F.max("_s").alias("_top"))
    return spread.join(top, label).select(label, F.col("_c").alias(channel), (F.col("_s") / F.col("_top")).alias("weight"))


def problems(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, nans, infinite) of number columns, in one pass."""
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.isnan(F.col(c).cast("double"))).alias("nans"), F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infinite")) for c in columns]
    return rows.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("s")).select("s.*")
