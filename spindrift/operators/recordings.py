"""What surrounds a recording: a report on its values, peeling of some of its chunks, residuals, ground truth of simulations and their folders, named grids of settings."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage
from . import detect, simulate


def report(samples: DataFrame, length: int, rate: float, radius: int = 5, threshold: float = 5.0, neighbours: DataFrame | None = None, chunks: list[int] | None = None, detections: tuple[float, float] = (10.0, 10_000.0), largest: float = 1e4, std: tuple[float, float] = (0.1, 10.0)) -> DataFrame:
    """One row: detections a second, the largest |value|, a robust standard deviation (mean over chunks of 1.4826 times the median |value|), and which of these leave their bounds.

    Chunks of `length` samples are all, or those given; a chunk's seconds run from its first to its last time. Peaks of either sign count once over `neighbours` (channel, neighbor), if given.
    Values that are null count nowhere; an empty recording has null figures and no flags.
    """
    own = samples.where("v is not null").withColumn("chunk", F.floor(F.col("t") / length))
    if chunks is not None:
        own = own.where(F.col("chunk").isin(chunks))
    by = own.groupBy("chunk").agg(F.percentile(F.abs("v"), F.lit(0.5)).alias("mad"), F.max(F.abs("v")).alias("top"), ((F.max("t") - F.min("t") + 1) / rate).alias("s"))
    peaks = detect.peaks_by_chunk(own, length, radius, threshold, 0)
    if neighbours is not None:
        peaks = detect.detect_and_deduplicate(peaks, neighbours, radius)
    figures = by.agg((F.avg("mad") * 1.4826).alias("std"), F.max("top").alias("largest"), F.sum("s").alias("seconds"))
    found = peaks.agg(F.count(F.lit(1)).alias("n"))
    out = figures.crossJoin(found).select(F.try_divide("n", "seconds").alias("detections"), "largest", "std")
    few, many = detections
    low, high = std
    return out.select("*", (F.col("detections") < few).alias("too_few"), (F.col("detections") > many).alias("too_many"), (F.col("largest") > largest).alias("too_large"), ((F.col("std") < low) | (F.col("std") > high)).alias("odd_std"))


def next_margin(length: float, factor: int = 10) -> int:
    """The least multiple of factor that isn't below length."""
    return int(-(-length // factor)) * factor


def peel_some(samples: DataFrame, length: int, margin: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunks: list[int], stop_after: int | None = None, at_once: int = 32, seed: int = 0) -> DataFrame:
    """detect.peel on some chunks. With stop_after they are taken in a drawn order, at_once and then twice as many each time, until there are that many rows; results of whole chunks are kept."""
    cut = detect.with_halo(samples, length, margin)
    if stop_after is None:
        return cut.where(F.col("chunk").isin(chunks)).groupBy("chunk").applyInPandas(fn, schema)
    order = [chunks[i] for i in np.random.default_rng(seed).permutation(len(chunks))]
    done, parts, n = 0, [], 0
    while done < len(order) and n < stop_after:
        some = order[done : done + at_once]
        part, _ = stage(cut.where(F.col("chunk").isin(some)).groupBy("chunk").applyInPandas(fn, schema), "peel-some")
        parts.append(part)
        n += part.count()
        done, at_once = done + len(some), 2 * at_once
    if not parts:
        return cut.where("false").groupBy("chunk").applyInPandas(fn, schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def residual(samples: DataFrame, spikes: DataFrame, templates: DataFrame, trough: int) -> DataFrame:
    """samples less each spike's template (label, t[, scale]): what peeling leaves, as a plan that is only computed where it is read."""
    scale = F.col("scale") if "scale" in spikes.columns else F.lit(1.0)
    return simulate.inject(samples, spikes.withColumn("scale", -scale), templates, trough)


def main_components(rows: DataFrame, slot: Column | str, rank: int, keep: int = 1, v: str = "v", to: str = "main") -> DataFrame:
    """The first `keep` components on a row's main channel, from an array of rank components for each slot; null without a slot."""
    at = F.col(slot) if isinstance(slot, str) else slot
    return rows.withColumn(to, F.when(at.isNotNull(), F.slice(v, (at * rank + 1).cast("int"), keep)))


def unit_information(spikes: DataFrame, templates: DataFrame, places: DataFrame, seconds: float) -> DataFrame:
    """(unit, x, y, z, amplitude, norm, n, rate) for every unit of places (unit, x, y, z): greatest peak to peak over channels and norm of its template (unit, channel, sample, v), spikes and spikes a second; units never seen have 0."""
    by = templates.groupBy("unit", "channel").agg((F.max("v") - F.min("v")).alias("ptp"), F.sum(F.col("v") * F.col("v")).alias("sq"))
    size = by.groupBy("unit").agg(F.max("ptp").alias("amplitude"), F.sqrt(F.sum("sq")).alias("norm"))
    counts = spikes.groupBy(F.col("label").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return places.join(size, "unit", "left").join(counts, "unit", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rate", F.col("n") / seconds)


def collidedness(spikes: DataFrame, length: int, t: str = "t") -> DataFrame:
    """n_near: other spikes of the table whose start is within `length` samples. Chunks with margins of counts by time are searched apart, so equal or frequent times are added up before any window."""
    counts = spikes.groupBy(t).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("chunk").orderBy(t).rangeBetween(-(length - 1), length - 1)
    near = detect.with_halo(counts, 256 * length, length, t).withColumn("_near", F.sum("_n").over(w)).where("core").select(t, "_near")
    return spikes.join(near, t).withColumn("n_near", F.col("_near") - 1).drop("_near")


def save_simulation(folder: str, **tables: DataFrame) -> None:
    """Each table as Parquet in the folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_simulation(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def settings_grid(common: dict | None = None, prefix: str = "", make: Callable | None = None, **choices: dict[str, dict]) -> dict:
    """Every combination of one setting a choice, under names that join choice and setting: {"a": {"1": {...}, "2": {...}}} gives a1 and a2. Later choices override earlier ones and the common settings."""
    out = {}
    for picked in itertools.product(*(v.items() for v in choices.values())):
        name = "_".join([*([prefix] if prefix else []), *(f"{c}{s}" for c, (s, _) in zip(choices, picked))])
        settings = dict(common or {})
        for _, kw in picked:
            settings |= kw
        out[name] = make(**settings) if make else settings
    return out
