"""Simulated recordings: probes, trains, templates, noise, drift. Draws follow from seed, unit, time and channel, however the rows are split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def probe(spark: SparkSession, columns: int = 4, rows: int = 96, x_pitch: float = 16.0, z_pitch: float = 40.0, stagger: float = 20.0) -> DataFrame:
    """channels(channel, x, z): a grid whose odd columns are shifted by stagger, numbered by depth, then by x."""
    sites = sorted((r * z_pitch + (c % 2) * stagger, c * x_pitch) for c in range(columns) for r in range(rows))
    return spark.createDataFrame([(i, x, z) for i, (z, x) in enumerate(sites)], "channel int, x double, z double")


def trains(spark: SparkSession, units: int, rate_hz: float, duration: int, refractory: int = 40, rate: float = 30_000.0, seed: int = 0) -> DataFrame:
    """(label, t): for each unit a Poisson train with a dead time, in samples below duration. The mean interval is 1 / rate_hz, dead time included."""
    return piecewise_trains(spark, units, [rate_hz], duration, duration, refractory, rate, seed)


def piecewise_trains(spark: SparkSession, units: int, rates: list[float], bin_: int, duration: int, refractory: int = 40, rate: float = 30_000.0, seed: int = 0) -> DataFrame:
    """Trains whose rate is rates[i] in the i-th bin of time, the last one to the end; a bin of rate 0 has no spikes.

    Each unit is drawn from its own seed, block by block, so memory doesn't grow with the duration.
    """
    ship(spark)
    wait = [max(rate / r - refractory, 0.0) if r > 0 else np.inf for r in rates]

    def run(batches):
        for pdf in batches:
            for unit in pdf["id"]:
                rng, t, out = np.random.default_rng([seed, int(unit)]), 0.0, []
                # a unit's time runs in units of the mean wait: exponential draws are spent at the pace of the bin they lie in
                left, i = rng.exponential(), 0
                while i < len(rates) and t < duration:
                    end = duration if i == len(rates) - 1 else min((i + 1) * bin_, duration)
                    if left * wait[i] < end - t:
                        t += left * wait[i]
                        if not out or int(t) > out[-1]:
                            out.append(int(t))
                        t += max(refractory, 1)
                        left = rng.exponential()
                        while i < len(rates) - 1 and t >= (i + 1) * bin_:
                            i += 1
                    else:
                        left -= (end - t) / wait[i] if wait[i] else 0.0
                        t, i = float(end), i + 1
                    if len(out) > 100_000:
                        yield pd.DataFrame({"label": int(unit), "t": out[:-1]})
                        out = out[-1:]
                if out:
                    yield pd.DataFrame({"label": int(unit), "t": out})

    return spark.range(units).repartition(max(1, min(units, spark.sparkContext.defaultParallelism))).mapInPandas(run, "label int, t long")


def global_train(spark: SparkSession, units: int, rate_hz: float, duration: int, refractory: int = 40, rate: float = 30_000.0, seed: int = 0) -> DataFrame:
    """One train with a dead time whose spikes are dealt to units at random, so no two spikes of any units are close."""
    one = trains(spark, 1, rate_hz * units, duration, refractory, rate, seed)
    return one.select(F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(units)).cast("int").alias("label"), "t")


def drift(t: Column, speed: float, centre: float = 0.0, period: float | None = None) -> Column:
    """Displacement at a time: a line through 0 at centre, or with a period a triangle wave of that slope that is 0 at centre."""
    if period is None:
        return (t - centre) * speed
    phase = F.pmod((t - centre) / period + 0.25, F.lit(1.0))
    return (F.lit(0.25) - F.abs(phase - 0.5)) * (speed * period)


def waveform(length: int, trough: int, tip: float, peak: float, widths: tuple[float, float, float]) -> np.ndarray:
    """A spike's shape of unit trough: bumps of two exponentials each for the tip before, the trough, and the peak after it; widths in samples."""
    k = np.arange(length, dtype=float)
    bump = lambda at, w: np.exp(-np.abs(k - at) / w)
    v = tip * bump(trough - 3 * widths[1], widths[0]) - bump(trough, widths[1]) + peak * bump(trough + 3 * widths[1], widths[2])
    return v / abs(v[trough])


def point_source(spark: SparkSession, sources: pd.DataFrame, channels: DataFrame, waveforms: np.ndarray) -> DataFrame:
    """templates(unit, channel, v): each unit's waveform times alpha / distance of its source (unit, x, y, z, alpha) to the site."""
    waves = spark.createDataFrame([(int(u), [float(x) for x in w]) for u, w in zip(sources["unit"], waveforms)], "unit int, w array<double>")
    s = spark.createDataFrame(sources[["unit", "x", "y", "z", "alpha"]].rename(columns={"x": "sx", "y": "sy", "z": "sz"}), "unit int, sx double, sy double, sz double, alpha double")
    gap = F.sqrt(F.pow(F.col("sx") - F.col("x"), 2) + F.pow(F.col("sy"), 2) + F.pow(F.col("sz") - F.col("z"), 2))
    both = s.join(waves, "unit").join(F.broadcast(channels))
    return both.select("unit", "channel", F.transform("w", lambda x: (x * F.try_divide("alpha", gap)).cast("float")).alias("v"))


def noise(spark: SparkSession, channels: int, start: int, end: int, seed: int = 0, sigma: float = 1.0) -> DataFrame:
    """(t, channel, v): white normal noise. A sample follows from seed, time and channel alone, so any range can be made again by itself."""
    bits = lambda k: (F.pmod(F.xxhash64("t", "channel", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    grid = spark.range(start, end).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    return grid.withColumn("v", F.sqrt(F.ln(bits(0)) * -2) * F.cos(bits(1) * (2 * np.pi)) * sigma)


def inject(samples: DataFrame, spikes: DataFrame, templates: DataFrame, trough: int) -> DataFrame:
    """Adds each spike's template (unit, channel, v) about its time to samples (t, channel, v), times the spike's scale if there is such a column; what falls off the table's times or channels is lost."""
    scale = F.col("scale") if "scale" in spikes.columns else F.lit(1.0)
    hit = spikes.select(F.col("label").alias("unit"), "t", scale.alias("_s")).join(templates.select("unit", "channel", F.col("v").alias("_v")), "unit")
    added = hit.select("t", "channel", "_s", F.posexplode("_v").alias("_i", "_x")).select((F.col("t") + F.col("_i") - trough).alias("t"), "channel", (F.col("_x") * F.col("_s")).cast("double").alias("v"), F.lit(0).alias("_own"))
    both = samples.select("t", "channel", F.col("v").cast("double").alias("v"), F.lit(1).alias("_own")).unionByName(added)
    return both.groupBy("t", "channel").agg(F.sum("v").alias("v"), F.max("_own").alias("_own")).where("_own = 1").drop("_own")
