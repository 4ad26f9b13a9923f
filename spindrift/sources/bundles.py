"""Saving and loading what a run makes: sortings from arrays, templates, motion, steps of a sort, and reading in ranges. A table is Parquet; small models are .npz files in the same folder system."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def save_arrays(spark: SparkSession, path: str, **arrays: np.ndarray) -> None:
    """A small bundle of arrays as one .npz file on whatever file system the path names."""
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(buffer.getvalue()))
    finally:
        out.close()


def load_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def sorting(spark: SparkSession, t: np.ndarray, label: np.ndarray | None = None, channel: np.ndarray | None = None, rate: float = 30_000.0, **features: np.ndarray) -> DataFrame:
    """Spikes from arrays: spike_id in the order given, t_s from the sampling rate; label -1 and channel 0 where none are given."""
    n = len(t)
    data = {"spike_id": np.arange(n), "t": np.asarray(t, np.int64), "label": np.full(n, -1, np.int64) if label is None else np.asarray(label, np.int64), "channel": np.zeros(n, np.int32) if channel is None else np.asarray(channel, np.int32)}
    for name, x in features.items():
        if len(x) != n:
            raise ValueError(f"{name} has {len(x)} rows for {n} spikes")
        data[name] = np.asarray(x, float).tolist() if np.ndim(x) > 1 else np.asarray(x)
    return spark.createDataFrame(pd.DataFrame(data)).withColumn("t_s", F.col("t") / rate)


def sorting_from_trains(spark: SparkSession, trains: dict[int, np.ndarray], rate: float = 30_000.0) -> DataFrame:
    """Spikes of units given as trains, in order of time and then of unit."""
    label = np.concatenate([np.full(len(x), u) for u, x in trains.items()] or [np.zeros(0, int)])
    t = np.concatenate([*trains.values()] or [np.zeros(0, int)])
    order = np.lexsort((label, t))
    return sorting(spark, t[order], label[order], rate=rate)


def as_trains(spikes: DataFrame, part: int, t: str = "t", label: str = "label") -> DataFrame:
    """(label, part, times): trains in pieces of `part` samples of time, so that no list grows with the recording."""
    return spikes.where(F.col(label) >= 0).groupBy(label, F.floor(F.col(t) / part).alias("part")).agg(F.sort_array(F.collect_list(t)).alias("times"))


def save_templates(templates: DataFrame, path: str, **extra: np.ndarray) -> None:
    """Templates (unit, channel, v array) and what else belongs to them, such as counts and the registered geometry."""
    templates.write.mode("overwrite").parquet(f"{path}/templates")
    if extra:
        save_arrays(templates.sparkSession, f"{path}/extra.npz", **extra)


def load_templates(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, np.ndarray]]:
    return spark.read.parquet(f"{path}/templates"), load_arrays(spark, f"{path}/extra.npz") if exists(spark, f"{path}/extra.npz") else {}


@dataclass
class Motion:
    """Displacements on time bins (and depth bins) with the probe they belong to."""

    times: np.ndarray
    depths: np.ndarray
    disp: np.ndarray
    pitch: float
    geometry: np.ndarray

    @classmethod
    def static(cls, geometry: np.ndarray, pitch: float) -> Motion:
        """A probe that doesn't move."""
        return cls(np.zeros(1), np.zeros(1), np.zeros((1, 1)), pitch, geometry)

    @property
    def drifting(self) -> bool:
        return bool(np.any(self.disp != 0))

    @property
    def nonrigid(self) -> bool:
        return self.disp.shape[1] > 1

    @property
    def time_bins_s(self) -> np.ndarray:
        return self.times

    @property
    def spatial_bins_um(self) -> np.ndarray:
        return self.depths

    def registered(self) -> np.ndarray:
        """The sites of the probe at every whole pitch it moves by, each once, in order of depth and then of x."""
        moved = np.unique(np.round(-self.disp / self.pitch).astype(int))
        shifts = range(min(0, int(moved.min())), max(0, int(moved.max())) + 1)
        sites = np.round(np.concatenate([self.geometry + [0, k * self.pitch] for k in shifts]), 6)
        sites = np.unique(sites, axis=0)
        return sites[np.lexsort((sites[:, 0], sites[:, 1]))]

    def table(self, spark: SparkSession) -> DataFrame:
        """(t_bin, z_bin, disp): a row for each bin."""
        t, z = np.meshgrid(self.times, self.depths, indexing="ij")
        return spark.createDataFrame(pd.DataFrame({"t_bin": t.ravel().astype(float), "z_bin": z.ravel().astype(float), "disp": self.disp.ravel().astype(float)}))

    @classmethod
    def of_table(cls, motion: DataFrame, geometry: np.ndarray, pitch: float) -> Motion:
        """From a table (t_bin, z_bin, disp) of bins, which is small."""
        wide = motion.toPandas().pivot(index="t_bin", columns="z_bin", values="disp").sort_index()
        return cls(wide.index.to_numpy(float), wide.columns.to_numpy(float), wide.to_numpy(float), pitch, geometry)

    def save(self, spark: SparkSession, path: str) -> None:
        save_arrays(spark, path, times=self.times, depths=self.depths, disp=self.disp, pitch=np.array(self.pitch), geometry=self.geometry)

    @classmethod
    def try_load(cls, spark: SparkSession, path: str) -> Motion | None:
        """None where there is no file."""
        if not exists(spark, path):
            return None
        a = load_arrays(spark, path)
        return cls(a["times"], a["depths"], a["disp"], float(a["pitch"]), a["geometry"])


def save_step(spikes: DataFrame, folder: str, step: int, name: str) -> None:
    """The labels of a step of a sort."""
    spikes.select("spike_id", "label").write.mode("overwrite").parquet(f"{folder}/step={step:03d}-{name}")


def steps(spark: SparkSession, folder: str) -> list[str]:
    """The names of the steps that were saved, in order."""
    fs, p = _path(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(n[5:] for f in fs.listStatus(p) if (n := f.getPath().getName()).startswith("step="))


def load_steps(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Labels by step, each a table of its own."""
    return {name: spark.read.parquet(f"{folder}/step={name}") for name in steps(spark, folder)}


def step_units(spark: SparkSession, folder: str) -> DataFrame:
    """(step, label, n): spikes of each unit at each step."""
    out = None
    for name, df in load_steps(spark, folder).items():
        one = df.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def ranges(rows: DataFrame, key: str, size: int) -> Iterator[tuple[int, DataFrame]]:
    """(first, rows) of a table in ranges of a number; a range's filter is pushed down, and a range is read when it is asked for."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    for first in range(lo, hi + 1, size) if lo is not None else ():
        yield first, rows.where((F.col(key) >= first) & (F.col(key) < first + size))


def full_snippets(spikes: DataFrame, traces: DataFrame, before: int, after: int, length: int) -> DataFrame:
    """(spike_id, channel, v): the samples about each spike on every channel of the recording, from chunks of `length` samples."""
    from .tables import snippets

    every = traces.select("channel").distinct()
    wanted = spikes.select("spike_id", "t").join(F.broadcast(every))
    own = wanted.withColumn("_id", F.col("spike_id")).withColumn("spike_id", F.struct("_id", "channel"))
    return snippets(own, traces, before, after, length).select(F.col("spike_id._id").alias("spike_id"), F.col("spike_id.channel").alias("channel"), "v")


def near_snippets(spikes: DataFrame, traces: DataFrame, index: DataFrame, before: int, after: int, length: int) -> DataFrame:
    """(spike_id, slot, channel, v): the samples about each spike on the neighbours (channel, slot, neighbor) of its channel."""
    from .tables import snippets

    wanted = spikes.select("spike_id", "t", "channel").join(F.broadcast(index), "channel").select("t", F.struct("spike_id", "slot").alias("spike_id"), F.col("neighbor").alias("channel"))
    got = snippets(wanted, traces, before, after, length)
    return got.join(wanted.select("spike_id", "channel"), "spike_id").select(F.col("spike_id.spike_id").alias("spike_id"), F.col("spike_id.slot").alias("slot"), "channel", "v")
