"""A recording from samples to sorted spikes: detection, localisation, clustering, templates, matching.

Every stage is a table in the run's folder; a run that is started again goes on behind the last stage that is whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density, detect, joins, labels, locate, matching, noise
from ..session import ship
from ..sources.tables import with_ids


@dataclass(frozen=True)
class Settings:
    """chunk, before, length, radii of time in samples; distances in the unit of the channels' positions; thresholds in noise levels."""

    chunk: int = 30_000
    before: int = 42
    length: int = 121
    threshold: float = 5.0
    sign: int = -1
    peak_radius: int = 5
    dedup_radius: int = 11
    neighbour_radius: float = 75.0
    sigma: float = 5.0
    reach: float = 15.0
    amplitude_scale: float = 15.0
    least_spikes: int = 10
    match_threshold: float = 8.0
    refractory: int = 10


def kept(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table, made only if it isn't there whole (a job's last act is to mark its table as done)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        make().write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def sort(samples: DataFrame, channels: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(spike_id, t, label, objective, scaling) of samples (t, channel, v) with channels (channel, x, z). folder is shared by all machines; labels are in order of depth.

    Tables of channels and units are small and go along with functions; samples are only ever grouped by chunks of bounded length.
    """
    spark, c = ship(samples.sparkSession), settings
    place = {r.channel: (r.x, r.z) for r in channels.select("channel", "x", "z").collect()}
    names = sorted(place)
    index = joins.channel_index(channels, c.neighbour_radius)
    near: dict[int, list[int]] = {}
    for r in index.select("channel", "neighbor").collect():
        near.setdefault(r.channel, []).append(r.neighbor)
    near = {k: sorted(v) for k, v in near.items()}

    x = kept(spark, folder, "standardized", lambda: noise.standardize(samples.select("t", "channel", "v"), to="z").select("t", "channel", F.col("z").alias("v")))

    def detected() -> DataFrame:
        peaks = detect.peaks_by_chunk(x, c.chunk, c.peak_radius, c.threshold, c.sign)
        return with_ids(detect.detect_and_deduplicate(peaks, index.select("channel", "neighbor"), c.dedup_radius), ["t", "channel"])

    spikes = kept(spark, folder, "detected", detected)
    pos = lambda axis: F.transform("near", lambda n: F.element_at(F.create_map(*(F.lit(v) for k in names for v in (k, float(place[k][axis])))), n))

    def located() -> DataFrame:
        got = detect.grab(x, spikes, near, c.before, c.length, c.chunk).select("spike_id", "t", "channel", "amp", pos(0).alias("xs"), pos(1).alias("zs"))
        found = locate.localize(got, "spike_id")
        return got.select("spike_id", "t", "channel", F.array_max("amp").alias("ptp")).join(found, "spike_id")

    features = kept(spark, folder, "located", located)

    def clustered() -> DataFrame:
        pts = features.where("x is not null").select("spike_id", "x", "z", (F.log1p("ptp") * c.amplitude_scale).alias("a"))
        found = density.density_peaks(pts, ["x", "z", "a"], "spike_id", c.sigma, None, 20, c.reach, c.least_spikes)
        return labels.decrumb(features.select("spike_id", "t", "z").join(found, "spike_id"), c.least_spikes, to="unit").select("spike_id", "t", "z", F.col("unit").alias("label"))

    clusters = kept(spark, folder, "clustered", clustered)
    ordered = labels.reorder_by_depth(clusters).select("spike_id", "t", F.col("by_depth").alias("label"))
    means = kept(spark, folder, "templates", lambda: detect.templates_of(x, ordered, names, c.before, c.length, c.chunk))
    rows = means.orderBy("label", "channel").collect()
    units = sorted({r.label for r in rows})
    shape = np.zeros((len(units), c.length, len(names)))
    for r in rows:
        shape[units.index(r.label), :, names.index(r.channel)] = r.v

    def matched() -> DataFrame:
        got = matching.match(x, shape, units, c.match_threshold, c.before, c.chunk, c.refractory, channels=names)
        return with_ids(got, ["t", "unit"]).select("spike_id", "t", F.col("unit").alias("label"), "objective", "scaling")

    return kept(spark, folder, "matched", matched)


def described(settings: Settings) -> str:
    """The settings as JSON."""
    return json.dumps(asdict(settings), sort_keys=True)
