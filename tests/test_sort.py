"""A simulated recording, sorted from samples to spikes."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.operators import detect, simulate
from spindrift.plans import sort as plan


@pytest.fixture(scope="module")
def recording(spark):
    ch = simulate.probe(spark, 2, 6, 32.0, 40.0, 0.0)
    place = {r.channel: (r.x, r.z) for r in ch.collect()}
    sources = [(0.0, 15.0, 20.0, 18.0), (30.0, 15.0, 100.0, 24.0), (10.0, 15.0, 180.0, 21.0)]
    rows, r = [], np.random.default_rng(5)
    for u, (sx, sy, sz, a) in enumerate(sources):
        w = simulate.waveform(41, 14, r.uniform(0.1, 0.3), r.uniform(0.3, 0.5), (4.0, 2.0, 5.0))
        rows += [(u, c, (w * a * sy / np.sqrt((sx - x) ** 2 + sy**2 + (sz - z) ** 2)).tolist()) for c, (x, z) in place.items()]
    templates = spark.createDataFrame(rows, "unit int, channel int, v array<double>")
    spikes = simulate.global_train(spark, 3, 12.0, 11_900, 60, 3000.0, 5).where("t >= 50").cache()
    return ch, simulate.inject(simulate.noise(spark, 12, 0, 12_000, 5), spikes, templates, 14).cache(), spikes


def test_sort(spark, recording, tmp_path):
    ch, x, spikes = recording
    s = plan.Settings(chunk=3000, before=14, length=41, sigma=4.0, neighbour_radius=75.0, reach=25.0, threshold=6.0)
    got = plan.sort(x, ch, str(tmp_path / "run"), s).toPandas()
    want = spikes.toPandas()
    assert set(got.label) == {0, 1, 2} and got.spike_id.is_unique
    near = {(r.label, r.t + k) for r in got.itertuples() for k in (-1, 0, 1)}
    assert np.mean([(r.label, r.t) in near for r in want.itertuples()]) > 0.95 and abs(len(got) - len(want)) < 0.05 * len(want)
    # started again, nothing is made anew
    made = {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet")}
    assert plan.sort(x, ch, str(tmp_path / "run"), s).count() == len(got)
    assert made == {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet")}


def test_sort_of_silence(spark, recording, tmp_path):
    ch, x, _ = recording
    quiet = x.where("t < 500").withColumn("v", F.when(F.col("t") % 2 == 0, 0.5).otherwise(-0.5))
    assert plan.sort(quiet, ch, str(tmp_path / "run"), plan.Settings(chunk=300, before=14, length=41)).count() == 0


def test_peaks_do_not_depend_on_chunks(spark):
    r = np.random.default_rng(0)
    x = spark.createDataFrame([(t, c, float(v)) for c in range(2) for t, v in enumerate(r.normal(size=400))], "t long, channel int, v double")
    a, b = ({tuple(p) for p in detect.peaks_by_chunk(x, n, 4, 1.0, 0).collect() if 5 < p.t < 395} for n in (50, 1000))
    assert a == b and len(a) > 10
