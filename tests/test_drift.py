"""Nonrigid drift: a sine of two depths, and the chunked solver against one dense system."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.operators import drift, motion
from spindrift.plans import catalogue
from spindrift.sources.tables import event_spikes

PITCH = 20.0


def dense(pairs, bins, windows, in_time, in_depth, ridge=1e-3):
    """The whole normal system at once."""
    n = bins * windows
    a, b = np.eye(n) * ridge, np.zeros(n)
    ties = [(r.i * windows + r.win, r.j * windows + r.win, r.c, r.d) for r in pairs]
    ties += [((t - 1) * windows + k, t * windows + k, in_time, 0.0) for t in range(1, bins) for k in range(windows)]
    ties += [(t * windows + k - 1, t * windows + k, in_depth, 0.0) for t in range(bins) for k in range(1, windows)]
    for x, y, c, d in ties:
        a[x, x] += c
        a[y, y] += c
        a[x, y] -= c
        a[y, x] -= c
        b[y] += c * d
        b[x] -= c * d
    return np.linalg.solve(a, b).reshape(bins, windows)


@pytest.mark.parametrize("chunks, chunk, arity", [(1, 30, 2), (2, 20, 8), (7, 8, 2)])
def test_solver_is_dense_solver(spark, chunks, chunk, arity):
    r = np.random.default_rng(chunks)
    band, windows, bins = 5, 3, chunks * chunk
    rows = [(j // chunk, i, j, k, float(r.normal()), float(r.uniform(0.1, 1))) for j in range(bins) for i in range(max(0, j - band), j) for k in range(windows) if r.random() < 0.6 and j // chunk != 3]
    pairs = spark.createDataFrame(rows, drift.PAIR)
    got = drift.solve(pairs, chunks, chunk, windows, band, 0.7, 0.4, arity=arity).toPandas().sort_values(["t_bin", "z_bin"])
    assert len(got) == bins * windows
    assert np.allclose(got["disp"].to_numpy().reshape(bins, windows), dense(pairs.collect(), bins, windows, 0.7, 0.4), atol=1e-8)


def test_correlations():
    """A shifted row is found at its shift, between bins too."""
    z = np.arange(200.0)
    bumps = lambda s: sum(np.exp(-0.5 * ((z - c - s) / 2.5) ** 2) for c in (40, 61, 90, 133, 150))
    h = np.stack([bumps(0), bumps(3), bumps(-1.5)])
    got = {(i, j): (lag, c) for i, j, _, lag, c in drift.correlations(h, drift.window_weights(z, 1, 200.0, 100.0), 0, 2, 8)}
    assert got.keys() == {(0, 1), (1, 2), (0, 2)}
    assert abs(got[0, 1][0] - 3) < 0.1 and abs(got[0, 2][0] + 1.5) < 0.1 and abs(got[1, 2][0] + 4.5) < 0.1 and min(c for _, c in got.values()) > 0.98
    late = drift.correlations(h, drift.window_weights(z, 2, 100.0, 50.0), 2, 1, 8)
    assert {(i, j, k) for i, j, k, _, _ in late} == {(1, 2, 0), (1, 2, 1)}


def test_sine_of_two_depths(spark):
    """The tip moves three times as far as the base; the field recovers both within a pitch, and registering by it sharpens depths."""
    r = np.random.default_rng(0)
    seconds, depth, n = 120, 800.0, 60_000
    units = np.sort(r.uniform(20, depth - 20, 80))
    t, u = r.uniform(0, seconds, n), r.integers(0, 80, n)
    true = lambda t, z: np.sin(2 * np.pi * t / 60) * (8 + 16 * z / depth)
    z = units[u] + true(t, units[u]) + r.normal(0, 2, n)
    rows = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(t, z, u))], "spike_id long, t double, z double, u int").repartition(6)
    field = drift.estimate(rows, "t", "z", 1.0, 4.0, 200.0, scale=120.0, band=12, most=60.0, in_time=0.2, in_depth=0.5, chunk=32)
    got = field.toPandas().pivot(index="t_bin", columns="z_bin", values="disp").to_numpy()
    want = true((np.arange(seconds) + 0.5)[:, None], ((np.arange(got.shape[1]) + 0.5) * 200.0)[None])
    assert got.shape[0] == seconds and np.abs(got - (want - want.mean())).max() < PITCH / 2
    fixed = motion.correct_field(rows, field, "t", "z", 1.0, 200.0).groupBy("u").agg(F.stddev("z_reg").alias("s"), F.stddev("z").alias("before")).toPandas()
    assert fixed["s"].mean() < 4 and fixed["before"].mean() > 9
    limited = drift.estimate(rows, "t", "z", 1.0, 4.0, 800.0, band=12, most=60.0, chunk=64, fastest=0.5).toPandas()
    assert 0 < limited["disp"].isna().sum() < len(limited)


def test_gaps_and_empty(spark):
    assert drift.estimate(spark.createDataFrame([], "t double, z double"), "t", "z", 1.0, 1.0, 10.0).count() == 0
    rows = spark.createDataFrame([(0.5, 5.0), (0.6, None), (None, 3.0), (90.5, 5.0), (-3.0, 5.0), (1.5, -5.0)], "t double, z double")
    got = drift.estimate(rows, "t", "z", 1.0, 1.0, 10.0, band=3, chunk=16, most=4.0).toPandas()
    assert len(got) == 91 and np.allclose(got["disp"], 0)


def test_for_motion(spark):
    ch = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 20.0), (2, 0.0, 40.0)], "channel int, x double, z double")
    rows = [(1, 7, 0, [0.0, -1.0]), (1, 7, 1, [1.0, -2.0]), (1, 7, 2, None), (2, 9, 1, [0.1, 0.0])]
    got = drift.for_motion(spark.createDataFrame(rows, "spike_id long, t long, channel int, v array<double>"), ch, "spike_id", "t", least=1.0).collect()
    assert [(g.spike_id, g.t, g.z, g.ptp) for g in got] == [(1, 7, 15.0, 3.0)]


def test_query(spark):
    """The registered query against one dense system over the same pairs."""
    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["nonrigid_motion"](spark, sf).toPandas().sort_values(["t_bin", "z_bin"])
    s = event_spikes(spark, sf)
    first = s.agg(F.min("t")).first()[0]
    hist = drift.raster(s.withColumn("t", F.col("t") - first), "t", "amplitude", None, 6e6, 5.0)
    last, deep = hist.agg(F.max("tb"), F.max("zb")).first()
    chunks, windows = last // 48 + 1, int(np.ceil((deep + 1) * 5.0 / 100.0))
    pairs = drift.displacements(hist, 5.0, windows, 100.0, 50.0, 8, 40.0, 48, deep + 1).where(F.col("chunk") < chunks).collect()
    want = dense(pairs, chunks * 48, windows, 1.0, 1.0)[: last + 1]
    assert len(pairs) > 500 and {(p.j - p.i) for p in pairs} == set(range(1, 9))
    assert np.allclose(got["disp"].to_numpy().reshape(last + 1, windows), want - want.mean(), atol=1e-5)
