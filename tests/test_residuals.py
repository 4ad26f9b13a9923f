"""Snippets without spikes: their places, their noise's covariance, and the same under drift."""

import numpy as np
from spindrift.operators import residuals

L, C, N = 20, 4, 16_000
PLACES = np.stack([np.zeros(C), np.arange(C) * 20.0], 1)


def noise(seed=0):
    r = np.random.default_rng(seed)
    root = np.linalg.cholesky(0.6 ** np.abs(np.arange(C)[:, None] - np.arange(C)))
    return r.normal(size=(N, C)) @ root.T, root @ root.T


def frame(spark, x):
    return spark.createDataFrame([(t, c, float(x[t, c])) for t in range(len(x)) for c in range(x.shape[1])], "t long, channel int, v double")


def test_starts(spark):
    x = spark.createDataFrame([(t,) for t in range(7, 307)], "t long")
    spikes = spark.createDataFrame([(50,), (50,), (133,), (None,)], "t long")
    got = sorted(r.start for r in residuals.free_starts(x, spikes, L, 5, guard=2).collect())
    barred = {k for t in (50, 133) for s in range(t - 7, t + 17) for k in [s // L * L]}
    assert got == [s for s in range(20, 300, L) if s + L <= 307 and s not in barred]
    some = [r.start for r in residuals.free_starts(x, spikes, L, 5, 4).collect()]
    assert len(some) == 4 and set(some) <= set(got) | set(range(0, 307, L)) and some == [r.start for r in residuals.free_starts(x.repartition(5), spikes, L, 5, 4).collect()]
    assert residuals.free_starts(x.limit(0), spikes, L, 5).count() == 0


def test_stationary_noise(spark):
    """The drawn covariance is recovered, and what spikes there are doesn't enter it."""
    x, cov = noise()
    loud = x.copy()
    times = np.arange(37, N - 40, 97)
    for t in times:
        loud[t - 5 : t + 15] += 50.0
    basis = np.eye(L)[[3, 11]]
    samples, spikes = frame(spark, loud), spark.createDataFrame([(int(t),) for t in times], "t long")
    starts = residuals.free_starts(samples, spikes, L, 5)
    snips = residuals.snippets(samples, starts, list(range(C)), L, 1000)
    got = residuals.noise_of(residuals.registered(snips, basis, PLACES, PLACES), 2)
    assert starts.count() > 400 and np.abs(got.mean).max() < 0.25
    full = got.covariance()
    n = starts.count()
    assert np.abs(full - np.kron(np.eye(2), cov)).max() < 5 / np.sqrt(n)
    one = {r.start: r.v for r in snips.limit(5).collect()}
    assert all(np.allclose(np.array(v).reshape(C, L), loud[s : s + L].T) for s, v in one.items())


def test_under_drift(spark):
    """A field that is linear in depth is the same at registered places, wherever the probe lay; noise by rank keeps its variance without a move."""
    snips = spark.createDataFrame([(k * 100, np.repeat(2 * (PLACES[:, 1] + 10.0 * k) + 1, L).tolist()) for k in range(3)], "start long, v array<double>")
    shift = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 20.0)], "t_bin long, shift double")
    to = np.stack([np.zeros(3), np.array([20.0, 30.0, 40.0])], 1)
    rows = residuals.registered(snips, np.ones((1, L)) / L, PLACES, to, shift, 100, degree=1)
    assert all(np.allclose(r.v, 2 * to[:, 1] + 1) for r in rows.collect()) and rows.count() == 3
    x, cov = noise(1)
    all_ = residuals.snippets(frame(spark, x[:4000]), spark.createDataFrame([(s,) for s in range(0, 4000, L)], "start long"), list(range(C)), L, 700)
    by = residuals.noise_of(residuals.registered(all_, np.eye(L)[:3], PLACES, PLACES), 3, "rank")
    assert by.kind == "rank" and np.allclose(by.parts[0], 1.0, atol=0.25)
