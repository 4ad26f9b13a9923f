"""Noise, sampling, simulation and matching against plain restatements."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from spindrift.operators import matching, motion, noise, sampling, simulate, templates
from spindrift.plans import noise_queries


def test_whiteners_give_identity():
    r = np.random.default_rng(0)
    a = r.normal(size=(5, 5))
    cov, every = a @ a.T + np.eye(5), [list(range(5))] * 5
    for w in (noise.zca(cov, 0), noise.local_zca(cov, every, 0), noise.local_cholesky(cov, every, 0)):
        assert np.allclose(w @ cov @ w.T, np.eye(5), atol=1e-8)


def test_spectrum_and_kernels(spark):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(x.tolist(),) for x in r.normal(0, 2, (400, 64))] + [([1.0],)], "v array<double>")
    power = np.array([p.power for p in noise.spectrum(rows, 16).orderBy("freq").collect()])
    assert np.allclose(power, 4, rtol=0.15)
    k = noise.whitening_kernel(np.full(9, 4.0), 7)
    assert np.allclose(k, [0, 0, 0, 0.5, 0, 0, 0])
    assert abs(noise.highpass_kernel(300, 30_000, 101).sum()) < 1e-12


def test_convolve_across_chunks(spark):
    r = np.random.default_rng(1)
    x, kernel = r.normal(size=(2, 60)), r.normal(size=7)
    rows = [(i, c, i * 20, [float(v) for v in x[c, i * 20 : i * 20 + 20]]) for c in range(2) for i in range(3)]
    got = noise.convolve(spark.createDataFrame(rows, "chunk_id long, channel int, t0 long, v array<float>"), kernel).orderBy("channel", "t0").collect()
    for c in range(2):
        assert np.allclose(np.concatenate([g.v for g in got if g.channel == c]), np.convolve(x[c], kernel, "same"), atol=1e-4)


def test_factorized(spark):
    r = np.random.default_rng(2)
    a, b = np.array([[1, 0.5], [0.5, 1]]), np.diag([0.5, 1.0, 1.5])
    x = np.einsum("ij,njk,kl->nil", np.linalg.cholesky(a), r.normal(size=(20_000, 2, 3)), np.linalg.cholesky(b).T)
    t, s = noise.factorized(spark.createDataFrame([(y.ravel().tolist(),) for y in x], "v array<double>").repartition(4), 2, 3)
    assert np.allclose(t, a, atol=0.05) and np.allclose(s, b, atol=0.05)


def test_sampling(spark):
    assert sampling.spread_chunks(5, 9) == [0, 1, 2, 3, 4] and len(set(sampling.spread_chunks(100, 7))) == 7
    assert sampling.divide_evenly(11, 4).sum() == 11 and set(sampling.divide_evenly(11, 4)) == {2, 3}
    rows = spark.createDataFrame([(i, 10.0 if i < 1000 else 1.0 if i < 2000 else 0.0) for i in range(3000)], "k long, w double")
    drawn = [r.k for r in sampling.weighted_sample(rows, 200, "k", "w").collect()]
    assert len(set(drawn)) == 200 and max(drawn) < 2000 and 160 < sum(k < 1000 for k in drawn) < 198
    traces = spark.createDataFrame([(i, c, i * 50, [float(i * 50 + k) for k in range(50)]) for i in range(3) for c in range(2)], "chunk_id long, channel int, t0 long, v array<float>")
    got = sampling.random_snippets(traces, 4, 9).toPandas()
    assert len(got) == 24 and all(v[0] == t and len(v) == 9 for t, v in zip(got.t, got.v))
    for _, g in got.groupby("channel"):
        assert (np.diff(np.sort(g.t)) >= 9).all()
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, [float("nan")]), (2, None), (3, [float("-inf")]), (4, [None])], "k int, v array<double>")
    assert [r.k for r in sampling.finite(odd, "v").collect()] == [0]


def test_density_weights_of_equal_and_null_values(spark):
    got = sampling.density_weights(spark.createDataFrame([(1.0,)] * 9 + [(None,)], "v double"), "v", 1.0).collect()
    assert sorted(r.weight for r in got) == [0.0] + [1.0] * 9


def test_trains(spark):
    got = simulate.trains(spark, 3, 30.0, 3_000_000, seed=1).toPandas()
    for _, g in got.groupby("label"):
        gaps = np.diff(g.t)
        assert gaps.min() >= 40 and abs(len(g) - 3000) < 200 and g.t.max() < 3_000_000
    bins = simulate.piecewise_trains(spark, 1, [0.0, 50.0, 5.0], 300_000, 900_000).toPandas().t.floordiv(300_000).value_counts()
    assert 0 not in bins.index and 400 < bins[1] < 600 and 25 < bins[2] < 80
    one = simulate.global_train(spark, 5, 10.0, 300_000).toPandas()
    assert np.diff(np.sort(one.t)).min() >= 40 and set(one.label) == set(range(5))


def test_noise_is_normal_and_repeats(spark):
    a = simulate.noise(spark, 3, 0, 4000, 7).toPandas().sort_values(["t", "channel"])
    b = simulate.noise(spark, 3, 1000, 1100, 7).toPandas().sort_values(["t", "channel"])
    assert abs(a.v.mean()) < 0.05 and abs(a.v.std() - 1) < 0.05
    assert a[a.t.between(1000, 1099)].v.tolist() == b.v.tolist()


def test_probe_and_sources(spark):
    ch = simulate.probe(spark, 2, 4)
    assert ch.count() == 8 and motion.pitch(ch).first().pitch == 40.0
    holes = spark.createDataFrame([(0.0, 0.0), (0.0, 20.0), (0.0, 60.0), (1.0, 5.0)], "x double, z double")
    assert sorted(map(tuple, motion.fill_holes(holes, 20.0).collect())) == [(0.0, 0.0), (0.0, 20.0), (0.0, 40.0), (0.0, 60.0), (1.0, 5.0)]
    src = pd.DataFrame({"unit": [0], "x": [0.0], "y": [30.0], "z": [40.0], "alpha": [60.0]})
    got = {r.channel: r.v[8] for r in simulate.point_source(spark, src, ch, np.stack([simulate.waveform(21, 8, 0.2, 0.3, (3, 1.5, 4))])).collect()}
    at = {r.channel: (r.x, r.z) for r in ch.collect()}
    assert all(abs(got[c] + 60 / np.sqrt(x**2 + 900 + (z - 40) ** 2)) < 1e-5 for c, (x, z) in at.items())


@pytest.mark.parametrize("scale_sd", [0.0, 0.1])
def test_matching_finds_injected_spikes(spark, scale_sd):
    x, spikes, shapes = noise_queries.simulated(spark)
    got = {(r.unit, r.t) for r in matching.match(x, shapes, [0, 1, 2, 3], 7.0, 8, 500, scale_sd=scale_sd).collect()}
    want = {(r.label, r.t) for r in spikes.collect()}
    assert len(want) > 15 and len(want & got) > 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_matching_leaves_no_residual():
    r = np.random.default_rng(0)
    shapes, x = r.normal(size=(2, 9, 3)), np.zeros((300, 3))
    for t, u in ((5, 0), (40, 1), (44 + 9, 0), (200, 1), (288, 0)):
        x[t : t + 9] += shapes[u]
    found = matching.pursuit(shapes, [7, 9], 1.0, 2)(x)
    assert [(t - 2, u) for t, u, _, _ in found] == [(5, 7), (40, 9), (53, 7), (200, 9), (288, 7)]
    assert matching.pursuit(shapes, [7, 9], 1.0, 2)(np.zeros((3, 3))) == []


def test_upsample_and_low_rank():
    k = np.arange(30.0)
    up = templates.upsample(np.sin(k / 4), 4)
    assert np.allclose(up[0], np.sin(k / 4)) and np.allclose(up[2][3:-4], np.sin((k + 0.5) / 4)[3:-4], atol=1e-3)
    u, s, w = templates.low_rank(np.outer(np.hanning(9), [1, -2, 3]), 1)
    assert np.allclose(u * s @ w, np.outer(np.hanning(9), [1, -2, 3]))


def test_realign(spark):
    arrays = spark.createDataFrame([(0, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), (1, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), (2, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])], "label int, v array<double>")
    shifts = spark.createDataFrame([(0, 1), (1, 9)], "label int, shift long")
    assert {r.label: r.v[0] for r in templates.realign(arrays, shifts, 1, 3).collect()} == {0: 2.0, 1: 3.0, 2: 1.0}
    t = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0]), (0, 2, [3.0])], "label int, channel int, v array<double>")
    main, ring = spark.createDataFrame([(0, 1)], "label int, channel int"), spark.createDataFrame([(1, 1), (1, 2)], "channel int, neighbor int")
    assert {r.channel: r.v for r in templates.spatial_mask(t, main, ring).collect()} == {0: [0.0], 1: [2.0], 2: [3.0]}


@pytest.mark.parametrize("kind", ["rbf", "rq", "multiquadric", "thinplate"])
def test_interpolation_is_exact_at_sources_and_on_polynomials(kind):
    r = np.random.default_rng(0)
    src, dst = r.uniform(0, 5, (12, 2)), r.uniform(0, 5, (6, 2))
    f = r.normal(size=12)
    assert np.allclose(motion.interpolation(src, src, kind, degree=1) @ f, f, atol=1e-6)
    plane = lambda p: 2 + p @ [1.0, -3.0]
    assert np.allclose(motion.interpolation(src, dst, kind, degree=1) @ plane(src), plane(dst), atol=1e-6)
    assert np.allclose(motion.interpolation(src, dst, "idw").sum(1), 1) and set(motion.interpolation(src, dst, "nearest").ravel()) == {0, 1}


def test_speed_limit(spark):
    m = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 9.0), (3, 9.5)], "t_bin int, disp double")
    assert [r.disp for r in motion.speed_limit(m, 2.0).orderBy("t_bin").collect()] == [0.0, 1.0, None, 9.5]
    assert motion.speed_limit(m, 2.0).agg(F.count("disp")).first()[0] == 3


def test_matching_of_a_whole_table(spark):
    """The query searches every snippet of the table: as one pursuit over the whole recording."""
    d = "/root/testdata/sf0.001"
    shapes, units = noise_queries.mean_templates(spark, d)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.zeros(((max(r.vec_id for r in rows) + 1) * 16, 4))
    for r in rows:
        x[r.vec_id * 16 : r.vec_id * 16 + 16] = np.array(r.embedding, float).reshape(4, 16).T
    bound = float(np.median(np.sqrt((shapes**2).sum((1, 2))))) / 2
    padded = np.pad(x, ((32, 32), (0, 0)))
    want = {(t - 32, u) for t, u, _, _ in matching.pursuit(shapes, units, bound, 8)(padded) if 32 <= t < len(x) + 32}
    got = {(r.t, r.unit) for r in noise_queries.QUERIES["match_embeddings"](spark, d).collect()}
    assert len(want) > 10 and max(t for t, _ in got) > 0.9 * len(x)
    # chunks end within the recording, so a few spikes near an end may differ
    assert len(want & got) >= 0.97 * max(len(want), len(got))
