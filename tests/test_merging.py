"""Merging, clusterers, modes, bundles and embedded noise, against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.operators import cluster, clusterers, distances, embedded, merging, modes
from spindrift.sources import bundles, tables


def units_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "label int, v array<double>")


def test_residual_distances(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(4, 20))
    x[1] = np.roll(x[0], 2) * 1.1
    x[1, :2] = 0
    got = {(g.i, g.j): (g.lag, g.d) for g in merging.residual_distances(units_of(spark, x), 3).collect()}
    for (i, j), (lag, d) in got.items():
        dots = {k: sum(x[i, s] * x[j, s - k] for s in range(20) if 0 <= s - k < 20) for k in range(-3, 4)}
        best = max(dots.values())
        a, b = (x[i] ** 2).sum(), (x[j] ** 2).sum()
        assert abs(dots[lag] - best) < 1e-9 and abs(d - min(1 - max(0, 2 * best - b) / a, 1 - max(0, 2 * best - a) / b)) < 1e-9
    assert got[0, 1][1] == min(d for _, d in got.values())
    scaled = {(g.i, g.j): g.d for g in merging.residual_distances(units_of(spark, x), 3, 0.1).collect()}
    assert scaled[0, 1] <= got[0, 1][1] + 1e-9
    cross = {(g.i, g.j): g.d for g in merging.cross_distances(units_of(spark, x), units_of(spark, x)).collect()}
    assert cross[2, 2] == 0 and abs(cross[0, 3] - np.linalg.norm(x[0] - x[3]) / np.sqrt(np.linalg.norm(x[0]) * np.linalg.norm(x[3]))) < 1e-9
    near = merging.nearest_templates(merging.residual_distances(units_of(spark, x), 3), 1).collect()
    assert {n.i: n.j for n in near}[0] == 1 and len(near) == 4


def test_trees():
    x = np.array([0.0, 0.1, 1.0, 1.1, 2.0])
    d = np.abs(x[:, None] - x[None])
    merges = merging.tree(d)
    assert merges[:2] == [(0, 1, pytest.approx(0.1), 2), (2, 3, pytest.approx(0.1), 2)] and len(merges) == 4
    assert merging.leaves(merges, 5)[-1] == {0, 1, 2, 3, 4} and merging.leaf_groups(merges, 5, 2) == [[0, 1], [2, 3], [4]]
    assert merging.leaf_groups(merges, 5, 5, 0.05) == [[i] for i in range(5)] and merging.leaf_groups(merges, 5, 5) == [[0, 1, 2, 3, 4]]
    d[4] = d[:, 4] = np.inf
    assert len(merging.tree(d)) == 3
    assert len(list(merging.partitions([0, 1, 2, 3]))) == 15 and len(list(merging.partitions([0, 1, 2], lambda a, b: {a, b} != {0, 1}))) == 3
    assert sorted(map(sorted, merging.best_partition([0, 1, 2, 3], lambda p: 1.0 if p in ((0, 2), (1, 3)) else 0.0))) == [[0, 2], [1, 3]]


def test_merged_labels(spark):
    s = spark.createDataFrame([(i, 100 * i, i % 5, float(5 - i % 5)) for i in range(50)], "spike_id long, t long, label int, z double")
    x = [0.0, 0.1, 1.0, 1.1, 2.0]
    pairs = spark.createDataFrame([(i, j, abs(x[i] - x[j]), 7) for i in range(5) for j in range(i + 1, 5)], "i int, j int, d double, lag int")
    got = merging.merge_units(s, pairs, 0.15).collect()
    assert {(r.label, r.merged) for r in got} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)} and all(r.t == 100 * r.spike_id + (7 if r.label in (1, 3) else 0) for r in got)
    two = merging.agglomerate(s, [(pairs, 0.15), (pairs.withColumn("d", F.col("d") * 0.1), 1.0)], depth="z")
    assert {(r.label, r.merged) for r in two.select("label", "merged").distinct().collect()} == {(4, 0), (2, 1), (3, 1), (0, 2), (1, 2)}
    flags = spark.createDataFrame([(1, 0.9), (3, 0.1)], "unit int, d double")
    assert {(r.label, r.flat) for r in merging.drop_units(s, flags, "d > 0.5").select("label", "flat").distinct().collect()} == {(0, 0), (1, -1), (2, 1), (3, 2), (4, 3)}
    f = spark.createDataFrame([(i, i % 2, [float(i % 2 * 3 + i // 2 % 2), 1.0]) for i in range(40)], "spike_id long, label int, pcs array<double>")
    assert abs(merging.component_distances(f).first().d - 3 / np.sqrt(0.25)) < 1e-9


def test_isolation(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        u = i % 2
        apart = 20 + r.normal() if u == 0 else abs(r.normal())
        rows += [(i, u, 0.0), (i, 2, -apart)]
    df = spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "spike_id long, unit int, ll double")
    got = {r.unit: r.score for r in merging.isolation(df).collect()}
    assert got[0] < 0.05 and got[1] > 0.7 and merging.isolation_filter(df, 0.5) == [0, 2]


def test_clusterers(spark):
    r = np.random.default_rng(1)
    centres = np.array([[0.0, 0], [10, 0], [0, 10]])
    x = np.concatenate([c + r.normal(size=(100, 2)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist(), i // 100, float(v[0]), float(v[1])) for i, v in enumerate(x)], "spike_id long, feature array<double>, truth int, x double, z double").repartition(3)
    first = clusterers.seeds(df, "feature", 3, seed=2)
    assert len(first) == 3 and len(clusterers.seeds(df, "feature", 50, least=100.0)) == 1
    best = clusterers.restarts(df, "feature", 3, 3)
    assert max(np.abs(best - c).sum(1).min() for c in centres) < 0.6
    mu, pi, var = clusterers.truncated_mixture(df, "feature", best, near=2)
    assert abs(pi.sum() - 1) < 1e-9 and abs(var - 1) < 0.2 and np.abs(pi - 1 / 3).max() < 0.02
    peaks = clusterers.clusterer("mixture_peaks", v="feature", components=6, seed=1)(df).select("truth", "label").distinct().collect()
    assert len({p.label for p in peaks}) >= 3 and len({(p.truth, p.label) for p in peaks}) == len({p.label for p in peaks})
    assert list(clusterers.component_parents(np.array([[0.0], [0.1], [50.0]]), np.array([0.2, 0.5, 0.3]), 1.0)) == [1, 1, 2]
    named = clusterers.clusterer("grid", [lambda s: s.where("label >= 0")], dx=5.0, dz=5.0)(df)
    assert named.count() == 300 and clusterers.clusterer("channel", channel="truth")(df).where("label <> truth").count() == 0
    with pytest.raises(ValueError):
        clusterers.clusterer("nothing")


def test_stitched(spark):
    rows = [(c, k, [k * 10.0 + 0.1 * c], 5) for c in range(4) for k in range(3)] + [(2, 7, [500.0], 5)]
    cents = spark.createDataFrame(rows, "chunk int, cluster int, v array<double>, n int")
    got = {(r.chunk, r.cluster): r.label for r in clusterers.stitched(cents, cents, 1.0).collect()}
    assert len(got) == 13 and all(got[c, k] == got[0, k] for c in range(4) for k in range(3)) and len({*got.values()}) == 4


def test_modes():
    r = np.random.default_rng(0)
    y = r.normal(size=12)
    fit = modes.isotonic(y)
    assert (np.diff(fit) >= -1e-12).all() and abs(fit.sum() - y.sum()) < 1e-9 and modes.isotonic(np.array([1.0, 3, 2])).tolist() == [1, 2.5, 2.5]
    top = modes.up_down(np.array([0.0, 2, 1, 3, 1]))
    assert top.tolist() == [0, 1.5, 1.5, 3, 1]
    one, two = r.normal(size=2000), np.concatenate([r.normal(-4, 1, 1000), r.normal(4, 1, 1000)])
    assert modes.dip(one, 0.0) < 0.03 and modes.dip(two) > 0.1 and modes.dip(np.zeros(5)) == 0.0 and modes.dip(np.zeros(0)) == 0.0
    x = np.linspace(-1, 1, 20)
    assert np.allclose(modes.bimodal_at(x, np.abs(x), 0.0)[:2], np.abs(x)[:10].mean(), atol=1.0)


def test_bundles(spark, tmp_path):
    s = bundles.sorting(spark, np.arange(0, 1000, 10), np.arange(100) % 10, np.arange(100) % 4, amp=np.arange(100.0), place=np.ones((100, 2)))
    assert s.count() == 100 and abs(s.where("spike_id = 3").first().t_s - 30 / 30000) < 1e-12 and len(s.first().place) == 2
    with pytest.raises(ValueError):
        bundles.sorting(spark, np.arange(3), amp=np.arange(2))
    trains = bundles.sorting_from_trains(spark, {3: np.array([5, 1]), 1: np.array([1, 9])})
    assert [(r.t, r.label) for r in trains.orderBy("spike_id").collect()] == [(1, 1), (1, 3), (5, 3), (9, 1)]
    assert {(r.label, r.part): r.times for r in bundles.as_trains(trains, 5).collect()}[3, 0] == [1]
    t = spark.createDataFrame([(0, 0, [1.0, 2.0])], "unit int, channel int, v array<double>")
    bundles.save_templates(t, f"{tmp_path}/t", counts=np.array([4]))
    back, extra = bundles.load_templates(spark, f"{tmp_path}/t")
    assert back.collect() == t.collect() and extra["counts"].tolist() == [4]
    geometry = np.array([[0.0, 0.0], [0.0, 20.0]])
    m = bundles.Motion(np.array([0.5, 1.5]), np.array([0.0]), np.array([[0.0], [-19.0]]), 20.0, geometry)
    assert m.drifting and not m.nonrigid and m.registered().tolist() == [[0, 0], [0, 20], [0, 40]] and not bundles.Motion.static(geometry, 20.0).drifting
    m.save(spark, f"{tmp_path}/m.npz")
    got = bundles.Motion.try_load(spark, f"{tmp_path}/m.npz")
    assert (got.disp == m.disp).all() and got.pitch == 20.0 and bundles.Motion.try_load(spark, f"{tmp_path}/none.npz") is None
    assert (bundles.Motion.of_table(m.table(spark), geometry, 20.0).disp == m.disp).all()
    for k in range(2):
        bundles.save_step(s.where(f"label >= {k}"), f"{tmp_path}/run", k, f"s{k}")
    assert bundles.steps(spark, f"{tmp_path}/run") == ["000-s0", "001-s1"] and bundles.steps(spark, f"{tmp_path}/no") == []
    assert bundles.step_units(spark, f"{tmp_path}/run").where("step = '001-s1'").count() == 9
    parts = list(bundles.ranges(s, "spike_id", 40))
    assert [p.count() for _, p in parts] == [40, 40, 20] and list(bundles.ranges(s.limit(0), "spike_id", 5)) == []
    x = np.arange(60.0).reshape(20, 3)
    traces = spark.createDataFrame([(k, c, k * 5, x[5 * k : 5 * k + 5, c].tolist()) for k in range(4) for c in range(3)], tables.TRACES)
    spikes = spark.createDataFrame([(0, 4, 1), (1, 12, 0)], "spike_id long, t long, channel int")
    for r in bundles.full_snippets(spikes, traces, 2, 3, 5).collect():
        at = {0: 4, 1: 12}[r.spike_id]
        assert r.v == x[at - 2 : at + 3, r.channel].tolist()
    near = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (0, 0, 0)], "channel int, slot int, neighbor int")
    got = bundles.near_snippets(spikes, traces, near, 2, 3, 5).collect()
    assert {(r.spike_id, r.slot, r.channel) for r in got} == {(0, 0, 0), (0, 1, 2), (1, 0, 0)} and all(r.v == x[{0: 4, 1: 12}[r.spike_id] - 2 :][:5, r.channel].tolist() for r in got)


def test_embedded_noise():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(3, 3)), r.normal(size=(5, 5))
    x = np.einsum("rs,nsc,dc->nrd", a, r.normal(size=(20000, 3, 5)), b) + 1.0
    for kind, far in (("factorized", 0.06), ("full", 0.06)):
        noise = embedded.EmbeddedNoise.estimate(x, kind)
        want = np.kron(a @ a.T, b @ b.T)
        assert np.abs(noise.covariance() - want).max() < far * np.abs(want).max()
        white = noise.whiten(x).reshape(len(x), -1)
        assert np.abs(np.cov(white.T) - np.eye(15)).max() < 0.1
        some = np.array([0, 3])
        assert noise.covariance(some).shape == (6, 6) and noise.log_likelihood(x[:5, :, some], some).shape == (5,)
    full = embedded.EmbeddedNoise.estimate(x, "full")
    seen, missing = np.array([0, 1, 2, 3]), np.array([4])
    guess = full.imputed(x[:, :, seen], seen, missing)
    assert ((guess - x[:, :, missing]) ** 2).mean() < 0.9 * x[:, :, missing].var()
    assert np.allclose(full.precisions([seen])[0] @ full.covariance(seen), np.eye(12), atol=1e-6)
    assert embedded.EmbeddedNoise.estimate(x, "scalar").covariance().shape == (15, 15) and embedded.EmbeddedNoise.estimate(x, "rank").parts[0].shape == (3,)
    std, vt = embedded.smooth_root(np.arange(4.0)[:, None] * 10)
    assert np.allclose((vt.T * std**2) @ vt, np.exp(-((np.arange(4)[:, None] - np.arange(4)[None]) ** 2) * 100 / 450))
    flat = embedded.factorized_noise(np.ones(5), np.eye(2), 4000)
    assert abs(flat.var() - 1) < 0.1 and flat.shape == (4000, 2)
    p = np.array([[0.0, 0.0], [0.0, 2.0]])
    assert np.allclose(embedded.polyharmonic(p, order=2), [[0, 4 * np.log(2)], [4 * np.log(2), 0]]) and np.allclose(embedded.polyharmonic(p, order=3)[0, 1], 8)
    assert embedded.beyond(p, np.array([[0.0, 1.0], [0.0, 3.0], [5.0, 1.0]])).tolist() == [False, True, True]
    m = embedded.linear_matrix(np.array([0.0, 1.0, 3.0]), np.array([-1.0, 0.5, 2.0, 9.0]))
    assert np.allclose(m @ [0.0, 10.0, 30.0], [0, 5, 20, 30]) and np.allclose(m.sum(1), 1)
    states, rates = embedded.switching_rates(500, 60, 0.3, 1.0, 2.0, 8.0, 10.0, seed=1)
    spread = np.array([len(np.unique(rates[:, u])) for u in range(60)])
    assert set(spread) == {1, 2} and rates.min() >= 1 and rates.max() <= 10
    with pytest.raises(ValueError):
        embedded.switching_rates(5, 5, 0.5, 1, 2, 3, 4)


def test_linkage_of_lagged(spark):
    x = np.zeros((3, 8))
    x[0, 3], x[1, 4], x[2, 6] = 1.0, 1.0, -1.0
    pairs = merging.residual_distances(units_of(spark, x), 2)
    assert cluster.linkage(pairs, 0.5) == {0: 0, 1: 0} and distances.lagged(units_of(spark, x), 2).count() == 3
