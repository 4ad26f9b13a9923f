"""Refinement, localisation, scores and comparison against plain restatements."""

import numpy as np
import pandas as pd
from spindrift.operators import compare, distances, locate, refine, soft


def test_sources_are_recovered(spark):
    r = np.random.default_rng(0)
    gx, gz = np.tile([0.0, 32.0], 8), np.repeat(np.arange(8) * 20.0, 2)
    n = 101
    x, y, z, alpha = r.uniform(-10, 40, n), r.uniform(5, 40, n), r.uniform(40, 100, n), r.uniform(100, 500, n)
    amp = alpha[:, None] / np.sqrt((gx - x[:, None]) ** 2 + y[:, None] ** 2 + (gz - z[:, None]) ** 2)
    rows = [(i, a.tolist(), gx.tolist(), gz.tolist()) for i, a in enumerate(amp)] + [(n, None, None, None), (n + 1, [1.0, float("nan"), None], [0.0] * 3, [0.0] * 3), (n + 2, [], [], [])]
    got = locate.localize(spark.createDataFrame(rows, "id long, amp array<double>, xs array<double>, zs array<double>"), "id").orderBy("id").toPandas()
    assert got[["x", "y", "z", "alpha", "mse"]].isna().all(axis=1).tolist() == [False] * n + [True] * 3
    assert np.abs(np.stack([got.x[:n] - x, got.y[:n] - y, got.z[:n] - z])).max() < 0.5 and np.allclose(got.alpha[:n].astype(float), alpha, rtol=0.02)


def test_enforce_decrease(spark):
    channels = spark.createDataFrame([(i, 0.0, 20.0 * i) for i in range(4)], "channel int, x double, z double")
    near = spark.createDataFrame([(0, i) for i in range(4)], "channel int, neighbor int")
    tree = locate.parents(channels, near)
    assert {(r.channel, r.parent) for r in tree.collect()} == {(2, 1), (3, 1), (3, 2)}
    rows = spark.createDataFrame([(9, 0, c, p) for c, p in enumerate([5.0, 2.0, 4.0, 1.0])], "id int, main int, channel int, ptp double")
    assert {r.channel: r.scale for r in locate.enforce_decrease(rows, tree, "id").collect()} == {0: 1.0, 1: 1.0, 2: 0.5, 3: 1.0}


def blobs(spark, centres, n=200, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, c, (r.normal(size=2) + centres[c]).tolist()) for i, c in enumerate(r.integers(0, len(centres), n * len(centres)).tolist())]
    return spark.createDataFrame(rows, "id int, c int, v array<double>").repartition(3).cache()


def test_merge_split_and_removal(spark):
    rows = blobs(spark, [(0, 0), (12, 0), (0, 12)])
    train, held = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    pi = lambda k: np.append(np.full(k, 0.999 / k), 0.001)
    good = np.array([[0.0, 0], [12, 0], [0, 12]])
    twice = refine.Model(np.concatenate([good, [[0.3, 0.2]]]), pi(4), 1.0)
    assert len(refine.merge_step(held, "v", twice, 2.0).means) == 3
    assert len(refine.merge_step(held, "v", refine.Model(good, pi(3), 1.0), 100.0).means) == 3
    assert len(refine.remove_step(held, "v", refine.Model(np.concatenate([good, [[40.0, 40]]]), pi(4), 1.0)).means) == 3
    coarse = refine.split_step(train, held, "v", refine.Model(np.array([[6.0, 0], [0, 12]]), pi(2), 9.0))
    assert len(coarse.means) == 3
    assert np.abs(np.sort(coarse.means, 0) - np.sort(good, 0)).max() < 0.6
    done = refine.refine(train, held, "v", refine.Model(np.array([[5.0, 3.0]]), pi(1), 20.0, 1e-6), 2.0, rounds=4)
    assert len(done.means) == 3


def test_criterion_of_model_against_definition(spark):
    rows = blobs(spark, [(0, 0), (3, 0)], 20)
    m = refine.Model(np.array([[0.0, 0], [3, 0]]), np.array([0.4, 0.5, 0.1]), 1.3)
    x = np.stack(rows.toPandas().v.to_numpy())
    ll = m.log_likelihoods(x)
    lse = np.log(np.exp(ll).sum(1))
    p = np.exp(ll - lse[:, None])
    assert np.allclose(refine.criteria(rows, "v", [m], 0.7), [(lse + 0.7 * (p * np.log(p)).sum(1)).mean()])
    assert refine.criteria(rows.where("id < 0"), "v", [m])[0] in (-np.inf,) or np.isnan(refine.criteria(rows.where("id < 0"), "v", [m])[0])


def test_scores_edges(spark):
    rows = spark.createDataFrame([(1, 0, 0.0), (1, 2, float("-inf")), (2, 0, None), (2, 1, float("-inf"))], "s int, unit int, ll double")
    got = {(r.s, r.unit): (r.r, r["rank"]) for r in soft.renormalize(rows, "s").collect()}
    assert got == {(1, 0): (1.0, 1), (1, 2): (0.0, 2), (2, 0): (0.0, 1), (2, 1): (0.0, 2)}
    noisy = spark.createDataFrame([(1, 0, -1.0, -1.0), (1, 1, -1.0, -1.0), (2, 0, -3.0, -1.0)], "s int, unit int, ll double, n double")
    assert {r.s: r.label for r in soft.top_labels(noisy, "s", noise="n").collect()} == {1: 0, 2: -1}
    assert abs(sum(r.r for r in soft.renormalize(noisy, "s", noise="n").where("s = 1").collect()) - 2 / 3) < 1e-12


def test_comparison(spark):
    cats = spark.createDataFrame([(1, 1, "TP"), (2, None, "FN"), (None, 3, "FP")], "a_id long, b_id long, category string")
    a, b = spark.createDataFrame([(1, 0), (2, 0)], "a_id long, label int"), spark.createDataFrame([(1, 0), (3, 1)], "b_id long, label int")
    got = {r.label: (r.accuracy, r.recall, r.precision) for r in compare.unit_performance(cats, a, b).collect()}
    assert got == {0: (0.5, 0.5, 1.0), 1: (0.0, None, 0.0)}
    m = spark.createDataFrame([(0, 10, 13), (0, 10, 6)], "label int, ta long, tb long")
    assert abs(compare.misalignment(m).first().rms - np.sqrt(12.5)) < 1e-12
    wide = spark.createDataFrame(pd.DataFrame({"u": [1], "x": [0.5], "y": [0.25]}))
    assert sorted(map(tuple, compare.melted(wide, ["u"], ["x", "y"]).collect())) == [(1, "x", 0.5), (1, "y", 0.25)]


def test_lagged_and_combined(spark):
    u = spark.createDataFrame([(0, [0.0, 0.0, 1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0, 0.0, 0.0])], "label int, v array<double>")
    assert tuple(distances.lagged(u, 3).first()) == (0, 1, 2, 5.0)
    a, b = spark.createDataFrame([(0, 1, 0.2), (0, 2, 0.1)], "i int, j int, d double"), spark.createDataFrame([(0, 1, 0.3)], "i int, j int, d double")
    assert [(r.i, r.j, round(r.d, 9)) for r in distances.combined([(a, 0.5), (b, 0.5)]).collect()] == [(0, 1, 0.6)]
