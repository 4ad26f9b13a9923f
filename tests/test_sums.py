"""Sums in executors, mixtures' labels and weighted distances against numpy."""

import numpy as np
import pytest
from spindrift.operators import blend, clusterers, features, refine, sums
from spindrift.plans import catalogue

SF = "/root/testdata/sf0.001"


def table(spark, x, parts):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "spike_id long, v array<double>").repartition(parts)


def test_one_number_an_entry(spark):
    """200 tasks give the driver as many numbers as one does."""
    rows = spark.range(2000).repartition(200)
    got = sums.summed(rows, lambda batches: np.array([sum(len(b) for b in batches), 0.0, 1.0]))
    assert got.tolist() == [2000, 0, 200]
    assert len(sums.summed(rows.where("id < 0"), lambda batches: None)) == 0


def test_moments_and_clusterers(spark):
    r = np.random.default_rng(0)
    truth = np.repeat(np.arange(3), 128)
    x = np.array([[0, 0], [10, 0], [0, 10]])[truth] + r.normal(size=(384, 2))
    rows = table(spark, x, 50)
    n, mean, cov = features.moments(rows)
    assert n == 384 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    centres = clusterers.seeds(rows, "v", 3, seed=1)
    assert centres.shape == (3, 2) and {int(np.argmin(((np.array([[0, 0], [10, 0], [0, 10]]) - c) ** 2).sum(1))) for c in centres} == {0, 1, 2}
    found, _ = clusterers.lloyd(rows, "v", centres)
    means = np.array([x[truth == k].mean(0) for k in range(3)])
    assert all(np.abs(means - c).max(1).min() < 1e-6 for c in found)
    mu, pi, var = clusterers.truncated_mixture(rows, "v", centres, near=2)
    assert all(np.abs(means - c).max(1).min() < 0.05 for c in mu) and np.allclose(pi, 1 / 3, atol=0.02) and abs(var - 1) < 0.15


def test_many_seeds(spark):
    """Several hundred centres are no literals of a plan."""
    x = np.random.default_rng(1).normal(size=(300, 4))
    got = clusterers.seeds(table(spark, x, 2), "v", 20)
    assert len(np.unique(got, axis=0)) == 20


def test_assigned(spark):
    """Proportions, variance and noise decide, not the nearest mean alone."""
    m = refine.Model(np.array([[0.0, 0], [1.0, 0]]), np.array([0.9, 0.05, 0.05]), 0.5, 1e-3)
    x = np.array([[0.6, 0], [0.0, 0], [1.4, 0], [9, 9]])
    got = refine.assigned(table(spark, x, 2), "v", m, "spike_id").toPandas().sort_values("spike_id")
    p = np.concatenate([m.proportions[:2] * np.exp(-((x[:, None] - m.means) ** 2).sum(2) / 1.0) / np.pi, np.full((4, 1), 0.05e-3)], 1)
    assert got["label"].tolist() == [0, 0, int(p[2].argmax()), -1] and np.allclose(got["r"], p.max(1) / p.sum(1))


@pytest.mark.parametrize("name", ["mixture_labels", "refined_mixture"])
def test_queries_of_mixtures(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and got["label"].nunique() > 1
    assert got["r"].between(1 / 12, 1).all() and got["vec_id"].is_unique


@pytest.mark.parametrize("kind", ["normeuc", "normsup"])
@pytest.mark.parametrize("least", [0.0, 0.75])
def test_weighted_distance(spark, kind, least):
    r = np.random.default_rng(2)
    x, w = r.normal(size=(5, 6, 4)), r.uniform(0.2, 3, (5, 4))
    w[3, 2] = 0.0
    t = spark.createDataFrame([(u, c, s, float(x[u, s, c])) for u in range(5) for s in range(6) for c in range(4)], "unit int, channel int, sample int, v double")
    ws = spark.createDataFrame([(u, c, float(w[u, c])) for u in range(5) for c in range(4) if w[u, c]], "unit int, channel int, w double")
    got = {(g.i, g.j): g.d for g in blend.weighted_distance(t, ws, least, kind).collect()}
    n, want = w / w.max(1, keepdims=True), {}
    for i in range(5):
        for j in range(i + 1, 5):
            low = np.minimum(n[i], n[j])
            if low.sum() / np.maximum(n[i], n[j]).sum() < least:
                continue
            if kind == "normeuc":
                d2, a, b = (((v**2) * low / low.sum()).mean() for v in (x[i] - x[j], x[i], x[j]))
                want[i, j] = np.sqrt(d2 / np.sqrt(a) / np.sqrt(b))
            else:
                d, a, b = ((np.abs(v) * low).max() for v in (x[i] - x[j], x[i], x[j]))
                want[i, j] = d / min(a, b)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert least == 0.0 or 0 < len(want) < 10


@pytest.mark.parametrize("block, span", [(256, 512), (7, 5), (1, 1)])
def test_rate_correlations_by_blocks(spark, monkeypatch, block, span):
    """Blocks and spans of any size give numpy's correlations, for one very busy unit too."""
    from spindrift.operators import trains

    monkeypatch.setattr(trains, "BLOCK", block)
    monkeypatch.setattr(trains, "SPAN", span)
    r = np.random.default_rng(5)
    label, t = r.integers(0, 12, 600) * (r.random(600) > 0.4), r.integers(0, 230, 600)
    spikes = spark.createDataFrame([(f"u{a:02}", int(b)) for a, b in zip(label, t)] + [("u00", 0), ("u00", 229)], "label string, t long").repartition(4)
    got = {(g.i, g.j): g.corr for g in trains.rate_correlations(spikes, 10).collect()}
    counts = np.zeros((12, 23))
    np.add.at(counts, (np.append(label, [0, 0]), np.append(t, [0, 229]) // 10), 1)
    want = np.corrcoef(np.sqrt(counts))
    assert got.keys() == {(f"u{i:02}", f"u{j:02}") for i in range(12) for j in range(i + 1, 12)}
    assert all(abs(got[f"u{i:02}", f"u{j:02}"] - want[i, j]) < 1e-9 for i in range(12) for j in range(i + 1, 12))


def test_weighted_lagged(spark):
    """Blocks of any size against the dense formula over all samples, in a basis of three components."""
    from spindrift.operators import distances

    r = np.random.default_rng(7)
    basis = np.linalg.qr(r.normal(size=(9, 3)))[0].T
    spatial, w = r.normal(size=(7, 3, 4)), r.uniform(0.1, 2, (7, 4))
    spatial[4] = 1.1 * spatial[2]
    w[5] = 0
    got = {(g.i, g.j): (g.d, g.lag, g.iou) for g in distances.weighted_lagged(spark, spatial, distances.temporal_products(basis), w, list(range(10, 17)), block=3).collect()}
    full = np.einsum("rt,krc->ktc", basis, spatial)
    assert got.keys() == {(10 + i, 10 + j) for i in range(7) for j in range(i + 1, 7) if 5 not in (i, j)}
    for (i, j), (d, lag, iou) in got.items():
        i, j = i - 10, j - 10
        low = np.minimum(w[i], w[j])
        a, b = full[i] * low / low.sum(), full[j] * low / low.sum()
        dots = {k: sum((a[t + k] * b[t]).sum() for t in range(9) if 0 <= t + k < 9) for k in range(-8, 9)}
        best = max(dots, key=dots.get)
        both = []
        for x, y in ((a, b), (b, a)):
            sx, sy = (x * x).sum(), (y * y).sum()
            s = np.clip((dots[best] + 1e4) / (sx + 1e4), 0.75, 4 / 3)
            both.append(np.sqrt(max(s * s * sx + sy - 2 * s * dots[best], 0) / np.sqrt(sy * s * s * sx)))
        assert lag == best and abs(d - min(both)) < 1e-7 and abs(iou - low.sum() / np.maximum(w[i], w[j]).sum()) < 1e-9
