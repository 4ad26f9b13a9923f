"""Density peaks over bins, triage, dipoles and priors of detection against plain restatements."""

import math

import numpy as np
import pytest
from spindrift.operators import density, embedded, locate, refine
from spindrift.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain_peaks(x, step, scales, low=None, amp=None, ramp=(6.0, 12.0), radius=5.0, min_size=1):
    """Densities of occupied bins by sums over all bins' counts, and trees of bins, one after the other."""
    b = np.floor(x / step).astype(int)
    cells, inverse = np.unique(b, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    counts, firsts = np.bincount(inverse), np.array([np.flatnonzero(inverse == i).min() for i in range(len(cells))])

    def smoothed(sigma):
        span = int(3 * sigma / step)
        w = np.exp(-((np.arange(-span, span + 1) * step) ** 2) / (2 * sigma**2))
        w = w / w.sum()
        gap = cells[:, None] - cells[None]
        inside = (np.abs(gap) <= span).all(2)
        return (np.where(inside, np.prod(w[np.clip(gap + span, 0, 2 * span)], axis=2), 0) * counts[None]).sum(1)

    ratio = lambda s: smoothed(s[0]) / smoothed(s[1]) if s[1] else smoothed(s[0])
    d = ratio(scales)
    if low:
        mean = np.array([amp[inverse == i].mean() for i in range(len(cells))])
        share = np.clip((mean - ramp[0]) / (ramp[1] - ramp[0]), 0, 1)
        d = share * d + (1 - share) * ratio(low)
    d = np.round(d, 9)
    up = np.arange(len(cells))
    far = np.round(np.sqrt((((cells[:, None] - cells[None]) * step) ** 2).sum(2)), 9)
    for i in range(len(cells)):
        higher = [j for j in range(len(cells)) if far[i, j] <= radius and (d[j], -firsts[j]) > (d[i], -firsts[i])]
        if higher:
            up[i] = min(higher, key=lambda j: (far[i, j], firsts[j]))
    while (up[up] != up).any():
        up = up[up]
    least = np.array([firsts[up == up[i]].min() for i in range(len(cells))])
    size = np.array([counts[up == up[i]].sum() for i in range(len(cells))])
    return np.where(size >= min_size, least, -1)[inverse], d[inverse]


def table(spark, x, **more):
    names = [f"x{i}" for i in range(x.shape[1])] + list(more)
    rows = [(i, *map(float, r), *(float(v[i]) for v in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(3)


def rand(a, b):
    t = np.array([[((a == i) & (b == j)).sum() for j in np.unique(b)] for i in np.unique(a)])
    pairs = lambda n: (n * (n - 1) / 2).sum()
    both, ra, rb = pairs(t), pairs(t.sum(1)), pairs(t.sum(0))
    expected = ra * rb / pairs(np.array([len(a)]))
    return (both - expected) / ((ra + rb) / 2 - expected)


def test_blobs_by_bins(spark):
    r = np.random.default_rng(0)
    truth = np.arange(1000) % 3
    x = np.array([[0, 0], [30, 5], [5, 40]])[truth] + r.normal(size=(1000, 2)) * np.array([2, 3, 4])[truth][:, None]
    got = density.binned_peaks(table(spark, x), ["x0", "x1"], "id", 1.0, 3.0, radius=8.0, min_size=10).toPandas().sort_values("id")
    want, d = plain_peaks(x, 1.0, (3.0, None), radius=8.0, min_size=10)
    assert (got["label"].to_numpy() == want).all() and np.allclose(got["density"], d)
    assert rand(got["label"].to_numpy(), truth) >= 0.95


def test_crowded_cell(spark):
    """20,000 points in one bin, of which all pairs would be 400 million rows, cost a bin."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.uniform(0, 0.99, (20_000, 2)), r.normal(20, 1.0, (300, 2))])
    got = density.binned_peaks(table(spark, x), ["x0", "x1"], "id", 1.0, 2.0, radius=5.0, min_size=50).groupBy("label").count().toPandas()
    assert sorted(got.loc[got["label"] >= 0, "count"])[-1] == 20_000 and len(got) in (2, 3)


def test_shares_and_triage(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 2, (400, 2)), r.normal(25, 2, (400, 2))])
    amp = np.where(np.arange(800) % 2 == 0, 5.0, 20.0)
    got = density.binned_peaks(table(spark, x, amp=amp), ["x0", "x1"], "id", 1.0, 2.0, radius=6.0, min_size=20, drop=0.25, amplitude="amp", spared=10.0).toPandas()
    full, _ = plain_peaks(x, 1.0, (2.0, None), radius=6.0, min_size=20)
    lost = got.set_index("id").loc[np.arange(800)]["label"].to_numpy() != full
    assert not lost[amp >= 10].any() and 0.1 < lost[amp < 10].mean() < 0.35
    sites = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0)], "px double, pz double")
    kept = {g.id for g in density.triaged(table(spark, x, amp=amp), sites, ["x0", "x1"], ["px", "pz"], "amp", "id", 10.0, 12.0).collect()}
    assert all(i in kept for i in range(800) if amp[i] >= 10) and not any(i in kept for i in range(400, 800) if amp[i] < 10 and np.hypot(*(x[i] - [0, 5])) > 12 and np.hypot(*x[i]) > 12)
    assert 0.5 < np.mean([i in kept for i in range(0, 400, 2)]) < 0.98


def test_binned_query(spark):
    got = catalogue.QUERIES["binned_peaks"](spark, SF).toPandas().sort_values("id")
    part = spark.read.parquet(f"{SF}/part.parquet").toPandas().sort_values("p_partkey")
    x = np.stack([part["p_size"].astype(float), (part["p_retailprice"].astype(float) - 900) / 4], 1)
    want, d = plain_peaks(x, 1.0, (1.5, 6.0), (3.0, 12.0), x[:, 1] / 10, (5.0, 15.0), 4.0, 5)
    first = part["p_partkey"].to_numpy()
    assert (got["label"].to_numpy() == np.where(want >= 0, first[np.maximum(want, 0)], -1)).all() and np.allclose(got["density"], d, atol=2e-6)


def test_dipoles(spark):
    """Places and moments of drawn dipoles; a point source's projection distance is the larger one."""
    r = np.random.default_rng(3)
    gx, gz = np.tile([0.0, 16.0, 32.0, 48.0], 10), np.repeat(np.arange(10) * 15.0, 4)
    n = 60
    p = np.stack([r.uniform(5, 43, n), r.uniform(15, 35, n), r.uniform(35, 100, n)], 1)
    m = r.normal(size=(n, 3)) * 1e4 + np.array([0, 4e4, 0])
    d = p[:, None] - np.stack([gx, np.zeros(40), gz], 1)[None]
    amp = np.einsum("nci,ni->nc", d / np.sqrt((d**2).sum(2, keepdims=True)) ** 3, m)
    rows = [(i, a.tolist(), gx.tolist(), gz.tolist()) for i, a in enumerate(amp)] + [(n, None, None, None), (n + 1, [1.0] * 5, [0.0] * 5, [0.0] * 5)]
    got = locate.localize(spark.createDataFrame(rows, "id long, amp array<double>, xs array<double>, zs array<double>"), "id", kind="dipole").toPandas().sort_values("id")
    assert got[["x", "my", "mse", "projection"]].isna().all(axis=1).tolist() == [False] * n + [True] * 2
    own = got.iloc[:n][["x", "y", "z", "mx", "my", "mz"]].astype(float).to_numpy()
    close = np.abs(own[:, :3] - p).max(1) < 3
    assert close.mean() > 0.95 and np.allclose(own[close][:, 3:], m[close], rtol=0.2, atol=3e3)


def test_dipoles_query(spark):
    """On a whole table: never worse than no source at all, and a moment's fit is that of least squares at its place."""
    got = catalogue.QUERIES["dipoles"](spark, SF).toPandas().set_index("vec_id")
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    a = np.abs(np.stack(e["embedding"]).astype(float))
    g = np.stack([(np.arange(64) % 4) * 16.0, np.zeros(64), (np.arange(64) // 4) * 20.0], 1)
    for k in range(0, len(e), 7):
        r = got.loc[e["vec_id"][k]]
        d = np.array([r["x"], r["y"], r["z"]], float) - g
        q = d / (d**2).sum(1, keepdims=True) ** 1.5
        best = ((a[k] - q @ np.linalg.lstsq(q, a[k], rcond=None)[0]) ** 2).mean()
        assert r["mse"] <= (a[k] ** 2).mean() and abs(r["mse"] - best) < 0.01 * best


def test_priors_of_detection():
    r = np.random.default_rng(4)
    root = r.normal(size=(6, 6)) * 0.4 + np.eye(6)
    noise = embedded.EmbeddedNoise(np.zeros((2, 3)), "full", (root @ root.T,))
    x = r.normal(size=(400_000, 6)) @ root.T
    t = r.normal(size=(4, 2, 3))
    t[3] = 0
    for k, got in enumerate(np.exp(noise.detection_prior(t, 1.0))[:3]):
        flat = t[k].ravel()
        drop = (x**2).sum(1) - ((x - flat) ** 2).sum(1)
        assert abs(got - (drop > 1.0).mean()) < 0.01
    assert noise.detection_prior(t, 1.0)[3] == -np.inf
    norms = np.sqrt((x.reshape(-1, 2, 3) ** 2).sum(1))
    assert np.allclose(np.exp(noise.channel_prior(2.5)), (norms > 2.5).mean(0), atol=0.01)
    for channels in ([0], [0, 2], [0, 1, 2]):
        assert abs(np.exp(noise.greatest_prior(2.5, channels)) - (norms[:, channels].max(1) > 2.5).mean()) < 0.01
    six = embedded.EmbeddedNoise(np.zeros((1, 6)), "full", (root @ root.T,))
    assert abs(np.exp(six.greatest_prior(1.5)) - (np.abs(x).max(1) > 1.5).mean()) < 0.01


@pytest.mark.parametrize("z", [-3.0, 0.0, 2.0, 8.0, 24.0, 26.0, 60.0])
def test_log_tail(z):
    terms = -0.5 * z * z - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / z**2 + 3 / z**4 - 15 / z**6) if z > 20 else math.log(0.5 * math.erfc(z / math.sqrt(2)))
    assert abs(embedded.log_tail(np.array([z]))[0] - terms) < 1e-6 * max(1, abs(terms)) and embedded.log_tail(np.array([np.inf]))[0] == -np.inf


def test_prior_in_a_mixture(spark):
    """The less likely noise is detected as a row was, the larger the noise's share."""
    m = refine.Model(np.array([[0.0, 0.0]]), np.array([0.5, 0.5]), 1.0, 0.02)
    rows = spark.createDataFrame([(i, [1.5, 0.5], z) for i, z in enumerate([None, 0.0, -1.0, -6.0])], "id long, v array<double>, z double")
    got = refine.assigned(rows, "v", m, "id", noise_prior="z").toPandas().sort_values("id")
    own, noise = 0.5 * np.exp(-1.25) / (2 * np.pi), 0.5 * 0.02
    want = [max(own, noise * np.exp(-z)) / (own + noise * np.exp(-z)) for z in (0, 0, -1, -6)]
    assert got["label"].tolist() == [0, 0, 0 if own > noise * np.e else -1, -1] and np.allclose(got["r"], want)
