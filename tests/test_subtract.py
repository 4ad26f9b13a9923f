"""Subtraction, shaving and the fit of their denoiser on drawn recordings."""

import numpy as np
import pytest
from spindrift.operators import subtract
from spindrift.plans import catalogue

S = subtract.Settings(before=8, length=24, threshold=4.0, decrease=6.0, sign=-1, peak_radius=4, dedup_radius=6)
SHAPES = -np.stack([np.exp(-0.5 * ((np.arange(24) - 8) / w) ** 2) - 0.3 * np.exp(-0.5 * ((np.arange(24) - 14) / 3) ** 2) for w in (1.2, 2.0)])
N, C = 4000, 4
NEAR = [(c, n) for c in range(C) for n in range(C) if abs(c - n) <= 1]


def basis(shapes=SHAPES):
    q = np.linalg.qr(shapes.T)[0].T
    return subtract.Projection(q, np.zeros(24))


def drawn(seed=0, spikes=60, noise=0.3, heights=(8, 16)):
    """Samples (N, C) and the spikes in them (time, channel, height), no two within 30 samples."""
    r = np.random.default_rng(seed)
    x, out = r.normal(0, noise, (N, C)) if noise else np.zeros((N, C)), []
    for k, t in enumerate(np.linspace(60, N - 60, spikes).astype(int)):
        c, a = int(r.integers(C)), float(r.uniform(*heights))
        shape = SHAPES[k % 2]
        for n in range(C):
            x[t - 8 : t + 16, n] += shape * a * {0: 1.0, 1: 0.5}.get(abs(n - c), 0.0)
        out.append((int(t), c, a))
    return x, out


def frame(spark, x):
    return spark.createDataFrame([(t, c, float(x[t, c])) for t in range(len(x)) for c in range(x.shape[1])], "t long, channel int, v double")


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(NEAR, "channel int, neighbor int")


def dense(residual):
    pdf = residual.toPandas()
    x = np.full((N, C), np.nan)
    x[pdf["t"], pdf["channel"]] = pdf["v"]
    return x


def test_spikes_are_found_and_taken(spark, index):
    """Every spike at its time and channel, the residual is the noise, and it has lost exactly the decreases that are reported."""
    x, true = drawn()
    spikes, residual = subtract.subtract(frame(spark, x), index, basis(), S, chunk=1000)
    got = {(r.t, r.channel): r for r in spikes.collect()}
    assert {(t, c) for t, c, _ in true} <= {(t + d, c) for t, c in got for d in (-1, 0, 1)} and len(got) <= len(true) + 3
    left = dense(residual)
    assert not np.isnan(left).any() and left.std() < 0.36
    assert np.isclose((x**2).sum() - (left**2).sum(), sum(r.decrease for r in got.values()), rtol=0.02)
    for r in list(got.values())[:10]:
        clean = np.array(r.v).reshape(len(r.near), 24)
        assert np.abs(clean - x[r.t - 8 : r.t + 16, r.near].T).max() < 1e-9  # alone, a cleaned snippet is the samples themselves


def test_weak_spikes_are_put_back(spark, index):
    """What lowers the residual too little leaves it as it was, bit for bit; what is left over a strong subtraction is shaved once."""
    x, _ = drawn(1, 20, 0.0, (4.5, 5.0))
    spikes, residual = subtract.shave(frame(spark, x), index, basis(), subtract.Settings(**{**S.__dict__, "decrease": 100.0}), chunk=1000)
    assert spikes.count() == 0 and (dense(residual) == x).all()
    taken, after = subtract.shave(frame(spark, x), index, basis(), S, chunk=1000)
    assert taken.count() == 20 and np.abs(dense(after)).max() < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_norm_never_rises(seed):
    """Also with spikes on top of each other, each kept spike lowers the residual's square by its decrease."""
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.5, (1500, C))
    for t in r.integers(30, 1470, 120):
        x[t - 8 : t + 16] += SHAPES[r.integers(2)][:, None] * r.uniform(3, 20) * r.uniform(0, 1, C)
    near = [np.array([n for c, n in NEAR if c == k]) for k in range(C)]
    barred, norms = set(), [(x**2).sum()]
    for _ in range(S.rounds):
        kept = subtract.one_round(x, S, near, basis(), barred)
        norms.append((x**2).sum())
        assert np.isclose(norms[-2] - norms[-1], sum(k[3] for k in kept)) and all(k[3] > S.decrease**2 for k in kept)
        if not kept:
            break
    assert len(norms) > 2 and (np.diff(norms) <= 1e-9).all()


def test_realigned():
    """A spike detected off its trough goes to where its denoised snippet has it."""
    shape = SHAPES[0]
    x = np.zeros((200, 1))
    x[92:116, 0] = shape * 10
    x[101, 0] = -10.5  # a sample of noise beside the trough at 100
    s = subtract.Settings(**{**S.__dict__, "realign": 2})
    at = lambda s: [k[0] for k in subtract.one_round(x.copy(), s, [np.array([0])], subtract.Pursuit(np.stack([np.roll(shape, k) for k in (-1, 0, 1)])), set())]
    assert at(S)[0] == 101 and at(s) == [100]


def test_fit_finds_the_shapes(spark, index, tmp_path):
    """The fitted basis spans the drawn shapes; a second run reads it; rounds stop once it stays the same."""
    x, _ = drawn(3, 70, 0.2)
    samples = frame(spark, x)
    found, turned = subtract.fit(samples, index, 2, S, chunk=1000, enough=60, folder=str(tmp_path), tol=0.2)
    assert subtract.angle(found.components, basis().components) < 0.15 and turned[-1] < 0.2
    again, same = subtract.fit(samples.limit(0), index, 2, S, chunk=1000, chunks=[0], folder=str(tmp_path), tol=0.2)
    assert np.allclose(again.components, found.components) and np.allclose(same, turned)
    spikes, _ = subtract.subtract(samples, index, found, S, chunk=1000)
    assert abs(spikes.count() - 70) <= 4


def test_empty(spark, index):
    spikes, residual = subtract.subtract(frame(spark, np.zeros((0, C))), index, basis(), S)
    assert spikes.count() == 0 and residual.count() == 0


def test_query(spark):
    """On a whole table: what is taken and what is left add up to the samples' square."""
    got = catalogue.QUERIES["shaved_embeddings"](spark, "/root/testdata/sf0.001").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(got) == -(-rows * 16 // 1600) and got["spikes"].sum() > 100
    assert np.allclose(got["before"] - got["after"], got["decrease"], rtol=1e-6) and (got["after"] <= got["before"]).all()
