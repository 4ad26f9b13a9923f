"""Phases, products and pursuit against direct sums, on recordings made of known spikes."""

import numpy as np
import pytest
from spindrift.operators import phases


def templates(k=3, length=21, channels=4, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(length)
    shape = np.stack([np.exp(-((t - 8 - i) ** 2) / (6 + 3 * i)) - 0.6 * np.exp(-((t - 13) ** 2) / (10 + 4 * i)) for i in range(k)])
    return 8 * shape[:, :, None] * r.uniform(0.2, 1, (k, 1, channels))


def trace(bank, spikes, n=600, noise=0.0, seed=0):
    x = noise * np.random.default_rng(seed).normal(size=(n, bank.spatial.shape[2]))
    for at, u, p, s in spikes:
        x[at : at + bank.length] += s * bank.full(u, p)
    return x


def test_phases_and_products():
    x = np.sin(np.arange(40) / 4.0)
    got = phases.delayed(x, 4)
    assert np.array_equal(got[0], x) and np.abs(got[1][4:-4] - np.sin((np.arange(40) - 0.25) / 4.0)[4:-4]).max() < 2e-3
    assert all(phases.cubic_taps(f).sum() == pytest.approx(1) for f in (0, 0.3, 1))
    r = np.random.default_rng(1)
    a, b = r.normal(size=(3, 100)), r.normal(size=(3, 7))
    assert np.allclose(phases.overlap_correlate(a, b, 16), [np.correlate(i, j, "valid") for i, j in zip(a, b)])
    assert phases.overlap_correlate(a[:, :3], b).shape == (3, 0)
    t = r.normal(size=(3, 9, 4))
    bank = phases.Bank.of(t, [5, 6, 7], 4, rank=4, phases=2)
    assert np.allclose(bank.full(1), t[1]) and np.allclose(bank.squares()[:, 0], (t**2).sum((1, 2)))
    x = r.normal(size=(30, 4))
    assert np.allclose(bank.products(x), [[(x[i : i + 9] * t[k]).sum() for i in range(22)] for k in range(3)])
    for p in range(2):
        got = phases.pair_products(bank, 0, 2)[p]
        y = np.zeros((25, 4))
        y[8:17] = bank.full(2, p)
        assert np.allclose(got, [(y[i : i + 9] * t[0]).sum() for i in range(17)])
    far = phases.Bank.of(np.concatenate([np.pad(t[:1], ((0, 0), (0, 0), (0, 4))), np.pad(t[1:2], ((0, 0), (0, 0), (4, 0)))]), [0, 1], 4)
    assert phases.pair_products(far, 0, 1, 1e-9) is None


def test_pursuit_leaves_no_residual():
    bank = phases.Bank.of(templates(), [3, 4, 5], 8, phases=4)
    spikes = [(20, 0, 1, 1.0), (80, 1, 0, 1.0), (110, 2, 3, 1.0), (200, 0, 2, 1.0), (300, 1, 3, 1.0), (400, 2, 0, 1.0)]
    find = phases.Pursuit(bank, 3.0)
    x = trace(bank, spikes)
    got = find.run(x)
    assert [(t - 8, u - 3, p) for t, u, p, _, _ in got] == [s[:3] for s in spikes]
    assert np.abs(find.x).max() < 1e-9 and np.allclose(find.cleaned()[0], bank.full(0, 1))
    # products kept up by pairs are the residual's own
    assert np.allclose(find.conv, bank.products(find.x))
    free = phases.Pursuit(bank, 3.0, scale_sd=0.5)
    scaled = free.run(trace(bank, [(50, 0, 0, 1.2), (150, 1, 0, 0.8)]))
    assert [round(s[4], 1) for s in scaled] == [1.2, 0.8]
    assert find.run(np.zeros((5, 4))) == [] and find.run(np.zeros((100, 4))) == []


def test_passes_lower_the_residual():
    bank = phases.Bank.of(templates(5, seed=2), list(range(5)), 8, phases=4)
    r, better = np.random.default_rng(3), 0
    for _ in range(12):
        a, b = r.integers(0, 5, 2)
        x = trace(bank, [(60, a, r.integers(4), 1.0), (60 + r.integers(2, 9), b, r.integers(4), 1.0)], 150, 0.02, int(r.integers(99)))
        one, two = phases.Pursuit(bank, 2.0), phases.Pursuit(bank, 2.0, passes=6, reach=3)
        one.run(x)
        two.run(x)
        before, after = (one.x**2).sum(), (two.x**2).sum()
        assert after <= before + 1e-9 and np.allclose(two.conv, bank.products(two.x))
        better += after < before - 1e-6
    assert better > 0


def test_chunks_and_drift(spark):
    base = phases.Bank.of(templates(2, 11), [0, 1], 5, phases=2)
    spikes = [(30, 0, 1, 1.0), (95, 1, 0, 1.0), (160, 0, 0, 1.0), (230, 1, 1, 1.0)]
    x = trace(base, spikes, 300)
    rows = spark.createDataFrame([(t, c, float(v)) for t, row in enumerate(x) for c, v in enumerate(row)], "t long, channel int, v double")
    want = [(s[0] + 5, s[1], s[2]) for s in spikes]
    got = phases.match(rows, base, 3.0, 100).orderBy("t").collect()
    assert [(r.t, r.unit, r.phase) for r in got] == want and [r.chunk for r in got] == [t // 100 for t, _, _ in want]
    # the probe has moved by a channel from chunk 1 on: the recording's channel c shows the templates' channel c + 1
    moved = x.copy()
    moved[140:] = np.concatenate([x[140:, 1:], np.zeros((160, 1))], 1)
    rows = spark.createDataFrame([(t, c, float(v)) for t, row in enumerate(moved) for c, v in enumerate(row)], "t long, channel int, v double")
    got = phases.match(rows, base, 2.0, 140, lambda k: int(k > 0), {0: [0, 1, 2, 3], 1: [1, 2, 3, -1]}).orderBy("t").collect()
    assert [(r.t, r.unit, r.phase) for r in got] == want


def test_pairs_noise_and_basis(spark):
    bank = phases.Bank.of(templates(2, 11), [4, 9], 5, phases=2)
    table = phases.pair_table(spark, bank, 1e-9)
    got = {(r.a, r.b, r.phase, r.lag): r["product"] for r in table.collect()}
    want = phases.pair_products(bank, 0, 1)
    assert all(abs(got.get((4, 9, p, lag - 10), 0.0) - want[p, lag]) < 1e-9 for p in range(2) for lag in range(21))
    ask = spark.createDataFrame([(4, 9, 0, 0), (4, 9, 0, 99)], "a int, b int, phase int, lag int")
    assert [round(r["product"], 6) for r in phases.pair_shifts(ask, table).orderBy("lag").collect()] == [round(want[0, 10], 6), 0.0]

    def noise(n, seed):
        return np.random.default_rng(seed).normal(size=(n, 4))

    small = phases.Bank.of(0.2 * templates(2, 11), [4, 9], 5, phases=2)
    loud = phases.false_positives(spark, small, noise, 1.0, 4, 300)
    quiet = phases.false_positives(spark, small, noise, 30.0, 4, 300)
    find = phases.Pursuit(small, 1.0)
    assert loud.count() == sum(len(find.run(noise(300, i))) for i in range(4)) > 0 and quiet.count() == 0
    t = templates()
    basis = phases.shared_basis(t, 3)
    assert np.allclose(basis @ basis.T, np.eye(3)) and np.allclose(np.einsum("rt,krc->ktc", basis, phases.compressed(t, basis)), t)


def test_products_of_a_unit(spark):
    """All pairs of a unit at once are the pairs one by one, and what is held stays bounded without changing a result."""
    t = templates(5, seed=2)
    t[4, :, :3], t[3, :, 3:] = 0, 0
    bank = phases.Bank.of(t, list(range(5)), 8, phases=4)
    for b in range(5):
        others, table = phases.unit_products(bank, b, 1e-9)
        want = {a: got for a in range(5) if (got := phases.pair_products(bank, a, b, 1e-9)) is not None}
        assert others.tolist() == sorted(want) and all(np.allclose(table[i], want[a], atol=1e-10) for i, a in enumerate(others))
    x = np.random.default_rng(1).normal(0, 0.1, (600, t.shape[2]))
    for k, at in enumerate(range(40, 560, 37)):
        x[at : at + t.shape[1]] += t[k % 5]
    wide, narrow = phases.Pursuit(bank, 2.0, passes=3), phases.Pursuit(bank, 2.0, passes=3, held=1)
    assert wide.run(x) == narrow.run(x) and len(narrow.pairs) == 1 and len(wide.pairs) > 1
    table = phases.pair_table(spark, bank, 1e-9).groupBy("a", "b").count().collect()
    assert {(r.a, r.b) for r in table} == {(a, b) for a in range(5) for b in range(5) if phases.pair_products(bank, a, b, 1e-9) is not None}
