"""The mixture of low-rank components with missing entries against dense normal densities, and on drawn mixtures."""

import numpy as np
import pytest
from spindrift.operators import factors

DIMS = 6
SEEN = [np.arange(6), np.array([0, 1, 2, 3]), np.array([2, 3, 4, 5])]


def drawn(n, means, bases, seed=0, noise=None):
    r = np.random.default_rng(seed)
    noise = np.eye(DIMS) if noise is None else noise
    unit = r.integers(0, len(means), n)
    x = means[unit] + np.einsum("nij,nj->ni", bases[unit], r.normal(size=(n, bases.shape[2]))) + r.normal(size=(n, DIMS)) @ np.linalg.cholesky(noise).T
    return unit, r.integers(0, len(SEEN), n), x


def frame(spark, unit, hood, x, ids=None):
    return spark.createDataFrame([(i, int(u), int(h), v[SEEN[h]].tolist()) for i, (u, h, v) in enumerate(zip(unit, hood, x))], "spike_id long, label int, hood int, v array<double>").repartition(3, "spike_id")


def truth(seed=3, rank=1):
    r = np.random.default_rng(seed)
    means = 9 * np.array([[1, 1, 1, 1, 1, 1], [1, -1, 1, -1, 1, -1], [-1, -1, -1, -1, -1, -1.0]])
    a = r.normal(size=(DIMS, DIMS)) * 0.2
    return means, r.normal(size=(3, DIMS, rank)), np.eye(DIMS) + a @ a.T


def dense(x, mean, cov):
    d = x - mean
    return -0.5 * ((d @ np.linalg.inv(cov) * d).sum(1) + np.linalg.slogdet(cov)[1] + len(mean) * np.log(2 * np.pi))


@pytest.mark.parametrize("rank", [0, 1, 2])
def test_likelihood_is_the_dense_one(rank):
    means, bases, noise = truth(rank=rank)
    m = factors.Factors(means, bases, np.array([0.3, 0.3, 0.3, 0.1]), noise, SEEN, [np.arange(3)] * 3)
    _, _, x = drawn(20, means, bases, noise=noise)
    for h, at in enumerate(SEEN):
        got = m.view(h).log_likelihoods(x[:, at])
        for u in range(3):
            cov = (noise + bases[u] @ bases[u].T)[np.ix_(at, at)]
            assert np.allclose(got[:, u], np.log(0.3) + dense(x[:, at], means[u][at], cov))
        assert np.allclose(got[:, 3], np.log(0.1) + dense(x[:, at], np.zeros(len(at)), noise[np.ix_(at, at)]))


def test_sums_against_plain_expectations(spark):
    means, bases, noise = truth(rank=2)
    m = factors.Factors(means, bases, np.array([0.3, 0.3, 0.3, 0.1]), noise, SEEN, [np.arange(3)] * 3)
    unit, hood, x = drawn(60, means * 0.2, bases, 5, noise)
    xz, zz, weight, (evidence, _, n) = factors.sums(frame(spark, unit, hood, x), m, top=2)
    want_xz, want_zz, want_noise, want_lse = np.zeros_like(xz), np.zeros_like(zz), 0.0, 0.0
    for h, v in zip(hood, x):
        at = SEEN[h]
        ll = np.array([np.log(0.3) + dense(v[None, at], means[u][at], (noise + bases[u] @ bases[u].T)[np.ix_(at, at)])[0] for u in range(3)] + [np.log(0.1) + dense(v[None, at], np.zeros(len(at)), noise[np.ix_(at, at)])[0]])
        ll[np.argsort(ll[:3])[0]] = -np.inf
        r = np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum()
        want_lse += ll.max() + np.log(np.exp(ll - ll.max()).sum())
        want_noise += r[3]
        for u in range(3):
            # the joint normal of (z, all entries) given those seen
            joint = np.block([[np.eye(2), bases[u].T], [bases[u], noise + bases[u] @ bases[u].T]])
            o = 2 + at
            gain = joint[:, o] @ np.linalg.inv(joint[np.ix_(o, o)])
            mean = np.concatenate([np.zeros(2), means[u]]) + gain @ (v[at] - means[u][at])
            second = joint - gain @ joint[o] + np.outer(mean, mean)
            z = np.append(mean[:2], 1)
            zz_ = np.outer(z, z)
            zz_[:2, :2] = second[:2, :2]
            want_zz[u] += r[u] * zz_
            want_xz[u] += r[u] * np.concatenate([second[2:, :2], mean[2:, None]], 1)
    assert n == 60 and abs(evidence - want_lse) < 1e-6 and abs(weight - want_noise) < 1e-9
    assert np.allclose(xz, want_xz) and np.allclose(zz, want_zz)


def test_fit_rises_and_labels_are_found(spark):
    means, bases, noise = truth()
    unit, hood, x = drawn(600, means, bases, 1, noise)
    given = np.where(np.random.default_rng(2).random(600) < 0.2, (unit + 1) % 3, unit)
    rows = frame(spark, given, hood, x).cache()
    first = factors.start(rows, 3, 1, noise, SEEN, relabel=True)
    m, seen = factors.fit(rows, first, steps=8, tolerance=1e-9)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and len(m.means) == 3
    got = {r.spike_id: r for r in factors.score(rows, m).collect()}
    assert np.mean([got[i].unit == unit[i] for i in range(600)]) >= 0.995
    one = got[0]
    assert abs(sum(c.r for c in one.cand) + one.noise_r - 1) < 1e-9 and one.score == one.cand[0].ll
    assert np.abs(m.means - means).max() < 0.8


def test_split_merge_remove(spark, tmp_path):
    means, bases, noise = truth()
    unit, hood, x = drawn(600, means, bases * 0.3, 4, noise)
    rows = frame(spark, np.where(unit == 2, 2, 0), hood, x).cache()
    train, held = rows.where("spike_id % 4 != 0"), rows.where("spike_id % 4 = 0")
    wrong = factors.start(train, 3, 1, noise, SEEN)
    assert len(wrong.means) == 2
    m = factors.demix(train, held, wrong, 0.5, rounds=2, steps=6, folder=str(tmp_path))
    lab = np.array([r.unit for r in factors.score(rows, m).orderBy("spike_id").collect()])
    assert len(m.means) == 3 and all(len(set(lab[(unit == u) & (lab >= 0)])) == 1 for u in range(3)) and len({lab[unit == u][0] for u in range(3)}) == 3
    back = factors.load(spark, f"{tmp_path}/last.npz")
    assert np.array_equal(back.means, m.means) and all(np.array_equal(a, b) for a, b in zip(back.seen, m.seen))
    # one unit cut in two by its labels is made whole, and a unit that nothing is like goes
    double = factors.start(frame(spark, np.where(unit == 0, np.arange(600) % 2 * 3, unit), hood, x), 4, 1, noise, SEEN)
    assert len(factors.merge(held, double, 0.5).means) == 3
    more = factors.Factors(np.concatenate([m.means, m.means[:1] * 0.1 + 40]), np.concatenate([m.bases, m.bases[:1]]), np.append(m.proportions[:-1], [0.05, m.proportions[-1]]), noise, SEEN, [np.arange(4)] * 3)
    assert len(factors.remove(held, more).means) in (3, 4)


def test_cases(spark):
    means, bases, noise = truth()
    m = factors.Factors(means, bases, np.array([0.3, 0.3, 0.3, 0.1]), noise, SEEN, [np.arange(3)] * 3)
    rows = spark.createDataFrame([(0, 0, means[1].tolist()), (1, 0, None), (2, None, [1.0]), (3, 1, [1.0]), (4, 9, [1.0]), (5, 0, [float("nan")] * 6), (6, 0, [0.0] * 6)], "spike_id long, hood int, v array<double>")
    got = {r.spike_id: r for r in factors.score(rows, m, top=9).collect()}
    assert [got[i].unit for i in range(7)] == [1, -1, -1, -1, -1, -1, -1] and got[1].score is None and got[6].score == got[6].noise_ll
    assert factors.score(rows.where("false"), m).count() == 0
    same, seen = factors.fit(rows.where("false"), m)
    assert same is m and np.isnan(seen[0])
    assert factors.unit_distances(m, "cosine")[0, 2] == pytest.approx(2) and factors.unit_distances(m)[0, 0] == pytest.approx(0, abs=1e-6)


def test_blocks_of_queries_agree(spark):
    from spindrift.operators import distances

    x = np.random.default_rng(7).normal(size=(60, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    one = distances.top_cosine(rows, rows.where("id % 5 = 0"), "id", 3)
    many = distances.top_cosine(rows, rows.where("id % 5 = 0"), "id", 3, block_bytes=300)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 36
    assert distances.top_cosine(rows, rows.where("false"), "id", 3).count() == 0


def test_mixture_of_nothing(spark):
    from spindrift.operators import cluster

    mu, _, _, elbo = cluster.mixture(spark.createDataFrame([], "v array<double>"), "v", 2, np.zeros((2, 2)))
    assert elbo == [] and mu.shape == (2, 2)
