"""Reports, partial peeling, interpolation, template libraries, candidate pools, and the queries that have no SQL against plain restatements."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from spindrift.operators import candidates, factors, interpolate, library, motion, phases, recordings, simulate
from spindrift.plans import model_queries
from spindrift.plans.noise_queries import mean_templates
from spindrift.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_report(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    x[500, 1] = 50.0
    rows = spark.createDataFrame([(t, c, float(v)) for t, row in enumerate(x) for c, v in enumerate(row)], "t long, channel int, v double")
    got = recordings.report(rows, 1000, 1000.0).first()
    assert got.detections == 0.5 and got.largest == 50.0 and got.too_few and not got.too_many and not got.too_large and not got.odd_std
    assert abs(got.std - 1.4826 * np.mean([np.median(np.abs(x[:1000])), np.median(np.abs(x[1000:]))])) < 1e-9
    assert recordings.report(rows, 1000, 1000.0, chunks=[1]).first().detections == 0.0
    loud = recordings.report(rows.withColumn("v", F.col("v") * 1e4), 1000, 1000.0).first()
    assert loud.too_large and loud.odd_std
    near = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "channel int, neighbor int")
    assert recordings.report(rows, 1000, 1000.0, threshold=0.5, neighbours=near).first().detections < recordings.report(rows, 1000, 1000.0, threshold=0.5).first().detections
    assert recordings.report(rows.where("false"), 1000, 1000.0).first().detections is None


def test_partial_peeling_and_residual(spark):
    rows = spark.range(100).select(F.col("id").alias("t"), F.lit(0).alias("channel"), F.col("id").cast("double").alias("v"))

    def fn(pdf):
        own = pdf[pdf["core"]]
        return pd.DataFrame({"chunk": own["chunk"], "t": own["t"], "n": len(pdf)})

    schema = "chunk long, t long, n long"
    got = recordings.peel_some(rows, 10, 2, fn, schema, [0, 4]).collect()
    assert {r.chunk: r.n for r in got} == {0: 12, 4: 14} and len(got) == 20
    some = recordings.peel_some(rows, 10, 2, fn, schema, list(range(10)), stop_after=35, at_once=2, seed=1).collect()
    assert len(some) == 60 and len({r.chunk for r in some}) == 6
    assert recordings.peel_some(rows, 10, 2, fn, schema, [], stop_after=5).count() == 0
    templates = spark.createDataFrame([(1, 0, [1.0, 2.0, 1.0])], "unit int, channel int, v array<double>")
    spikes = spark.createDataFrame([(1, 20, 1.5), (1, 50, 1.0)], "label int, t long, scale double")
    left = recordings.residual(simulate.inject(rows, spikes, templates, 1), spikes, templates, 1)
    assert {r.t: r.v for r in left.collect()} == {t: float(t) for t in range(100)}
    assert [recordings.next_margin(n) for n in (0, 1, 10, 10.5)] == [0, 10, 10, 20]


def test_grids_folders_units(spark, tmp_path):
    got = recordings.settings_grid({"a": 1}, "run", bad={".1": {"b": 0.1}, ".2": {"b": 0.2}}, crit={"x": {"c": "x", "a": 2}, "y": {"c": "y"}})
    assert got == {"run_bad.1_critx": {"a": 2, "b": 0.1, "c": "x"}, "run_bad.1_crity": {"a": 1, "b": 0.1, "c": "y"}, "run_bad.2_critx": {"a": 2, "b": 0.2, "c": "x"}, "run_bad.2_crity": {"a": 1, "b": 0.2, "c": "y"}}
    assert list(recordings.settings_grid(make=lambda b: b + 1, k={"1": {"b": 1}}).values()) == [2]
    places = spark.createDataFrame([(0, 1.0, 0.0, 5.0), (1, 2.0, 0.0, 6.0)], "unit int, x double, y double, z double")
    temps = spark.createDataFrame([(0, c, s, float(c * s)) for c in range(2) for s in range(3)], "unit int, channel int, sample int, v double")
    spikes = spark.createDataFrame([(0, 5), (0, 9)], "label int, t long")
    info = {r.unit: r for r in recordings.unit_information(spikes, temps, places, 2.0).collect()}
    assert (info[0].amplitude, info[0].n, info[0].rate, info[0].norm) == (2.0, 2, 1.0, pytest.approx(np.sqrt(5))) and (info[1].n, info[1].amplitude) == (0, None)
    recordings.save_simulation(str(tmp_path), spikes=spikes, places=places)
    back = recordings.load_simulation(spark, str(tmp_path), ["spikes", "places"])
    assert back["spikes"].count() == 2 and back["places"].schema == places.schema


def test_interpolation(spark):
    r = np.random.default_rng(1)
    places = np.stack([np.tile([0.0, 30.0], 5), 15.0 * np.arange(10)], 1)
    seen, targets = [np.arange(6), np.arange(3, 10)], [np.array([1, 2, 3]), np.array([5, 6])]
    x = [r.normal(size=(len(seen[i % 2]), 2)) for i in range(8)]
    rows = spark.createDataFrame([(i, i % 2, float(i // 4) * 5, v.ravel().tolist()) for i, v in enumerate(x)] + [(8, 0, 0.0, None), (9, 7, 0.0, [1.0]), (10, 1, 0.0, [1.0])], "id long, hood int, shift double, v array<double>")
    for kind in ("thinplate", "rbf", "nearest"):
        got = {q.id: q["at"] for q in interpolate.interpolated(rows, places, seen, places, targets, 2, kind, shift="shift").collect()}
        for i, v in enumerate(x):
            m = motion.interpolation(places[seen[i % 2]] + [0, (i // 4) * 5.0], places[targets[i % 2]], kind, 20.0, 1)
            assert np.allclose(got[i], (m @ v).ravel())
        assert got[8] is None and got[9] is None and got[10] is None
    # linear fields come out exactly, there and back
    lin = spark.createDataFrame([(0, 0, 7.0, (2 * places[:, 1] + places[:, 0]).tolist())], "id long, hood int, shift double, v array<double>")
    full = interpolate.to_full(lin, places, [np.arange(10)], places, 1, shift="shift", to="v2").first()["v2"]
    assert np.allclose(full, 2 * (places[:, 1] - 7) + places[:, 0])
    there = spark.createDataFrame([(0, 0, 7.0, full)], "id long, hood int, shift double, v array<double>")
    back = interpolate.from_full(there, places, places, 1).first()["at"]
    assert np.allclose(back, 2 * places[:, 1] + places[:, 0])
    cut = interpolate.interpolated(lin, places, [np.arange(10)], places, [np.arange(10)], 1, shift="shift", outside=False).first()["at"]
    assert cut[0] is None and cut[1] is None and cut[5] is not None
    a = r.normal(size=(20, 20))
    cov, mean = a @ a.T + np.eye(20), r.normal(size=(10, 2))
    got = {q.id: q for q in interpolate.imputed(rows, mean, cov, seen, targets, 2).collect()}
    for i, v in enumerate(x):
        o = (seen[i % 2][:, None] * 2 + np.arange(2)).ravel()
        t = (targets[i % 2][:, None] * 2 + np.arange(2)).ravel()
        want = mean.ravel()[t] + cov[np.ix_(t, o)] @ np.linalg.inv(cov[np.ix_(o, o)]) @ (v.ravel() - mean.ravel()[o])
        assert np.allclose(got[i]["at"], want) and got[i].v == v.ravel().tolist()
    assert got[8]["at"] is None and got[10]["at"] is None


def test_sets_at_a_shift(spark):
    line = lambda n, name: spark.createDataFrame([(i, 0.0, 10.0 * i) for i in range(n)], f"{name} int, x double, z double")
    index = spark.createDataFrame([(c, k, c + o if 0 <= c + o < 4 else None) for c in range(4) for k, o in enumerate((-1, 0, 1))], "channel int, slot int, neighbor int")
    spikes = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 2, 0), (3, 0, 0)], "spike_id long, channel int, shift int")
    known, rows = interpolate.stable_sets(spikes, index, line(4, "channel"), line(6, "reg_channel"), 10.0)
    sets = {r.hood: list(r.channels) for r in known.collect()}
    assert {r.spike_id: sets[r.hood] for r in rows.collect()} == {0: [0, 1, 2], 1: [1, 2, 3], 2: [1, 2, 3], 3: [0, 1]}
    at = {r.channel: sets.get(r.hood) for r in interpolate.hoods_at(known, index, line(4, "channel"), line(6, "reg_channel"), 10.0, 1).collect()}
    assert at == {0: None, 1: [1, 2, 3], 2: None, 3: None}


def test_library(spark):
    r = np.random.default_rng(2)
    t = np.arange(16)
    wave = lambda at, w: -np.exp(-((t - at) ** 2) / w)
    base = {0: np.concatenate([9 * wave(8, 4), 2 * wave(8, 4)]), 1: np.concatenate([9 * wave(6, 4), 2 * wave(6, 4)]), 2: np.concatenate([1 * wave(8, 4), 9 * wave(8, 4)]), 3: np.zeros(32), 4: np.concatenate([9 * wave(8, 4), 0 * t])}
    counts, depth = {0: 30, 1: 30, 2: 30, 3: 30, 4: 2}, {0: 50.0, 1: 50.0, 2: 10.0, 3: 0.0, 4: 0.0}
    data = [(u, (base[u] + 0.1 * r.normal(size=32)).tolist(), depth[u]) for u in base for _ in range(counts[u])]
    spikes = spark.createDataFrame([(i, 1000 * i, u, v, z) for i, (u, v, z) in enumerate(data)], "spike_id long, t long, label int, v array<double>, z double")
    got = library.library(spikes, 16, 8, 5, 20.0, 0.25, 3).collect()
    where = {}
    for q in got:
        where.setdefault(data[q.spike_id][0], set()).add(q.unit)
    assert where == {0: {1}, 1: {1}, 2: {0}} and len(got) == 90
    moved = {data[q.spike_id][0]: q.t - 1000 * q.spike_id for q in got}
    assert moved[0] - moved[1] in (0, 2) and moved[2] == 0


def test_lags_and_bases(spark):
    r = np.random.default_rng(3)
    smooth = np.convolve(r.normal(size=60), np.ones(5) / 5, "same")[:, None] * np.array([1.0, 0.5])
    true = np.array([0, 3, -2, 1])
    shapes = np.stack([smooth[20 + s : 45 + s] for s in -true])
    pairs = [(p.i, p.j, p.lag, p["corr"]) for p in library.pair_lags(spark, shapes, 6).collect()]
    assert pairs and all(lag == true[j] - true[i] for i, j, lag, _ in pairs)
    got = library.solved_shifts(pairs, 4)
    assert np.array_equal(got - got[0], true - true[0])
    assert library.solved_shifts([], 2, np.array([4.0, -1.0])).tolist() == [4, -1]
    x = r.normal(size=(200, 6)) * np.array([5, 3, 1, 1, 0.5, 0.1])
    rows = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>")
    own = np.linalg.svd(x, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(np.sum(library.basis_of(rows, 2) * own, 1)), 1)
    mean, basis = library.basis_of_templates(r.normal(size=(5, 12, 3)) * 4, 4)
    assert np.allclose(basis @ basis.T, np.eye(len(basis))) and mean.shape == (12,)
    assert library.basis_of_templates(np.zeros((2, 5, 1)), 3)[1].shape == (0, 5)


def test_first_candidates(spark):
    allowed = spark.createDataFrame([(u, h) for h in (0, 1) for u in range(4 if h == 0 else 1)], "unit long, neighborhood long")
    rows = spark.createDataFrame([(i, i % 4 if i % 3 else 0, 0 if i % 3 else 1) for i in range(60)] + [(60, 2, 9)], "spike_id long, label int, neighborhood long")
    got = {r.spike_id: list(r.cand) for r in candidates.first_candidates(rows, allowed, 3, seed=1).collect()}
    for r in rows.collect():
        c = got[r.spike_id]
        assert len(c) == 3 and c[0] == r.label
        if r.neighborhood == 0:
            assert len(set(c)) == 3 and set(c) <= set(range(4))
        else:
            assert c[1:] == [-1, -1]
    assert len({tuple(c) for i, c in got.items() if i % 3}) > 4
    assert got == {r.spike_id: list(r.cand) for r in candidates.first_candidates(rows.repartition(5), allowed, 3, seed=1).collect()}


def test_phase_matches_query(spark):
    """One pursuit over the whole recording agrees with the chunks."""
    shapes, units = mean_templates(spark, SF)
    e = table(spark, SF, "embeddings").orderBy("vec_id").toPandas()
    x = np.zeros((16 * (int(e["vec_id"].max()) + 1), 4))
    for i, v in zip(e["vec_id"], e["embedding"]):
        x[16 * i : 16 * i + 16] = np.asarray(v, float).reshape(4, 16).T
    find = phases.Pursuit(phases.Bank.of(shapes, units, 8, 4, 4), float(np.median(np.sqrt((shapes**2).sum((1, 2))))) / 2, passes=2)
    want = {(t, u, p): o for t, u, p, o, _ in find.run(x)}
    got = {(r.t, r.unit, r.phase): r.objective for r in model_queries.phase_matches(spark, SF).collect()}
    assert len(got) > 50 and len(set(want) & set(got)) >= 0.98 * max(len(want), len(got))


def test_lowrank_mixture_query(spark):
    """Scores against dense normal densities of the fitted model."""
    m = model_queries.mixture_of(spark, SF)
    rows = {r.vec_id: r for r in model_queries.partly_seen(spark, SF).collect()}
    got = {r.vec_id: r for r in factors.score(model_queries.partly_seen(spark, SF).select("vec_id", "hood", "v"), m).collect()}
    assert set(rows) == set(got)
    for i, r in list(rows.items())[:60]:
        at, x = m.seen[r.hood], np.asarray(r.v)
        ll = {-1: np.log(m.proportions[-1]) + dense(x, np.zeros(len(at)), m.noise[np.ix_(at, at)])}
        for u in m.allowed[r.hood]:
            ll[int(u)] = np.log(m.proportions[u]) + dense(x, m.means[u][at], (m.noise + m.bases[u] @ m.bases[u].T)[np.ix_(at, at)])
        assert abs(got[i].score - max(ll.values())) < 1e-6 and abs(ll[got[i].unit] - max(ll.values())) < 1e-6


def dense(x, mean, cov):
    d = x - mean
    return -0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1] + len(d) * np.log(2 * np.pi))
