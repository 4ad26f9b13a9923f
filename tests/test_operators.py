"""Operators on literal tables with known results, and against plain restatements of their rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from spindrift.operators import cluster, compare, density, detect, graph, joins, labels, motion, soft, trains
from spindrift.session import ship


def test_deduplicate_literal(spark):
    ship(spark)
    t = [1000, 1100, 1200, 2000, 2000, 2100, 3000, 3009, 3100]
    rows = [(i, x, i // 3, s) for i, (x, s) in enumerate(zip(t, [2.0, 2, 2, 2, 0, 2, 2, 1, 2]))]
    df = spark.createDataFrame([(a, b, c, float(s)) for a, b, c, s in rows], "spike_id long, t long, label int, score double")
    kept = lambda r: {x[0] for x in trains.deduplicate(df, r).where("kept").select("spike_id").collect()}
    assert kept(-1) == set(range(9))
    assert kept(0) == set(range(9)) - {4}
    assert kept(9) == set(range(9)) - {4, 7}


@pytest.mark.parametrize("n", [0, 1, 8])
def test_decrumb_literal(spark, n):
    rows = [(u * 100 + i, u) for u in range(n) for i in range(10 if u % 2 == 0 else 2)]
    got = labels.decrumb(spark.createDataFrame(rows, "spike_id long, label int"), 5).select("label", "kept").distinct().collect()
    assert {(a, b) for a, b in got} == {(u, u // 2 if u % 2 == 0 else -1) for u in range(n)}


def test_linkage_literal(spark):
    at = [0.0, 0.1, 1.0, 1.1, 2.0]
    pairs = [(i, j, abs(at[i] - at[j])) for i in range(5) for j in range(i + 1, 5)]
    assert cluster.linkage(spark.createDataFrame(pairs, "i int, j int, d double"), 0.15) == {0: 0, 1: 0, 2: 2, 3: 2}


@pytest.mark.parametrize("n", [1, 2, 8])
def test_depth_order_literal(spark, n):
    rows = [(u * 10 + i, u, float(n - u)) for u in range(n) for i in range(10)]
    got = labels.reorder_by_depth(spark.createDataFrame(rows, "spike_id long, label int, z double")).select("label", "by_depth").distinct().collect()
    assert {(a, b) for a, b in got} == {(u, n - 1 - u) for u in range(n)}


@pytest.mark.parametrize("values,expected", [([0, 2, 0, 0], [1]), ([2, 0, 0, 0], []), ([0, 0, 0, 2], []), ([0, 2, 2, 0], [1]), ([0, 1, 0, 0], []), ([0, 3, 2, 0], [1]), ([0, 2, 3, 0], [2])])
def test_local_maxima_edges(spark, values, expected):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "c int, t long, v double")
    assert sorted(r.t for r in detect.local_maxima(df, 3, 1.0, ["c"], ["t"]).collect()) == expected


def test_suppression_against_definition(spark):
    r = np.random.default_rng(0)
    rows = [(i, int(t), int(c), float(v)) for i, (t, c, v) in enumerate(zip(r.integers(0, 300, 150), r.integers(0, 5, 150), r.integers(1, 9, 150)))]
    rows = list({(t, c): (i, t, c, v) for i, t, c, v in rows}.values())
    peaks = spark.createDataFrame(rows, "spike_id long, t long, channel int, v double")
    ring = spark.createDataFrame([(c, (c + k) % 5) for c in range(5) for k in (-1, 0, 1)], "channel int, neighbor int")
    got = {x.spike_id for x in detect.detect_and_deduplicate(peaks, ring, 7).collect()}
    near = lambda a, b: (a - b) % 5 in (0, 1, 4)
    want = {i for i, t, c, v in rows if not any(near(c, c2) and abs(t - t2) <= 7 and (v2, -c2, -t2) > (v, -c, -t) for _, t2, c2, v2 in rows)}
    assert got == want


def test_peeling_leaves_nothing(spark):
    ship(spark)
    kernel = [0.25, 0.5, 1.0, 0.5, 0.25]
    v = np.zeros(400)
    for at, h in ((20, 5.0), (99, 7.0), (101 + 30, 4.0), (250, 9.0)):
        v[at - 2 : at + 3] += h * np.array(kernel)
    df = spark.createDataFrame([(i, i, float(x)) for i, x in enumerate(v)], "spike_id long, t long, v double")
    got = detect.peel(df, 100, 10, detect.subtract_peaks(1.0, 3, kernel), "chunk long, spike_id long, t long, height double").orderBy("t").collect()
    assert [(r.t, r.height) for r in got] == [(20, 5.0), (99, 7.0), (131, 4.0), (250, 9.0)]


def test_time_chunks():
    assert detect.time_chunks(0, 100, 30) == [(0, 0, 33), (1, 33, 66), (2, 66, 100)]
    assert len(detect.time_chunks(0, 110, 30)) == 4


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(50)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 45)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 30 else 40 if i in (40, 45) else i for i in range(50)}


def test_density_peaks_on_blobs(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(x), float(y), i % 3) for i, (x, y) in enumerate(r.normal(0, 0.5, (300, 2)) + np.array([[0, 0], [8, 0], [0, 8]])[np.arange(300) % 3])]
    p = spark.createDataFrame(rows, "id long, x double, y double, truth int")
    got = density.density_peaks(p, ["x", "y"], "id", 0.5, None, 20, 3.0, 5).join(p, "id").withColumn("label", F.dense_rank().over(__import__("pyspark").sql.Window.orderBy("label")))
    assert compare.rand_index(got, "truth", "label").first().adjusted_rand >= 0.95


def test_kmeans_and_mixture(spark):
    r = np.random.default_rng(2)
    centres = np.array([[0, 0], [6, 0], [0, 6]], float)
    x = r.normal(0, 0.7, (300, 2)) + centres[np.arange(300) % 3]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    groups = cluster.kmeans(df, "v", 3, seed=1).groupBy((F.col("id") % 3).alias("truth"), "cluster").count().collect()
    assert len(groups) == 3
    mu, pi, var, elbo = cluster.mixture(df, "v", 2, centres + 1, noise=1e-6)
    assert np.abs(mu - centres).max() < 0.25 and all(b >= a - 1e-3 for a, b in zip(elbo, elbo[1:]))


def test_principal_axes(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([([float(a) for a in v],) for v in x], "v array<double>")
    axes = cluster.principal_axes(df, "v", 4, 2)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(axes @ v[:2].T), np.eye(2), atol=1e-6)


def test_motion(spark):
    spikes = spark.createDataFrame([(i, float(t), 10.0) for i, t in enumerate([0.0, 5.0, 10.0, 12.5, 30.0])], "id long, t double, z double")
    field = spark.createDataFrame([(5.0, 0.0), (15.0, 2.0)], "t_bin double, disp double")
    got = [r.disp for r in motion.displacement_at(spikes, field, "t", 10.0).orderBy("id").collect()]
    assert np.allclose(got, [0, 0, 1, 1.5, 2])
    steps = spark.createDataFrame([(0, 1.0), (1, 3.0)], "t_bin long, disp double")
    fixed = motion.correct(spikes, steps, "t", "z", 10.0)
    back = motion.uncorrect(fixed.drop("disp"), steps, "t", "z_reg", 10.0, "again")
    assert all(r.again == r.z for r in back.collect())


def test_combine_and_count_filter(spark):
    a = spark.createDataFrame([(0, 1), (1, -1), (2, -1)], "spike_id long, label int")
    b = spark.createDataFrame([(0, -1), (1, 0), (2, -1)], "spike_id long, label int")
    assert {tuple(r) for r in labels.combine(a, b).collect()} == {(0, 1), (1, 2), (2, -1)}
    s = spark.createDataFrame([(i, 0 if i < 5 else 1) for i in range(7)], "spike_id long, label int")
    assert {r.label for r in labels.count_filter(s, 0, 4).where("kept >= 0").collect()} == {1}


def test_soft(spark):
    rows = spark.createDataFrame([(0, u, ll) for u, ll in ((0, -1.0), (1, -2.0), (2, -3.0))], "s long, unit int, ll double")
    got = soft.soft_assign(rows, "s", noise=-4.0, k=2).orderBy("rank").collect()
    e = np.exp([-1.0, -2.0, -4.0])
    assert np.allclose([r.r for r in got], (e / e.sum())[:2])
    assert abs(soft.log_sum_exp(rows, ["s"]).first().lse - np.log(np.exp([-1.0, -2, -3]).sum())) < 1e-9


def test_closest_in_time(spark):
    a = spark.createDataFrame([(0, 10), (1, 50), (2, 1000)], "a_id long, ta long")
    b = spark.createDataFrame([(0, 12), (1, 8), (2, 55)], "b_id long, tb long")
    assert {(r.a_id, r.b_id) for r in joins.closest_in_time(a, b, 5).collect()} == {(0, 0), (1, 2), (2, None)}


def test_sources(spark, tmp_path):
    from spindrift.sources import tables

    x = (np.arange(60) % 7).astype("<i2").reshape(20, 3)
    x.tofile(tmp_path / "r.bin")
    traces = tables.read_binary_traces(spark, str(tmp_path / "r.bin"), 3, 5)
    long = tables.explode_traces(traces).toPandas()
    assert len(long) == 60 and all(x[r.t, r.channel] == r.v for r in long.itertuples())
    spikes = spark.createDataFrame([(0, 6, 1), (1, 9, 2)], "spike_id long, t long, channel int")
    got = {r.spike_id: list(r.v) for r in tables.snippets(spikes, traces, 2, 3, 5).collect()}
    assert got == {0: x[4:9, 1].tolist(), 1: x[7:12, 2].tolist()}
    np.save(tmp_path / "f.npy", np.arange(6.0).reshape(3, 2))
    rows = tables.read_npy_rows(spark, str(tmp_path / "f.npy")).orderBy("i").collect()
    assert [r.v for r in rows] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    named = tables.with_ids(spark.createDataFrame([(5,), (3,), (9,)], "t long"), ["t"]).collect()
    assert {r.t: r.spike_id for r in named} == {3: 0, 5: 1, 9: 2}


def test_streaming_suppression(spark, tmp_path):
    from spindrift.streaming import detect as stream

    ship(spark)
    t0 = pd.Timestamp("2024-01-01")
    v = [0.0, 5.0, 3.0, 0.0, 0.0, 0.0, 4.0, 6.0, 0.0, 0.0]
    pdf = pd.DataFrame({"channel": "a", "t": [t0 + pd.Timedelta(seconds=i) for i in range(10)] + [t0 + pd.Timedelta(seconds=200)], "v": [*v, 9.0]})
    pdf.iloc[len(pdf) - 1, pdf.columns.get_loc("channel")] = "b"
    for i, part in enumerate((pdf[:6], pdf[6:])):
        spark.createDataFrame(part).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema("channel string, t timestamp, v double").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in" / "*"))
    q = stream.suppressed(source, 1.0, 2.0).writeStream.format("memory").queryName("peaks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.t.second, r.v) for r in spark.table("peaks").collect() if r.channel == "a") == [(1, 5.0), (7, 6.0)]


def test_rate_correlations_of_all_pairs(spark):
    """Every pair of units, also of high ids and without a common bin, as on a dense grid."""
    counts = {3: [4, 1, 0, 0, 0, 2], 7: [0, 0, 9, 1, 0, 0], 55: [1, 0, 4, 0, 0, 0], 900: [0, 0, 0, 0, 16, 0]}
    rows = [(u, b * 10 + k % 10) for u, c in counts.items() for b, n in enumerate(c) for k in range(n)]
    got = trains.rate_correlations(spark.createDataFrame(rows, "label long, t long"), 10).collect()
    units, want = sorted(counts), np.corrcoef([np.sqrt(counts[u]) for u in sorted(counts)])
    assert len(got) == 6
    for i, j, corr in got:
        assert abs(corr - want[units.index(i), units.index(j)]) < 1e-9


def test_firing_corr_has_all_units(spark):
    from spindrift.plans import catalogue

    d = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().count()
    assert n > 40 and catalogue.QUERIES["firing_corr"](spark, d).count() == n * (n - 1) // 2


def test_faults_mended(spark, tmp_path):
    """Cases that gave wrong results once."""
    import pandas as pd
    from spindrift.operators import detect
    from spindrift.sources import tables

    # the mean of a group's distances counts pairs beyond the threshold
    three = spark.createDataFrame([(0, 1, 0.05), (1, 2, 0.05), (0, 2, 0.2)], "i int, j int, d double")
    assert cluster.linkage(three, 0.15, "average") == {0: 0, 1: 0, 2: 0} and len(set(cluster.linkage(three, 0.15).values())) == 2
    # two units that never share a bin are correlated negatively
    rows = spark.createDataFrame([(k % 2, 10 * k) for k in range(20)], "label long, t long")
    got = trains.rate_correlations(rows, 10).collect()
    assert len(got) == 1 and abs(got[0]["corr"] + 1) < 1e-9
    # recordings that aren't whole numbers of chunks
    for n in (7, 10, 23):
        x = np.arange(n * 3, dtype="<i2").reshape(n, 3)
        x.tofile(tmp_path / f"r{n}.bin")
        got = tables.read_binary_traces(spark, str(tmp_path / f"r{n}.bin"), 3, 5).orderBy("chunk_id", "channel").collect()
        assert [(r.chunk_id, r.channel, r.t0, r.v) for r in got] == [(k, c, 5 * k, x[5 * k : 5 * k + 5, c].astype(float).tolist()) for k in range(-(-n // 5)) for c in range(3)]
    # every peak of a chunk is taken
    pdf = pd.DataFrame({"chunk": 0, "spike_id": range(600), "t": range(600), "v": [100.0 if i % 4 == 0 else 0.0 for i in range(600)], "core": True})
    assert len(detect.subtract_peaks(50.0, 1, [1.0])(pdf)) == 150


def test_suppression_by_chunks(spark):
    """Chunks with margins decide as one window over the whole table would."""
    import random

    from spindrift.operators import detect

    r = random.Random(3)
    rows = [(i, r.randrange(4000), float(r.randrange(50)), r.randrange(3)) for i in range(600)]
    df = spark.createDataFrame(rows, "spike_id long, t long, v double, channel int")
    beats = lambda a, b: (a[2], -a[1], -a[0]) > (b[2], -b[1], -b[0])
    want = {a[0] for a in rows if not any(abs(a[1] - b[1]) <= 5 and beats(b, a) for b in rows)}
    assert {x.spike_id for x in detect.suppress(df, 5).collect()} == want
