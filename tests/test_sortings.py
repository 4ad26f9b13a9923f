"""Operators on sortings, channels, candidates, features and blended templates that have no query with SQL, against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.operators import blend, candidates, channels, density, features, sortings


@pytest.fixture(scope="module")
def probe(spark):
    """Sixteen sites, 4 by 4, and neighbours within 25."""
    from spindrift.operators import joins

    ch = spark.createDataFrame([(i, (i % 4) * 16.0, (i // 4) * 20.0) for i in range(16)], "channel int, x double, z double")
    return ch, joins.channel_index(ch, 25.0)


def test_features_as_columns(spark):
    s = spark.createDataFrame([(i, 10 * i, i % 3 - 1, float(i)) for i in range(9)], "spike_id long, t long, label long, ptp double")
    more = sortings.with_features(s, double=F.col("ptp") * 2)
    assert [r.double for r in more.orderBy("spike_id").collect()] == [2.0 * i for i in range(9)]
    with pytest.raises(ValueError):
        sortings.with_features(s, ptp=F.lit(1))
    with pytest.raises(ValueError):
        sortings.without_features(s, "pt")
    assert sortings.with_features(s, True, ptp=F.lit(1)).agg(F.sum("ptp")).first()[0] == 9 and sortings.without_features(more, "double").columns == s.columns
    assert sortings.features_matching(more, "pt").columns == ["spike_id", "ptp"] and sortings.mask(s, "ptp > 3").count() == 5
    assert sortings.only(s, spark.createDataFrame([(2,), (2,), (77,)], "spike_id long")).count() == 1
    side = spark.createDataFrame([(1, 5.0)], "spike_id long, extra double")
    assert sortings.joined_features(s, side).where("extra is null").count() == 8
    assert [r.t for r in sortings.between(s, 20, 50, 7).orderBy("t").collect()] == [27, 37, 47, 57]
    both = sortings.versus({"a": s.select("label", "ptp"), "b": s.select("label")})
    assert both.groupBy("sorter").count().count() == 2 and both.where("ptp is null").count() == 9
    gone = sortings.all_tested(s.where("spike_id < 5"), s).orderBy("spike_id").collect()
    assert [r.label for r in gone] == [-1, 0, 1, -1, 0, -1, -1, -1, -1]
    at = sortings.structured_locations(s.withColumns({c: F.lit(float(k)) for k, c in enumerate(("x", "y", "z", "alpha"))})).select("location.*").first()
    assert (at.x, at.y, at.z, at.alpha) == (0.0, 1.0, 2.0, 3.0)
    with pytest.raises(Exception, match="several labels"):
        sortings.candidate_labels(spark.createDataFrame([(1, 5), (2, 5)], "label int, candidate int")).collect()
    assert [r.b for r in spark.createDataFrame([(-0.6,), (-0.5,), (0.4,), (0.5,)], "x double").select(sortings.centered_bins(F.col("x")).alias("b")).collect()] == [-1, 0, 0, 1]


def test_perturbed(spark, probe):
    ch, near = probe
    s = spark.createDataFrame([(i, i, i % 16) for i in range(4000)], "spike_id long, t long, channel int")
    got = sortings.perturb(s, near, 0.25, 3, seed=1).collect()
    allowed = {(r.channel, r.neighbor) for r in near.collect()}
    assert abs(len(got) / 4000 - 0.75) < 0.03 and len({r.t - r.spike_id for r in got}) == 1 and all(abs(r.t - r.spike_id) <= 3 and (r.spike_id % 16, r.channel) in allowed for r in got)
    assert len({(r.spike_id % 16, r.channel) for r in got}) == len(allowed)
    moves = {sortings.perturb(s.limit(1), near, 0.0, 3, seed=i).first().t for i in range(12)}
    assert min(moves) < 0 < max(moves)


def test_scores(spark):
    kind = "array<struct<unit: int, ll: double, r: double>>"
    rows = [(1, 0, 0, [(0, -1.0, 0.7), (1, -2.0, 0.2), (-1, -3.0, 0.05)], 0.05), (2, None, 0, [(0, -1.0, 0.9)], 0.1), (3, 2, 1, [(0, -1.0, 0.6), (1, -1.5, 0.4)], 0.0)]
    df = spark.createDataFrame(rows, f"spike_id long, truth int, label int, cand {kind}, noise_r double")
    got = sortings.vacuum(df).orderBy("spike_id").collect()
    assert abs(got[0].noise_r - 0.1) < 1e-12 and got[0].cand[2].r == 0 and got[0].cand[2].ll == float("-inf") and got[1].noise_r == 0.1
    want = [(1 - 0.7) ** 2 + 0.2**2 + 0.05**2, 2.0, (1 - 0.4) ** 2 + 0.6**2]
    assert abs(sortings.brier(df).first().brier - np.mean(want)) < 1e-12
    c = spark.createDataFrame([([3, 1, 3, -1, 1, 2],)], "c array<int>").select(candidates.without_repeats(F.col("c")).alias("c"))
    assert c.first().c == [3, 1, -1, -1, -1, 2] and c.select(candidates.counted(F.col("c")).alias("n")).first().n == 3
    assert [candidates.search_size(n, 5) for n in (1, 4, 12, 100)] == [1, 1, 3, 5]
    d = spark.createDataFrame([(4.0, -1.0)], "d double, p double").select(candidates.likelihood(F.col("d"), 2.0, F.col("p")).alias("ll")).first().ll
    assert d == -2.0


def test_candidates_drawn(spark):
    allowed = spark.createDataFrame([(u, h) for h in range(3) for u in range(h * 10, h * 10 + 6)], "unit long, neighborhood long")
    rows = spark.range(600).select(F.col("id").alias("spike_id"), (F.col("id") % 3).alias("neighborhood"))
    got = candidates.explored(rows, allowed, 4).collect()
    assert all(r.unit // 10 == r.spike_id % 3 and r.unit % 10 < 6 for r in got) and {r.unit % 10 for r in got} == set(range(6)) and len({r.spike_id for r in got}) == 600
    assert candidates.united(allowed, allowed.where("unit < 3")).count() == 18


def dense(spark, near, n, seed):
    """Snippets of one sample on all neighbours, and what they are."""
    x = np.random.default_rng(seed).normal(size=(n, 16))
    spikes = spark.createDataFrame([(i, i % 16) for i in range(n)], "spike_id long, channel int")
    values = spark.createDataFrame([(i, c, float(x[i, c])) for i in range(n) for c in range(16)], "spike_id long, neighbor int, v double")
    return x, spikes.join(near, "channel").join(values, ["spike_id", "neighbor"]).select("spike_id", "channel", "slot", "v")


def test_slots(spark, probe):
    ch, near = probe
    x, rows = dense(spark, near, 40, 0)
    small = channels.within_radius(near, ch, 17.0)
    got = channels.reslotted(rows, channels.slot_map(near, small)).join(small, ["channel", "slot"]).collect()
    assert len(got) == rows.join(small, ["channel"]).select("spike_id", "neighbor").distinct().count() and all(r.v == x[r.spike_id, r.neighbor] for r in got)
    wide = channels.full_index(ch)
    back = channels.reslotted(rows, channels.slot_map(near, wide), 0.0)
    assert back.count() == 40 * 16 and back.where("v <> 0").count() == rows.count()
    regular = channels.regular_index(near, ch, 4.0)
    assert regular.groupBy("channel").count().select("count").distinct().count() == 1
    padded = rows.join(near, ["channel", "slot"]).join(regular.withColumnRenamed("slot", "s"), ["channel", "neighbor"]).select("spike_id", "channel", F.col("s").alias("slot"), "v")
    inside = channels.in_probe(padded, regular)
    assert inside.count() == rows.count() and all(r.v == x[r.spike_id, r.neighbor] for r in inside.collect())
    full = spark.createDataFrame([(i, i % 16) for i in range(40)], "spike_id long, channel int").join(regular, "channel").select("spike_id", "channel", "slot", F.lit(None).cast("double").alias("v"))
    assert channels.filled_in(full, inside).where("v is not null").count() == rows.count()
    assert all(r.v == x[r.spike_id, r.channel] for r in channels.main_rows(rows, near).collect())
    assert {(r.axis, r.sign) for r in channels.orders(ch).collect()} == {("x", 1), ("z", 1)}
    flipped = ch.withColumn("z", -F.col("z"))
    assert {(r.axis, r.sign) for r in channels.orders(flipped).collect()} == {("x", 1), ("z", -1)}
    assert channels.single_index(ch).where("channel = neighbor and slot = 0").count() == 16


def test_shifts(spark, probe):
    from spindrift.operators import motion

    ch, near = probe
    reg = motion.registered_geometry(ch, 20.0, 1, 1)
    where = {r.reg_channel: (r.x, r.z) for r in reg.collect()}
    x, rows = dense(spark, near, 40, 1)
    shifts = spark.createDataFrame([(i, i % 3 - 1) for i in range(40)], "spike_id long, shift int")
    got = channels.on_static_channels(rows, near, shifts, ch, reg, 20.0).collect()
    at = {((c % 4) * 16.0, (c // 4) * 20.0): c for c in range(16)}
    assert len(got) == rows.count()
    for r in got:
        px, pz = where[r.reg_channel]
        assert r.v == x[r.spike_id, at[px, pz - (r.spike_id % 3 - 1) * 20.0]]
    known = channels.shift_index(spark.createDataFrame([(0, 1), (0, -1), (2, 0), (0, 1)], "template int, shift int"))
    assert [(r.template, r.shift, r.shifted_id) for r in known.orderBy("shifted_id").collect()] == [(0, -1, 0), (0, 1, 1), (2, 0, 2)]
    assert channels.shifted_ids(spark.createDataFrame([(2, 0), (2, 1)], "template int, shift int"), known).where("shifted_id is null").count() == 1
    assert channels.static_shift_index(spark.createDataFrame([(5,), (3,)], "template int")).orderBy("template").first().shifted_id == 0
    a = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "time int, unit int, shift int")
    assert {tuple(r) for r in channels.co_occurring(a, a).collect()} == {(1, 0, 1, 0), (1, 1, 1, 1)}
    # templates as the probe sees them after a step: what lies a step further down on the registered probe
    long = reg.select(F.lit(7).alias("unit"), "reg_channel", F.lit(0).alias("sample"), F.col("z").alias("v"))
    seen = blend.at_shift(long, spark.createDataFrame([(7, 1)], "unit int, shift int"), ch, reg, 20.0).collect()
    assert len(seen) == 16 and all(r.v == (r.channel // 4) * 20.0 + 20.0 for r in seen)
    place = blend.template_places(spark.createDataFrame([(7, 5)], "unit int, channel int"), ch).first()
    assert (place.x, place.z) == (16.0, 20.0)
    two = blend.united(long.limit(2), long.withColumn("unit", F.lit(0)))
    assert {r.unit for r in two.collect()} == {7, 8}
    units = spark.createDataFrame([(0, 5.0, 10), (1, 1.0, 10), (2, 5.0, 1)], "unit int, snr double, n int")
    assert [r.keep for r in blend.noisy_units(units, 2.0, 5).orderBy("unit").collect()] == [True, False, False]


def test_weights_at_edges(spark):
    rows = spark.createDataFrame([(s, r) for s in range(8) for r in (0.5, 4.0)], "sample int, snr double")
    for edge in ("saturate", "inf", "raw"):
        got = rows.select("sample", "snr", blend.denoising_weight(F.col("sample"), F.col("snr"), 8, 3, 2.0, edge=edge).alias("w")).collect()
        for r in got:
            far = (r.sample - 3) / 4 if r.sample >= 3 else (3 - r.sample) / 3
            s = r.snr if edge == "raw" else min(r.snr, 2.0) / 2.0
            want = 1.0 if edge == "inf" and s >= 1 else 1 / (1 + np.exp(6 + 12 * far - 12 * s))
            assert abs(r.w - want) < 1e-12


def test_temporal_basis(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3)) @ r.normal(size=(3, 12)) + 0.01 * r.normal(size=(300, 12)) + 2.0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "spike_id long, v array<double>").repartition(3)
    odd = rows.unionByName(spark.createDataFrame([(900, None), (901, [float("nan")] * 12)], rows.schema))
    basis = features.TemporalBasis.fit(odd, 3)
    centred = x - x.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.abs(np.abs(basis.components @ vt[:3].T) - np.eye(3)).max() < 1e-6 and np.abs(basis.mean - x.mean(0)).max() < 1e-9
    got = rows.withColumn("pcs", basis.embed()).withColumn("back", basis.invert()).withColumn("kept", basis.project()).orderBy("spike_id").toPandas()
    want = centred @ basis.components.T
    assert np.abs(np.stack(got.pcs) - want).max() < 1e-9
    assert np.abs(np.stack(got.back) - (want @ basis.components + x.mean(0))).max() < 1e-9 and np.abs(np.stack(got.kept) - np.stack(got.back)).max() < 1e-9
    part = features.TemporalBasis.fit(rows, 2, start=2, stop=8)
    assert part.components.shape == (2, 6) and len(rows.select(part.embed().alias("p")).first().p) == 2
    pipe = features.Pipeline(features.basic_steps(3, 4, denoise=True)).fit(rows)
    out = pipe.transform(rows).orderBy("spike_id").toPandas()
    assert pipe.features() == ["voltage", "ptp", "pcs"] and np.abs(out.voltage - x[:, 4]).max() < 1e-12 and np.abs(np.stack(out.v) - np.stack(got.kept)).max() < 1e-9
    with pytest.raises(ValueError):
        features.Pipeline([features.Step("a", lambda _: F.lit(1)), features.Step("a", lambda _: F.lit(2))])
    m = out.assign(z=1.0, x=2.0, amplitude=out.ptp)
    m.loc[0, "z"] = np.nan
    feature = features.matrix(spark.createDataFrame(m), x_scale=0.5).toPandas()
    assert len(feature) == 299 and all(len(f) == 7 and f[1] == 1.0 for f in feature.feature)


def test_small_numerics(spark):
    r = np.random.default_rng(2)
    t = np.arange(32)
    wave = np.cos(2 * np.pi * 3 * t / 32) + 0.5 * np.sin(2 * np.pi * 5 * t / 32)
    fine = np.arange(64) / 2
    assert np.abs(features.resampled(wave, 64) - (np.cos(2 * np.pi * 3 * fine / 32) + 0.5 * np.sin(2 * np.pi * 5 * fine / 32))).max() < 1e-9
    assert np.abs(features.resampled(features.resampled(wave, 64), 32) - wave).max() < 1e-9
    x, mean, w = r.normal(size=(7, 5)), r.normal(size=5), r.normal(size=(5, 2))
    noise = np.diag(r.uniform(0.5, 2, 5))
    assert np.abs(features.low_rank_log_likelihood(x, mean, w, noise) - features.gaussian_log_likelihood(x, mean, noise + w @ w.T)).max() < 1e-9
    other, v = r.normal(size=5), r.normal(size=(5, 2))
    a, b = np.eye(5) + w @ w.T, np.eye(5) + v @ v.T
    gap = other - mean
    want = 0.5 * (np.trace(np.linalg.solve(b, a)) + gap @ np.linalg.solve(b, gap) - 5 + np.linalg.slogdet(b)[1] - np.linalg.slogdet(a)[1])
    assert abs(features.low_rank_divergence(mean, w, other, v) - want) < 1e-9 and abs(features.low_rank_divergence(mean, w, mean, w)) < 1e-9
    m = r.normal(size=(4, 4))
    assert np.linalg.eigvalsh(features.positive_definite(m, 0.1)).min() > 0.099
    one = spark.createDataFrame([(-2.0, 1, 2)], "x double, i int, j int").select(features.sign(F.col("x")).alias("s"), features.sign(F.lit(0.0)).alias("z"), features.flat_index([3, 4], F.col("i"), F.col("j")).alias("f")).first()
    assert (one.s, one.z, one.f) == (-1, 1, 6)
    p = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(9)], "id int, x double, z double")
    ratio = density.binned_density_ratio(p, ["x", "z"], 1.0, 1.0, 2.0).collect()
    assert len(ratio) > 9 and all(q.density > 0 for q in ratio) and abs(density.binned_density(p, ["x", "z"], 1.0, 1.0).agg(F.sum("density")).first()[0] - 9) < 1e-9
    same = density.nearest_density(p, ["x", "z"], "id", 4, 2.0, sigma=1.0).orderBy("id").first().density
    assert abs(same - (1 + 2 + np.exp(-1.0))) < 1e-9


def test_unit_brier(spark):
    """Found, missed and false spikes, a unit without a match, noise, a match that is no candidate, and an empty table."""
    kind = "array<struct<unit: int, ll: double, r: double>>"
    rows = [
        (0, True, [(5, -1.0, 0.7), (6, -2.0, 0.2)], 0.1),
        (0, True, [(6, -1.0, 0.8), (7, -2.0, 0.2)], None),
        (0, False, [(5, -1.0, 1.0)], 0.0),
        (0, None, None, None),
        (1, True, [(6, -1.0, 1.0)], 0.0),
        (2, True, [(6, -1.0, 1.0)], 0.0),
    ]
    true = spark.createDataFrame(rows, f"truth int, matched boolean, cand {kind}, noise_r double")
    best = spark.createDataFrame([(0, 5), (1, 6)], "unit int, match int")
    false = spark.createDataFrame([(5,), (5,), (9,)], "unit int")
    got = {r.unit: r for r in sortings.unit_brier(true, best, false).collect()}
    found = [0.3**2 + 0.2**2 + 0.1**2, 1 + 0.8**2 + 0.2**2]
    assert (got[0].match, got[0].n, got[0].n_false) == (5, 6, 2) and abs(got[0].hard - 8 / 6) < 1e-12 and abs(got[0].soft - (sum(found) + 8) / 6) < 1e-12 and abs(got[0].own - 0.7 / 4) < 1e-12
    assert (got[1].n, got[1].hard, got[1].soft, got[1].own) == (1, 0.0, 0.0, 1.0)
    assert (got[2].match, got[2].n_false, got[2].hard, got[2].soft) == (None, 0, 2.0, 2.0)
    alone = {r.unit: r for r in sortings.unit_brier(true, best).collect()}
    assert alone[0].n == 4 and alone[0].hard == 1.0
    assert sortings.unit_brier(true.limit(0), best, false).count() == 0
