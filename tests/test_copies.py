"""Tables of many copies: the same results as the SQL, and no pairs of copies on the way."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from spindrift.operators import density, detect, distances, joins, sortings, trains
from spindrift.plans import catalogue

from test_queries import SF, TABLES, rows

TIMES = 4
KEYS = {"part": {"p_partkey": 100_000}, "supplier": {"s_suppkey": 10_000}, "events": {"event_id": 1_000_000, "user_id": 10_000}}


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """sf0.001 with part, supplier and events four times under shifted keys, as a folder and in DuckDB."""
    to, con = tmp_path_factory.mktemp("copied"), duckdb.connect()
    for t in TABLES:
        kinds = dict(con.execute(f"select column_name, column_type from (describe select * from '{SF}/{t}.parquet')").fetchall())
        moved = ", ".join(f"CAST({c} + k * {s} AS {kinds[c]}) AS {c}" for c, s in KEYS.get(t, {}).items())
        what = f"SELECT * EXCLUDE (k) REPLACE ({moved}) FROM '{SF}/{t}.parquet', (SELECT unnest(range({TIMES})) AS k)" if moved else f"SELECT * FROM '{SF}/{t}.parquet'"
        con.execute(f"COPY ({what}) TO '{to}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"create view {t} as select * from '{to}/{t}.parquet'")
    return str(to), con


CHANGED = """knn_join knn_inliers kde_ratio nearest_density nhdn nearest_label firing_corr cross_correlogram match_nearest_time ground_truth_categories unit_performance
nms_time_channel cosine_topk channel_index own_slots channels_within nearest_channels slot_map kept_slots regular_slots nearest_above channel_parents""".split()


@pytest.mark.parametrize("name", CHANGED)
def test_copies_against_sql(spark, copied, name):
    d, con = copied
    assert rows(con.execute(catalogue.ORACLE[name]).df()) == rows(catalogue.QUERIES[name](spark, d).toPandas())


@pytest.fixture
def pairs(monkeypatch):
    """The number of rows of each join of points within a radius."""
    made, plain = [], joins.within

    def counted(*args, **kw):
        out = plain(*args, **kw)
        made.append(out.count())
        return out

    monkeypatch.setattr(joins, "within", counted)
    monkeypatch.setattr(density, "within", counted)
    return made


@pytest.mark.parametrize("name", "knn_join knn_inliers kde_ratio nearest_density nhdn dpc_labels nearest_label own_slots nearest_channels nearest_above channel_index channel_parents".split())
def test_copies_make_no_pairs(spark, copied, pairs, name):
    """As many pairs as without copies."""
    catalogue.QUERIES[name](spark, SF).count()
    once = sum(pairs)
    pairs.clear()
    catalogue.QUERIES[name](spark, copied[0]).count()
    # nearest_label takes its labelled points by the key, so that copies have other ones
    assert once > 0 and sum(pairs) <= once * (4 if name == "nearest_label" else 1)


def test_density_peaks_with_copies_against_definition(spark):
    r = np.random.default_rng(3)
    xy = r.integers(0, 6, (60, 2)).astype(float)
    for k in (2, 5, 20):
        p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(60, None, 1.0)], "id long, x double, y double")
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
        dens = {i: float(np.round(np.where(d[i] <= 3, np.exp(-d[i] ** 2 / 2), 0).sum(), 9)) for i in range(60)}
        up = {}
        for i in range(60):
            near = sorted((d[i, j], j) for j in range(60) if j != i and d[i, j] <= 2.5)[:k]
            up[i] = next((j for _, j in near if dens[j] > dens[i]), None)
        known = spark.createDataFrame(list(dens.items()), "id long, density double")
        assert {x.id: x.nhdn for x in density.higher_neighbour(p, known, ["x", "y"], "id", k, 2.5).collect()} == up | {60: None}
        root = list(range(61))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in up.items():
            if j is not None:
                a, b = sorted((top(i), top(j)))
                root[b] = a
        # densities alike but for the order of their sums may be told apart by it, so the trees are those of this table only if they are far from each other or equal by copies
        found = {x.id: x.label for x in density.density_peaks(p, ["x", "y"], "id", 1.0, None, k, 2.5, 1).collect()}
        gaps = np.diff(sorted(set(dens.values())))
        if gaps.min() > 1e-6:
            assert found == {i: top(i) for i in range(61)}
        assert len(found) == 61 and found[60] == 60


def test_nearest_in_time_without_pairs(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("pairs of events")

    monkeypatch.setattr(trains, "bucketed_pairs", never)
    r = np.random.default_rng(1)
    a, b = r.integers(-50, 400, 150), r.integers(-50, 400, 120)
    da = spark.createDataFrame([(i, int(t)) for i, t in enumerate(a)] + [(999, None)], "a_id long, ta long")
    db = spark.createDataFrame([(i, int(t)) for i, t in enumerate(b)] + [(999, None)], "b_id long, tb long")
    for radius in (0, 1, 7, 60):
        near = {i: min(((abs(t - u), j) for j, u in enumerate(b) if abs(t - u) <= radius), default=(None, None)) for i, t in enumerate(a)}
        back = {j: min(((abs(t - u), i) for i, t in enumerate(a) if abs(t - u) <= radius), default=(None, None)) for j, u in enumerate(b)}
        got = {x.a_id: (x.dt, x.b_id) for x in joins.closest_in_time(da, db, radius).collect()}
        assert got == near | {999: (None, None)}
        tp = {(i, j) for i, (_, j) in near.items() if j is not None and back[j][1] == i}
        want = [(i, j, "TP") for i, j in tp] + [(i, None, "FN") for i in [*range(150), 999] if i not in dict(tp)] + [(None, j, "FP") for j in [*range(120), 999] if j not in {y for _, y in tp}]
        assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in joins.categories(da, db, radius).select("a_id", "b_id", "category").collect())


def test_suppression_by_running_maxima(spark):
    r = np.random.default_rng(2)
    data = [(i, int(t), int(c), float(v)) for i, (t, c, v) in enumerate(zip(r.integers(-40, 200, 300), r.integers(0, 4, 300), r.integers(0, 9, 300)))]
    data.append(data[0])
    p = spark.createDataFrame(data, "spike_id long, t long, channel int, v double")
    near = spark.createDataFrame([(c, n) for c in range(4) for n in (c - 1, c, c + 1)], "channel int, neighbor int")
    for radius in (0, 1, 5):
        better = lambda q, x: q[3] > x[3] or (q[3] == x[3] and (q[2] < x[2] or (q[2] == x[2] and q[1] < x[1])))
        want = [x for x in data if not any(abs(q[2] - x[2]) <= 1 and abs(q[1] - x[1]) <= radius and better(q, x) for q in data)]
        got = detect.detect_and_deduplicate(p, near, radius)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        # a frame that slides is made anew for each row
        assert "RangeFrame, -" not in got._jdf.queryExecution().toString()


def test_peeling_is_not_quadratic():
    r = np.random.default_rng(5)
    n = 300_000
    pdf = pd.DataFrame({"t": np.arange(n), "spike_id": np.arange(n), "v": r.integers(0, 80, n).astype(float), "core": True, "chunk": 0})
    fn, began = detect.subtract_peaks(40.0, 3, [0.25, 0.5, 1.0, 0.5, 0.25]), time.time()
    assert len(fn(pdf)) > 20_000 and time.time() - began < 8
    for kernel, dedup in (([0.25, 0.5, 1.0, 0.5, 0.25], 3), ([-0.5, 1.0, 0.5], 0)):
        some = pdf.iloc[:400]
        x, barred, want = some["v"].to_numpy(float).copy(), np.zeros(400, bool), []
        while True:
            free = np.where(barred, -np.inf, x)
            i = int(free.argmax())
            if not free[i] > 40:
                break
            height, half = x[i], len(kernel) // 2
            a, b = max(0, i - half), min(400, i - half + len(kernel))
            x[a:b] -= height * np.array(kernel)[a - i + half : b - i + half]
            barred[max(0, i - dedup) : i + dedup + 1] = True
            want.append((i, height))
        got = detect.subtract_peaks(40.0, dedup, kernel)(some)
        assert list(zip(got["spike_id"], got["height"])) == sorted(want)


def trains_of(spark):
    r = np.random.default_rng(4)
    u, t = r.integers(0, 40, 900), r.integers(0, 1000, 900)
    return u, t, spark.createDataFrame([(int(a), int(b)) for a, b in zip(u, t)], "label long, t long")


def test_correlations_without_joins(spark, monkeypatch):
    u, t, s = trains_of(spark)
    monkeypatch.setattr(trains, "BLOCK", 16)
    got = trains.rate_correlations(s, 50)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    x = np.zeros((40, 20))
    np.add.at(x, (u, t // 50), 1)
    x = np.corrcoef(np.sqrt(x)[:, (t // 50).min() : (t // 50).max() + 1])
    found = {(y.i, y.j): y.corr for y in got.collect()}
    assert len(found) == 780 and all(abs(found[i, j] - x[i, j]) < 1e-9 for i in range(40) for j in range(i + 1, 40))


def test_correlograms_without_joins(spark, monkeypatch):
    u, t, s = trains_of(spark)
    a, b = s.where("label < 20").withColumn("label", F.col("label") % 3), s.where("label >= 20").withColumn("label", F.col("label") % 2)
    want = {}
    for i, ta in zip(u[u < 20] % 3, t[u < 20]):
        for j, tb in zip(u[u >= 20] % 2, t[u >= 20]):
            lag = int(np.floor((tb - ta) / 70 + 0.5))
            if abs(lag) <= 4:
                want[int(i), int(j), lag] = want.get((int(i), int(j), lag), 0) + 1
    for part in (1 << 19, 8):
        monkeypatch.setattr(sortings, "PART", part)
        c = sortings.cross_correlogram(a, b, 70, 4)
        assert "Join" not in c._jdf.queryExecution().executedPlan().toString()
        assert {(y.i, y.j, y.lag): y.n for y in c.collect()} == want


def test_cosine_of_blocks_as_products(spark):
    r = np.random.default_rng(6)
    x = r.integers(-2, 3, (90, 4)).astype(float)
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None)], "id long, v array<float>")
    got = distances.top_cosine(df, df.where("id % 9 = 0 or id = 7"), "id", 6, block_bytes=2000)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    size = np.sqrt((x * x).sum(1))
    sim = lambda i, j: None if 90 in (i, j) or size[i] * size[j] == 0 else float(np.round(x[i] @ x[j] / (size[i] * size[j]), 6))
    found = {}
    for y in got.collect():
        found.setdefault(y.query, {})[y["rank"]] = (y.id, None if y.sim is None else round(y.sim, 6))
    assert set(found) == {0, 9, 18, 27, 36, 45, 54, 63, 72, 81, 90, 7}
    for q, by in found.items():
        want = sorted(((sim(q, j) is None, -(sim(q, j) or 0), j) for j in range(91) if j != q))[:6]
        assert [by[i + 1][0] for i in range(6)] == [j for *_, j in want]


def test_greedy_match_in_time_without_pairs(spark, monkeypatch):
    r = np.random.default_rng(8)
    a, b = (np.concatenate([r.integers(0, 60, 90), r.integers(200, 210, 40)]).astype(float) for _ in range(2))
    names = [r.permutation(130).tolist() for _ in range(2)]
    da = spark.createDataFrame(list(zip(names[0], a.tolist())), "a_id long, ta double")
    db = spark.createDataFrame(list(zip(names[1], b.tolist())), "b_id long, tb double")
    used, want = (set(), set()), set()
    for _, i, j, d in sorted((abs(x - y) // 2, i, j, abs(x - y)) for i, x in zip(names[0], a) for j, y in zip(names[1], b) if abs(x - y) <= 5):
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            want.add((i, j, d))
    get = lambda: {tuple(x) for x in joins.greedy_match(da, db, ["ta"], ["tb"], 5.0, 2.0).collect()}
    monkeypatch.setattr(joins, "RUN", 100)  # the longer stretch goes by rounds
    assert get() == want
    monkeypatch.undo()
    monkeypatch.setattr(joins, "within", None)
    assert get() == want


def test_pairs_are_dealt_over_tasks(spark, monkeypatch):
    """A small table that makes many pairs: the parts of its one cell go to several tasks, and no pair is lost or made twice."""
    r = np.random.default_rng(9)
    xy = r.uniform(0, 1, (300, 2))
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double").coalesce(1)
    monkeypatch.setattr(joins, "PAIRS", 2000)
    near = joins.near_places(joins.places(p, ["x", "y"], "id"), ["x", "y"], 1.0)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    tasks = near.select("a", "b", F.spark_partition_id().alias("task")).toPandas()
    assert sorted(zip(tasks["a"], tasks["b"])) == [(i, j) for i in range(300) for j in range(300) if d[i, j] <= 1]
    assert tasks["task"].nunique() >= 8 and tasks["task"].value_counts().max() < 0.4 * len(tasks)


@pytest.mark.parametrize("name", ["kde_ratio", "nhdn", "knn_join"])
def test_points_are_not_broadcast(spark, copied, name):
    """By their files these tables look small; a broadcast of them would grow on the driver."""
    got = catalogue.QUERIES[name](spark, copied[0])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["own_slots", "channel_index", "slot_map", "kept_slots", "regular_slots"])
def test_places_of_their_own_make_no_pairs(spark, pairs, tmp_path, name, monkeypatch):
    """Of channels that are no copies pairs are results only: what is joined is pairs of grid cells. Cells that are cut give the same."""
    r = np.random.default_rng(10)
    data = [(int(k), int(x), float(z)) for k, x, z in zip(r.permutation(400) + 1, r.integers(0, 25, 400), np.round(r.uniform(-1000, 10000, 400), 2))]
    data[7] = (*data[7][:2], data[8][2])
    spark.createDataFrame(data, "s_suppkey int, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = rows(con.execute(catalogue.ORACLE[name]).df())
    assert rows(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == want and sum(pairs) <= 2 * 9 * 36
    monkeypatch.setattr(joins, "ROOM", 200)
    assert rows(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == want
