"""One-to-one matches, borders, votes and small tables against plain restatements."""

import itertools

import numpy as np
from pyspark.sql import functions as F
from spindrift.operators import compare, density, joins, labels


def test_greedy_match_against_definition(spark):
    r = np.random.default_rng(0)
    a, b = r.integers(0, 60, 40).astype(float), r.integers(0, 60, 50).astype(float)
    da = spark.createDataFrame([(i, x) for i, x in enumerate(a.tolist())], "a_id int, ta double")
    db = spark.createDataFrame([(i, x) for i, x in enumerate(b.tolist())], "b_id int, tb double")
    got = {(p.a_id, p.b_id) for p in joins.greedy_match(da, db, ["ta"], ["tb"], 5.0, 2.0).collect()}
    used_a, used_b, want = set(), set(), set()
    for _, i, j in sorted((abs(a[i] - b[j]) // 2, i, j) for i in range(40) for j in range(50) if abs(a[i] - b[j]) <= 5):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            want.add((i, j))
    assert got == want
    assert joins.greedy_match(da.where("a_id < 0"), db, ["ta"], ["tb"], 5.0, 2.0).count() == 0


def test_assignment_against_all_permutations():
    r = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 3), (6, 6)):
        for _ in range(20):
            s = r.integers(0, 6, (n, m)).astype(float)
            got = compare.assignment(s)
            t = s if n <= m else s.T
            best = max(sum(t[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(t.shape[1]), t.shape[0]))
            assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
            assert sum(s[i, j] for i, j in got) == best


def test_borders_and_votes(spark):
    rows = [(0, 0.0, 0, 9.0), (1, 0.5, 0, 3.0), (2, 1.2, 1, 4.0), (3, 5.0, 1, 8.0), (4, 9.0, -1, 1.0)]
    p = spark.createDataFrame(rows, "id int, x double, label int, density double")
    assert {r.id: r.label for r in density.trim_borders(p, ["x"], "id", 5, 1.0).collect()} == {0: 0, 1: -1, 2: -1, 3: 1, 4: -1}
    others = spark.createDataFrame([(9, 0.4), (10, 4.8), (11, 99.0)], "id int, x double")
    got = joins.majority_of_nearest(p.where("label >= 0"), others, ["x"], "id", 2.0, 3)
    assert {r.id: r.label for r in got.collect()} == {9: 0, 10: 1, 11: -1}


def test_permuted_labels(spark):
    s = spark.createDataFrame([(i, i % 6 - 1) for i in range(30)], "spike_id int, label int")
    got = labels.permute(s, 3).select("label", "permuted").distinct().collect()
    assert sorted(r.permuted for r in got) == [-1, 0, 1, 2, 3, 4] and {r.permuted for r in got if r.label == -1} == {-1}


def test_number_problems(spark):
    df = spark.createDataFrame([(1.0, 1), (None, None), (float("nan"), 2), (float("-inf"), 3)], "a double, b int").withColumn("c", F.lit(0.0))
    assert [tuple(r) for r in labels.problems(df, ["a", "b"]).collect()] == [("a", 1, 1, 1), ("b", 1, 0, 0)]
