"""Comparing two labelings: co-counts, agreement, precision, recall."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n), -1 and null left out."""
    return rows.where((F.coalesce(x, F.lit(-1)) >= 0) & (F.coalesce(y, F.lit(-1)) >= 0)).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame, x: str, y: str) -> DataFrame:
    """iou, precision and recall of each pair of labels, from the pair table alone."""
    c = confusion(rows, x, y)
    nx, ny = c.groupBy(x).agg(F.sum("n").alias("nx")), c.groupBy(y).agg(F.sum("n").alias("ny"))
    j = c.join(nx, x).join(ny, y)
    return j.select(x, y, "n", (F.col("n") / F.greatest(F.col("nx") + F.col("ny") - F.col("n"), F.lit(1))).alias("iou"), (F.col("n") / F.greatest("ny", F.lit(1))).alias("precision"), (F.col("n") / F.greatest("nx", F.lit(1))).alias("recall"))


def best_matches(agreed: DataFrame, x: str, y: str, score: str = "iou") -> DataFrame:
    """For each x the y of the best score, of equals the smaller."""
    best = agreed.groupBy(x).agg(F.max(F.struct(F.col(score), (-F.col(y)).alias("y"))).alias("m"))
    return best.select(x, (-F.col("m.y")).alias(y), F.col(f"m.{score}").alias(score))


def rand_index(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rand and adjusted Rand index from sums over the pair table."""
    c = confusion(rows, x, y)
    two = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    s = c.agg(two("n").alias("both"), F.sum("n").alias("total"))
    a = c.groupBy(x).agg(F.sum("n").alias("k")).agg(two("k").alias("a"))
    b = c.groupBy(y).agg(F.sum("n").alias("k")).agg(two("k").alias("b"))
    j = s.join(a).join(b).withColumn("t", F.col("total") * (F.col("total") - 1) / 2)
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("t"))
    return j.select(F.try_divide(F.col("t") + 2 * F.col("both") - F.col("a") - F.col("b"), F.col("t")).alias("rand"), F.try_divide(F.col("both") - expected, (F.col("a") + F.col("b")) / 2 - expected).alias("adjusted_rand"))


def unit_performance(categories: DataFrame, truth: DataFrame, tested: DataFrame, label: str = "label") -> DataFrame:
    """accuracy, recall and precision of each matched kind: categories (a_id, b_id, category) with the labels of truth (a_id) and tested (b_id)."""
    x = categories.join(truth.select("a_id", F.col(label).alias("_la")), "a_id", "left").join(tested.select("b_id", F.col(label).alias("_lb")), "b_id", "left")
    is_ = lambda c: F.sum(F.when(F.col("category") == c, 1).otherwise(0))
    by = x.withColumn(label, F.coalesce("_la", "_lb")).groupBy(label).agg(is_("TP").alias("tp"), is_("FN").alias("fn"), is_("FP").alias("fp"))
    tp = F.col("tp")
    return by.select(label, "tp", "fn", "fp", F.try_divide(tp, tp + F.col("fn") + F.col("fp")).alias("accuracy"), F.try_divide(tp, tp + F.col("fn")).alias("recall"), F.try_divide(tp, tp + F.col("fp")).alias("precision"))


def misalignment(pairs: DataFrame, ta: str = "ta", tb: str = "tb", label: str = "label") -> DataFrame:
    """(label, rms): root of the mean squared time between matched spikes."""
    gap = (F.col(tb) - F.col(ta)).cast("double")
    return pairs.groupBy(label).agg(F.sqrt(F.avg(gap * gap)).alias("rms"))


def melted(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """A row for each metric of each row: (ids, metric, value)."""
    return df.unpivot(ids, [*metrics], "metric", "value")


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the greatest total score, as many as the smaller side has. A table of units, on the driver.

    Rows enter one by one; each finds the cheapest chain of exchanges to a free column under prices that keep all costs at least zero.
    """
    if score.shape[0] > score.shape[1]:
        return sorted((i, j) for j, i in assignment(score.T))
    cost = -np.asarray(score, float)
    n, m = cost.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for new in range(n):
        gap, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, reached = new, -1, 0.0
        while True:
            better = ~done & (reached + cost[row] - row_price[row] - col_price < gap)
            gap[better] = (reached + cost[row] - row_price[row] - col_price)[better]
            came[better] = at
            at = int(np.where(done, np.inf, gap).argmin())
            reached = gap[at]
            if owner[at] < 0:
                break
            done[at] = True
            row = owner[at]
        row_price[new] += reached
        for j in np.flatnonzero(done):
            row_price[owner[j]] += reached - gap[j]
            col_price[j] -= reached - gap[j]
        while came[at] >= 0:
            owner[at] = owner[came[at]]
            at = int(came[at])
        owner[at] = new
    return sorted((int(i), j) for j, i in enumerate(owner.tolist()) if i >= 0)
