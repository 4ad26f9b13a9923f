"""Merging units: distances between templates under lags, groups from a linkage, and the chains that turn them into new labels. Pair tables and linkages are unit-level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import square
from . import cluster, distances, labels, sortings


def residual_distances(units: DataFrame, most: int, scale_sd: float = 0.0, boundary: float = 0.5, label: str = "label", v: str = "v") -> DataFrame:
    """(i, j, lag, d): what is left of one template, as a share of its square, when the other is subtracted at its best lag (scaled, under a normal prior about 1, if scale_sd is given);
    the lesser of both directions."""
    norms = units.select(F.col(label).alias("_u"), square(F.col(v)).alias("_n"))
    pairs = distances.lagged(units, most, label, v)
    both = pairs.join(norms.withColumnsRenamed({"_u": "i", "_n": "ni"}), "i").join(norms.withColumnsRenamed({"_u": "j", "_n": "nj"}), "j")

    def left(own: str, other: str):
        if not scale_sd:
            return 1 - F.greatest(F.lit(0.0), 2 * F.col("dot") - F.col(other)) / F.col(own)
        inv = 1 / scale_sd**2
        s = F.greatest(F.least((F.col("dot") + inv) / (F.col(other) + inv), F.lit(1 + boundary)), F.lit(1 / (1 + boundary)))
        return 1 - F.greatest(F.lit(0.0), 2 * s * F.col("dot") - s * s * F.col(other)) / F.col(own)

    return both.select("i", "j", "lag", F.least(left("ni", "nj"), left("nj", "ni")).alias("d"))


def cross_distances(first: DataFrame, second: DataFrame, label: str = "label", v: str = "v") -> DataFrame:
    """(i, j, d): of two sets of units: root mean square of the difference over the geometric mean of both root mean squares."""
    a, b = first.select(F.col(label).alias("i"), F.col(v).alias("vi")), second.select(F.col(label).alias("j"), F.col(v).alias("vj"))
    gap = square(F.zip_with("vi", "vj", lambda x, y: x.cast("double") - y))
    return a.join(b).select("i", "j", F.try_divide(F.sqrt(gap), F.sqrt(F.sqrt(square(F.col("vi"))) * F.sqrt(square(F.col("vj"))))).alias("d"))


def nearest_templates(pairs: DataFrame, k: int = 5) -> DataFrame:
    """(i, j, d, rank): the k nearest others of each unit of a table of pairs i < j; equal distances by number."""
    both = pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def tree(dist: np.ndarray, method: str = "complete") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) of an agglomeration, leaves 0 to n - 1 and merge k as n + k; stops where only infinite distances are left."""
    n = len(dist)
    x, name, size, out = dist.astype(float).copy(), list(range(n)), [1] * n, []
    np.fill_diagonal(x, np.inf)
    for k in range(n - 1):
        a, b = sorted(divmod(int(x.argmin()), n))
        if not np.isfinite(x[a, b]):
            break
        out.append((*sorted((name[a], name[b])), float(x[a, b]), size[a] + size[b]))
        if method == "average":
            new = (x[a] * size[a] + x[b] * size[b]) / (size[a] + size[b])
        else:
            new = (np.maximum if method == "complete" else np.minimum)(x[a], x[b])
        x[a], x[:, a], x[b], x[:, b] = new, new, np.inf, np.inf
        x[a, a] = np.inf
        name[a], size[a] = n + k, size[a] + size[b]
    return out


def leaves(merges: list[tuple[int, int, float, int]], n: int) -> list[set[int]]:
    """The leaves under each merge."""
    known: list[set[int]] = [{i} for i in range(n)]
    for a, b, *_ in merges:
        known.append(known[a] | known[b])
    return known[n:]


def largest_below(merges: list[tuple[int, int, float, int]], n: int, most: int, far: float = np.inf) -> list[bool]:
    """Whether a merge is within both limits (size and distance) and its parent isn't."""
    fits = [size <= most and d <= far for _, _, d, size in merges]
    parent = {c: k for k, (a, b, *_) in enumerate(merges) for c in (a, b)}
    return [ok and not ((p := parent.get(n + k)) is not None and fits[p]) for k, ok in enumerate(fits)]


def leaf_groups(merges: list[tuple[int, int, float, int]], n: int, most: int, far: float = np.inf) -> list[list[int]]:
    """All leaves, in the largest groups of the tree that have at most `most` members and merge below `far`; the others alone."""
    groups = [sorted(s) for s, ok in zip(leaves(merges, n), largest_below(merges, n, most, far)) if ok]
    seen = {i for g in groups for i in g}
    return sorted(groups + [[i] for i in range(n) if i not in seen])


def partitions(items: list[int], allowed: Callable[[int, int], bool] = lambda a, b: True) -> Iterator[list[list[int]]]:
    """All partitions of a small set in which members of one part are all allowed beside each other."""
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for found in partitions(rest, allowed):
        yield [[first], *found]
        for k, part in enumerate(found):
            if all(allowed(first, x) for x in part):
                yield [*found[:k], [first, *part], *found[k + 1 :]]


def best_partition(items: list[int], gain: Callable[[tuple[int, ...]], float], allowed: Callable[[int, int], bool] = lambda a, b: True) -> list[list[int]]:
    """The partition whose parts' gains sum highest, of equals the one of more parts; each part is judged once."""
    known: dict[tuple[int, ...], float] = {}

    def total(parts: list[list[int]]) -> float:
        out = 0.0
        for p in parts:
            key = tuple(sorted(p))
            if key not in known:
                known[key] = gain(key)
            out += known[key]
        return out

    return max(partitions(items, allowed), key=lambda p: (total(p), len(p)))


def merge_units(spikes: DataFrame, pairs: DataFrame, threshold: float, method: str = "complete", label: str = "label", t: str = "t", to: str = "merged") -> DataFrame:
    """Labels of groups that a linkage of pairs (i, j, d[, lag]) makes up to threshold; with lags, times move to the group's first unit, by the lag of a direct pair with it."""
    group = cluster.linkage(pairs, threshold, method)
    spark = spikes.sparkSession
    schema = f"{label} {spikes.schema[label].dataType.simpleString()}, new {spikes.schema[label].dataType.simpleString()}"
    names = spark.createDataFrame([(u, g) for u, g in group.items()], schema)
    if "lag" in pairs.columns:
        moves = pairs.select(F.col("i").alias("new"), F.col("j").alias(label), F.col("lag").cast("long").alias("shift")).unionByName(pairs.select(F.col("j").alias("new"), F.col("i").alias(label), (-F.col("lag")).cast("long").alias("shift")))
        names = names.join(moves, [label, "new"], "left").withColumn("shift", F.coalesce("shift", F.lit(0)))
    return distances.relabel(spikes, names, t, label, to)


def agglomerate(spikes: DataFrame, tables: list[tuple[DataFrame, float]], method: str = "complete", depth: str | None = None, label: str = "label") -> DataFrame:
    """Units merged where all tables of pair distances (each with its threshold) agree, numbered without gaps and, if a depth is given, in its order: spikes with `merged`."""
    merged = merge_units(spikes, distances.combined(tables), 1.0, method, label).withColumn("_m", F.col("merged")).drop("merged")
    if depth:
        return labels.reorder_by_depth(merged, depth, "_m", "merged").drop("_m")
    return labels.flatten(merged, "_m", "merged").drop("_m")


def component_distances(rows: DataFrame, v: str = "pcs", label: str = "label") -> DataFrame:
    """(i, j, d): distances between units' mean features over the root mean square spread within both."""
    x = sortings.drop_missing(rows, label).select(label, F.posexplode(v).alias("k", "x")).groupBy(label, "k").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    a = x.select(F.col(label).alias("i"), "k", F.col("m").alias("a"), F.col("s").alias("sa"))
    b = x.select(F.col(label).alias("j"), "k", F.col("m").alias("b"), F.col("s").alias("sb"))
    both = a.join(b, "k").where("i < j").groupBy("i", "j")
    return both.agg(F.try_divide(F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2)), F.sqrt(F.sum(F.col("sa") + F.col("sb")) / 2)).alias("d"))


def drop_units(spikes: DataFrame, units: DataFrame, bad: str, label: str = "label", to: str = "flat") -> DataFrame:
    """Spikes of units (unit, ...) that meet the condition `bad` get -1; the others are numbered without gaps."""
    return sortings.keep_units(spikes, spikes.select(label).distinct().join(units.where(bad).select(F.col("unit").alias(label)), label, "left_anti").where(F.col(label) >= 0), label, to)


def isolation(rows: DataFrame, spike: str = "spike_id", unit: str = "unit", dx: float = 0.5, reach: int = 100, least: int = 5) -> DataFrame:
    """(unit, n, score): of the differences between a spike's best and second log-likelihoods, folded at 0 and smoothed, the density at 0 over its peak; near 0 for units that stand apart,
    1 where the density falls from 0 on. Units with fewer than `least` spikes have none."""
    order = Window.partitionBy(spike).orderBy(F.desc("ll"), unit)
    two = rows.withColumn("_r", F.row_number().over(order)).where("_r <= 2").groupBy(spike).agg(F.max_by(unit, -F.col("_r")).alias("unit"), (F.max("ll") - F.min("ll")).alias("g"), F.count(F.lit(1)).alias("c")).where("c = 2")
    bins = two.groupBy("unit", F.least(F.floor(F.col("g") / dx), F.lit(reach)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    taps = F.explode(F.array(*(F.struct(F.when(F.col("b") + k < 0, -(F.col("b") + k) - 1).otherwise(F.col("b") + k).alias("b"), (F.col("c") * w).alias("c")) for k, w in ((-1, 0.25), (0, 0.5), (1, 0.25))))).alias("p")
    smooth = bins.select("unit", taps).groupBy("unit", "p.b").agg(F.sum("p.c").alias("h"))
    n = bins.groupBy("unit").agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    side = smooth.groupBy("unit").agg(F.coalesce(F.max(F.when(F.col("b") == 0, F.col("h"))), F.lit(0.0)).alias("h0"), F.max("h").alias("top"))
    return n.join(side, "unit").select("unit", "n", F.try_divide("h0", "top").alias("score"))


def isolation_filter(rows: DataFrame, most: float, spike: str = "spike_id", unit: str = "unit", least: int = 5) -> list[int]:
    """Units that stay when the least isolated one is dropped, and the rest scored anew, until all scores are at most `most`; the loop is over units, whose scores alone reach the driver."""
    gone: list[int] = []
    while True:
        left = rows.where(~F.col(unit).isin(gone)) if gone else rows
        scores = isolation(left, spike, unit, least=least).where(F.col("score") > most).orderBy(F.desc("score"), "unit").limit(1).collect()
        if not scores:
            return sorted(r[0] for r in left.select(unit).distinct().collect())
        gone.append(scores[0].unit)
