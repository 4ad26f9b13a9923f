"""Clusterers by name and chains of refinements; seeding, restarts, isotropic mixtures with few candidates, density peaks of a mixture's components, and stitching of clusterings by time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import ship
from . import cluster, density, joins
from .sums import summed


def seeds(rows: DataFrame, v: str, k: int, seed: int = 0, key: str = "spike_id", least: float = 0.0) -> np.ndarray:
    """k-means++: each next centre is drawn with a probability in proportion to the squared distance from those before, by the greatest of weighted keys that follow from a row's id and the seed;
    one row a round reaches the driver. It ends early where all rows are within `least` of a centre."""
    ship(rows.sparkSession)
    x = rows.select(key, F.col(v).cast("array<double>").alias("_v"))
    unit = lambda n: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(n)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    centres = [np.array(r["_v"]) for r in x.orderBy(unit(0), key).limit(1).collect()]
    while centres and len(centres) < k:

        def reach(batches, now=np.stack(centres)):
            for pdf in batches:
                if len(pdf):
                    v = np.stack(pdf["_v"].to_numpy()).astype(float)
                    d2 = np.full(len(v), np.inf)
                    for c in now:
                        d2 = np.minimum(d2, ((v - c) ** 2).sum(1))
                    yield pdf.assign(_d=d2)

        # of exponential variables with these rates the least is a draw in proportion to them
        far = x.mapInPandas(reach, StructType([*x.schema.fields, StructField("_d", DoubleType())])).where(F.col("_d") > max(least, 0.0) ** 2)
        got = far.orderBy(-F.log(unit(len(centres))) / F.col("_d"), key).limit(1).collect()
        if not got:
            break
        centres.append(np.array(got[0]["_v"]))
    return np.stack(centres) if centres else np.zeros((0, 0))


def lloyd(rows: DataFrame, v: str, centres: np.ndarray, steps: int = 20, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """k-means from given centres: (centres, mean squared distance). One action a step, sums and counts are added up in the executors. An empty cluster keeps its centre."""
    ship(rows.sparkSession)
    k, dims = centres.shape
    last = np.inf
    for _ in range(steps):
        now = centres

        def part(batches, now=now):
            n, s, e = np.zeros(k), np.zeros((k, dims)), 0.0
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf[v].to_numpy()).astype(float)
                    d2 = ((x * x).sum(1)[:, None] - 2 * x @ now.T + (now * now).sum(1)[None]).clip(0)
                    at = d2.argmin(1)
                    n += np.bincount(at, minlength=k)
                    np.add.at(s, at, x)
                    e += float(d2[np.arange(len(x)), at].sum())
            return np.concatenate([n, s.ravel(), [e]])

        flat = summed(rows.select(v), part)
        if not len(flat):
            break
        n, s, e = flat[:k], flat[k:-1].reshape(k, dims), float(flat[-1])
        centres = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres)
        mean = e / max(n.sum(), 1)
        if last - mean <= tol * max(mean, 1e-30):
            break
        last = mean
    return centres, mean


def restarts(rows: DataFrame, v: str, k: int, tries: int = 5, seed: int = 0, key: str = "spike_id", steps: int = 20) -> np.ndarray:
    """The best of several runs of k-means, each from its own seeds."""
    runs = [lloyd(rows, v, seeds(rows, v, k, seed + i, key), steps) for i in range(tries)]
    return min(runs, key=lambda r: r[1])[0]


def truncated_mixture(rows: DataFrame, v: str, centres: np.ndarray, near: int = 5, steps: int = 20, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Isotropic mixture of one variance in which a row's responsibilities are shared by the `near` likeliest components only: (means, proportions, variance). One action a step."""
    ship(rows.sparkSession)
    k, dims = centres.shape
    mu, pi, var, last = centres.astype(float), np.full(k, 1 / k), 1.0, -np.inf
    for _ in range(steps):
        state = (mu, pi, var)

        def part(batches, state=state):
            mu, pi, var = state
            n, s, q, ll, m = np.zeros(k), np.zeros((k, dims)), 0.0, 0.0, 0
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf[v].to_numpy()).astype(float)
                d2 = ((x * x).sum(1)[:, None] - 2 * x @ mu.T + (mu * mu).sum(1)[None]).clip(0)
                lp = np.log(np.maximum(pi, 1e-300)) - d2 / (2 * var) - 0.5 * dims * np.log(2 * np.pi * var)
                if near < k:
                    out = np.argpartition(-lp, near - 1, axis=1)[:, near:]
                    np.put_along_axis(lp, out, -np.inf, 1)
                top = lp.max(1, keepdims=True)
                r = np.exp(lp - top)
                total = r.sum(1, keepdims=True)
                r /= total
                n, s, q = n + r.sum(0), s + r.T @ x, q + float((r * d2).sum())
                ll, m = ll + float((top + np.log(total)).sum()), m + len(x)
            return np.concatenate([n, s.ravel(), [q, ll, m]])

        flat = summed(rows.select(v), part)
        if not len(flat):
            break
        n, s, q, ll, m = flat[:k], flat[k:-3].reshape(k, dims), flat[-3], flat[-2], max(flat[-1], 1.0)
        new = np.where(n[:, None] > 1e-9, s / np.maximum(n, 1e-9)[:, None], mu)
        # squares about the old means, less what the means moved
        var = max((q - float((n * ((new - mu) ** 2).sum(1)).sum())) / (dims * m), 1e-12)
        mu, pi = new, n / m
        if ll / m - last <= tol:
            break
        last = ll / m
    return mu, pi, var


def component_parents(mu: np.ndarray, pi: np.ndarray, var: float, reach: float = 0.9) -> np.ndarray:
    """Groups of a mixture's components: each joins the nearest one of a higher proportion by Hellinger distance, if that is below `reach`; the root's number is the group's."""
    k = len(mu)
    d2 = ((mu[:, None] - mu[None]) ** 2).sum(2)
    h = np.sqrt(1 - np.exp(-d2 / (8 * var)))
    higher = (pi[None] > pi[:, None]) | ((pi[None] == pi[:, None]) & (np.arange(k)[None] < np.arange(k)[:, None]))
    h = np.where(higher, h, np.inf)
    parent = np.where(h.min(1, initial=np.inf) <= reach, h.argmin(1), np.arange(k))
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent


def mixture_peaks(rows: DataFrame, v: str, components: int, seed: int = 0, key: str = "spike_id", reach: float = 0.9, near: int = 5, to: str = "cluster") -> DataFrame:
    """Density peaks by way of a mixture with more components than clusters, which are then joined to denser ones; rows go to their nearest component's group."""
    mu, pi, var = truncated_mixture(rows, v, seeds(rows, v, components, seed, key), near)
    group = component_parents(mu, pi, var, reach)
    dist = F.array(*(F.aggregate(F.zip_with(F.col(v).cast("array<double>"), F.array(*(F.lit(float(c)) for c in m)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for m in mu))
    at = F.array_position(dist, F.array_min(dist)) - 1
    return rows.withColumn(to, F.element_at(F.array(*(F.lit(int(g)) for g in group)), (at + 1).cast("int")))


def stitched(parts: DataFrame, centres: DataFrame, most: float) -> DataFrame:
    """Clusterings of successive chunks made one: (chunk, cluster, label) from their centres (chunk, cluster, v, n).

    From each chunk to the next, clusters that are each other's nearest within `most` are the same; the chains so linked are the labels. Centres are a small table: a join of neighbouring
    chunks and the components of the links. parts is only asked which clusters it has."""
    from ..functions.arrays import square
    from .graph import connected_components

    named = centres.withColumn("node", F.concat_ws(":", "chunk", "cluster"))
    a = named.select(F.col("chunk").alias("c"), F.col("node").alias("a"), F.col("v").alias("va"))
    b = named.select((F.col("chunk") - 1).alias("c"), F.col("node").alias("b"), F.col("v").alias("vb"))
    d = F.sqrt(square(F.zip_with("va", "vb", lambda x, y: x.cast("double") - y)))
    near = a.join(b, "c").withColumn("d", d).where(F.col("d") <= most)
    ahead = near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    back = near.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select("b", F.col("m.a").alias("a"))
    comps = connected_components(named, ahead.join(back, ["a", "b"]), node="node")
    from pyspark.sql import Window

    roots = comps.select("component").distinct().withColumn("label", F.row_number().over(Window.orderBy("component")) - 1)
    known = named.join(comps, "node").join(roots, "component").select("chunk", "cluster", "label")
    return known.join(parts.select("chunk", "cluster").distinct(), ["chunk", "cluster"], "left_semi")


#: Clusterers by name: functions of (spikes, settings) that add `label`.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "none": lambda s, **_: s,
    "channel": lambda s, channel="channel", **_: s.withColumn("label", F.col(channel)),
    "grid": lambda s, dx=15.0, dz=15.0, **_: joins.grid_snap(s, dx, dz),
    "density_peaks": lambda s, axes=("x", "z"), key="spike_id", sigma=5.0, **how: s.join(density.density_peaks(s, list(axes), key, sigma, **how).select(key, "label"), key),
    "kmeans": lambda s, v="feature", k=10, seed=0, **_: cluster.kmeans(s, v, k, seed, to="label"),
    "mixture_peaks": lambda s, v="feature", components=20, **how: mixture_peaks(s, v, components, to="label", **how),
}


def clusterer(strategy: str, refinements: list[Callable[[DataFrame], DataFrame]] = [], **settings) -> Callable[[DataFrame], DataFrame]:  # noqa: B006
    """A function from spikes to labelled spikes: a clusterer by name, then refinements in order."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no clusterer {strategy!r}; there are {sorted(STRATEGIES)}")

    def run(spikes: DataFrame) -> DataFrame:
        out = STRATEGIES[strategy](spikes, **settings)
        for step in refinements:
            out = step(out)
        return out

    return run
