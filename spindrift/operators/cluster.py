"""Iterative models on feature vectors: principal axes, k-means, a Gaussian mixture with a noise component, linkage of units."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def gramian(rows: DataFrame, v: str, dims: int) -> np.ndarray:
    """Sum of outer products, (dims, dims): partial sums in tasks, so what reaches the driver is dims squared numbers a partition at most."""

    def part(batches):
        g = np.zeros((dims, dims))
        n = 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[v].to_numpy()).astype(float)
                g += x.T @ x
                n += len(x)
        yield pd.DataFrame({"i": np.repeat(np.arange(dims), dims), "j": np.tile(np.arange(dims), dims), "g": g.ravel()})

    got = rows.select(v).mapInPandas(part, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    out = np.zeros((dims, dims))
    out[got["i"], got["j"]] = got["g"]
    return out


def principal_axes(rows: DataFrame, v: str, dims: int, rank: int) -> np.ndarray:
    """Leading axes of the uncentred vectors, each with its largest entry positive."""
    ship(rows.sparkSession)
    w, u = np.linalg.eigh(gramian(rows, v, dims))
    u = u[:, np.argsort(-w, kind="stable")[:rank]].T
    return u * np.sign(u[np.arange(len(u)), np.abs(u).argmax(1)])[:, None]


def project(rows: DataFrame, axes: np.ndarray, v: str, to: str = "pc") -> DataFrame:
    from ..functions.arrays import dot

    return rows.withColumn(to, F.array(*(dot(F.col(v), F.array(*(F.lit(float(x)) for x in a))) for a in axes)))


def kmeans(rows: DataFrame, v: str, k: int, seed: int = 0, steps: int = 50, to: str = "cluster") -> DataFrame:
    model = KMeans(k=k, seed=seed, maxIter=steps, initMode="k-means||", featuresCol="_f", predictionCol=to).fit(rows.withColumn("_f", array_to_vector(F.col(v).cast("array<double>"))))
    return model.transform(rows.withColumn("_f", array_to_vector(F.col(v).cast("array<double>")))).drop("_f")


def mixture(rows: DataFrame, v: str, dims: int, centres: np.ndarray, noise: float = 1e-3, steps: int = 30, tol: float = 1e-4, variance: float = 1.0, proportions: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, list[float]]:
    """EM of isotropic components and one uniform noise component: (means, proportions, variance, ELBO by step), from the given centres, variance and proportions (default: all equal).

    The table is read once a step; each task gives its sufficient statistics, one row, and parameters are a unit-level table on the driver.
    """
    ship(rows.sparkSession)
    mu, var, elbo = centres.astype(float), variance, []
    pi = np.full(len(mu) + 1, 1 / (len(mu) + 1)) if proportions is None else proportions
    k = len(mu)
    for _ in range(steps):
        state = (mu, pi, var)

        def part(batches, state=state):
            mu, pi, var = state
            n, s, q, ll, m = np.zeros(k + 1), np.zeros((k, dims)), 0.0, 0.0, 0
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf[v].to_numpy()).astype(float)
                d2 = ((x[:, None] - mu[None]) ** 2).sum(2)
                lp = np.concatenate([np.log(pi[:k]) - 0.5 * d2 / var - 0.5 * dims * np.log(2 * np.pi * var), np.full((len(x), 1), np.log(pi[k]) + np.log(noise))], 1)
                top = lp.max(1, keepdims=True)
                lse = top[:, 0] + np.log(np.exp(lp - top).sum(1))
                r = np.exp(lp - lse[:, None])
                n += r.sum(0)
                s += r[:, :k].T @ x
                q += float((r[:, :k] * (x * x).sum(1)[:, None]).sum())
                ll += float(lse.sum())
                m += len(x)
            sums = np.concatenate([n, s.ravel(), [q, ll, m]])
            yield pd.DataFrame({"i": range(len(sums)), "x": sums})

        # entry by entry, so partial sums meet in the executors and not on the driver
        got = rows.select(v).mapInPandas(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros(k + 1 + k * dims + 3)
        flat[got["i"]] = got["x"]
        n, s, (q, ll, m) = flat[: k + 1], flat[k + 1 : -3].reshape(k, dims), flat[-3:]
        if not m:
            break
        pi = np.maximum(n / m, 1e-12)
        mu = s / np.maximum(n[:k, None], 1e-12)
        var = max(float((q - (n[:k, None] * mu * mu).sum()) / (dims * max(n[:k].sum(), 1e-12))), 1e-9)
        elbo.append(ll / m)
        if len(elbo) > 1 and elbo[-1] - elbo[-2] < tol:
            break
    return mu, pi, var, elbo


def linkage(distances: DataFrame, threshold: float, method: str = "complete", i: str = "i", j: str = "j", d: str = "d") -> dict[int, int]:
    """Groups of units by agglomeration up to threshold; a unit-level table, so it runs on the driver. A pair that isn't given counts as infinitely far; units without any
    pair up to threshold are left out. Only single linkage may leave out pairs beyond the threshold: the mean and the greatest distance of groups need them all."""
    got = (distances.where(F.col(d) <= threshold) if method == "single" else distances).select(i, j, d).toPandas()
    units = sorted({*got[i], *got[j]})
    at, n = {u: k for k, u in enumerate(units)}, len(units)
    x = np.full((n, n), np.inf)
    for a, b, v in got.itertuples(index=False):
        x[at[a], at[b]] = x[at[b], at[a]] = v
    np.fill_diagonal(x, np.inf)
    near = x.min(1, initial=np.inf) <= threshold
    size, group = np.ones(n), np.arange(n)
    while n > 1:
        a, b = sorted(divmod(int(x.argmin()), n))
        if not x[a, b] <= threshold:
            break
        # the distances of the merged group from those of its halves
        if method == "average":
            new = (x[a] * size[a] + x[b] * size[b]) / (size[a] + size[b])
        else:
            new = (np.maximum if method == "complete" else np.minimum)(x[a], x[b])
        x[a], x[:, a] = new, new
        x[b], x[:, b], x[a, a] = np.inf, np.inf, np.inf
        size[a] += size[b]
        group[group == b] = a
    return {u: units[group[k]] for u, k in at.items() if near[k]}
