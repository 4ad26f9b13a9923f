"""Refining a mixture of isotropic components: splits, merges and removals that raise a criterion on held-out rows.

The criterion is the mean log-evidence less alpha times the mean entropy of responsibilities. Models are unit-level tables on the driver; each round reads the
rows once for all its proposals, and a task gives one number a proposal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import ship
from .cluster import mixture


@dataclass(frozen=True)
class Model:
    """Means, proportions (the last one is the noise's), one variance, and the density of noise."""

    means: np.ndarray
    proportions: np.ndarray
    variance: float
    noise: float = 1e-3

    def log_likelihoods(self, x: np.ndarray) -> np.ndarray:
        """(rows, units + 1), noise last, proportions included."""
        d2 = np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.means.T + (self.means**2).sum(1), 0)
        own = np.log(np.maximum(self.proportions[:-1], 1e-300)) - 0.5 * d2 / self.variance - 0.5 * x.shape[1] * np.log(2 * np.pi * self.variance)
        return np.concatenate([own, np.full((len(x), 1), np.log(max(self.proportions[-1], 1e-300) * self.noise))], 1)


def assigned(rows: DataFrame, v: str, m: Model, *keep: str, noise_prior: str | None = None) -> DataFrame:
    """The columns `keep`, label (the likeliest of a model's components, -1 for the noise) and r, its responsibility: proportions, variance and noise included; of equal ones the first.

    noise_prior names a column with the log probability that noise is detected as this row was (embedded.EmbeddedNoise.detection_prior of its unit or channel); the noise's log likelihood is raised by as much as that lies below 0, as rows
    are detections. A null counts as 0.
    """
    ship(rows.sparkSession)
    kept = rows.select(*keep, F.col(v).cast("array<double>").alias("_v"), (F.coalesce(noise_prior, F.lit(0.0)) if noise_prior else F.lit(0.0)).alias("_z"))

    def over(batches):
        for pdf in batches:
            if len(pdf):
                ll = m.log_likelihoods(np.stack(pdf["_v"].to_numpy()).astype(float))
                ll[:, -1] -= pdf["_z"].to_numpy(float)
                at = ll.argmax(1)
                top = ll[np.arange(len(ll)), at]
                r = 1 / np.exp(ll - top[:, None]).sum(1)
                yield pdf[list(keep)].assign(label=np.where(at == ll.shape[1] - 1, -1, at), r=r)

    return kept.mapInPandas(over, StructType([*rows.select(*keep).schema.fields, StructField("label", LongType()), StructField("r", DoubleType())]))


def merged(m: Model, group: list[int]) -> Model:
    """The units of group as one, of their total proportion and mean; it takes the place of the first."""
    w = m.proportions[group]
    means, pi = m.means.copy(), m.proportions.copy()
    means[group[0]], pi[group[0]] = w @ m.means[group] / max(w.sum(), 1e-300), w.sum()
    keep = [i for i in range(len(means)) if i == group[0] or i not in group]
    return Model(means[keep], pi[[*keep, len(means)]], m.variance, m.noise)


def without(m: Model, units: list[int]) -> Model:
    """The model without some units; the others' proportions grow alike."""
    keep = [i for i in range(len(m.means)) if i not in units]
    pi = m.proportions[[*keep, len(m.means)]]
    return Model(m.means[keep], pi / pi.sum(), m.variance, m.noise)


def criteria(rows: DataFrame, v: str, models: list[Model], alpha: float = 1.0) -> np.ndarray:
    """The criterion of each model, from one reading of the rows."""
    ship(rows.sparkSession)

    def part(batches):
        out, n = np.zeros(len(models)), 0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[v].to_numpy()).astype(float)
            n += len(x)
            for k, m in enumerate(models):
                ll = m.log_likelihoods(x)
                top = ll.max(1, keepdims=True)
                e = np.exp(ll - top)
                lse = top[:, 0] + np.log(e.sum(1))
                r = e / e.sum(1, keepdims=True)
                # sum of -r ln r is the log-evidence less the mean of ll under r
                out[k] += float((lse - alpha * (lse - (r * np.where(r > 0, ll, 0)).sum(1))).sum())
        yield pd.DataFrame({"k": range(len(models)), "s": out, "n": n})

    got = rows.select(v).mapInPandas(part, "k int, s double, n long").groupBy("k").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("c")).toPandas()
    out = np.full(len(models), -np.inf)
    out[got["k"]] = got["c"]
    return out


def _greedy(rows: DataFrame, v: str, m: Model, proposals: list[tuple[list[int], Model]], alpha: float) -> list[list[int]]:
    """The proposals that improve the model by themselves, best first, no unit in two of them."""
    if not proposals:
        return []
    score = criteria(rows, v, [m, *(p for _, p in proposals)], alpha)
    used, out = set(), []
    for k in np.argsort(-score[1:], kind="stable"):
        if score[1 + k] > score[0] and not used & set(proposals[k][0]):
            used |= set(proposals[k][0])
            out.append(proposals[k][0])
    return out


def merge_step(rows: DataFrame, v: str, m: Model, most: float, alpha: float = 1.0) -> Model:
    """Merges pairs of units no further than `most` apart, disjoint pairs at once; a set of them that doesn't improve the model together is cut to its best."""
    gap = np.sqrt(((m.means[:, None] - m.means[None]) ** 2).sum(-1))
    near = [[i, j] for i in range(len(m.means)) for j in range(i + 1, len(m.means)) if gap[i, j] <= most]
    return _apply(rows, v, m, _greedy(rows, v, m, [(p, merged(m, p)) for p in near], alpha), merged, alpha)


def remove_step(rows: DataFrame, v: str, m: Model, alpha: float = 1.0) -> Model:
    """Removes units whose absence improves the model, never all of them."""
    alone = [([i], without(m, [i])) for i in range(len(m.means))] if len(m.means) > 1 else []
    return _apply(rows, v, m, _greedy(rows, v, m, alone, alpha)[: max(len(m.means) - 1, 0)], without, alpha)


def _apply(rows: DataFrame, v: str, m: Model, groups: list[list[int]], change, alpha: float) -> Model:
    def all_(some: list[list[int]]) -> Model:
        out = m
        # from the highest unit down, so the numbers of those before hold
        for g in sorted(some, key=lambda g: -g[-1]):
            out = change(out, g)
        return out

    if len(groups) < 2:
        return all_(groups)
    both = [all_(groups), all_(groups[:1])]
    return both[int(criteria(rows, v, both, alpha).argmax())]



def split_step(train: DataFrame, held: DataFrame, v: str, m: Model, alpha: float = 1.0, steps: int = 5) -> Model:
    """Each unit is cut in two across its widest axis, cuts that improve the held-out criterion are made together and fitted for some steps, and the result stays if it is better still."""
    dims, k = m.means.shape[1], len(m.means)
    ship(train.sparkSession)
    train = train.select(v)

    def part(batches):
        c = np.zeros((k, dims, dims))
        n = np.zeros(k)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[v].to_numpy()).astype(float)
                own = m.log_likelihoods(x).argmax(1)
                for u in np.unique(own[own < k]):
                    y = x[own == u] - m.means[u]
                    c[u] += y.T @ y
                    n[u] += len(y)
        yield pd.DataFrame({"u": range(k), "n": n, "c": [a.ravel().tolist() for a in c]})

    got = train.select(v).mapInPandas(part, "u int, n double, c array<double>")
    # entry by entry, so partial sums meet in the executors
    long = got.select("u", F.posexplode("c").alias("i", "x")).groupBy("u", "i").agg(F.sum("x").alias("x")).toPandas()
    counts = got.groupBy("u").agg(F.sum("n").alias("n")).toPandas().set_index("u")["n"]
    cov = np.zeros((k, dims * dims))
    cov[long["u"], long["i"]] = long["x"]
    wide = [u for u in range(k) if counts.get(u, 0) >= 4]
    axes = {u: np.linalg.eigh(cov[u].reshape(dims, dims))[1][:, -1] for u in wide}

    def sides(batches):
        n, t = np.zeros((k, 2)), np.zeros((k, 2, dims))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[v].to_numpy()).astype(float)
                own = m.log_likelihoods(x).argmax(1)
                for u in wide:
                    y = x[own == u]
                    right = (y - m.means[u]) @ axes[u] > 0
                    for side in (0, 1):
                        n[u, side] += (right == side).sum()
                        t[u, side] += y[right == side].sum(0)
        yield pd.DataFrame({"i": range(2 * k * (dims + 1)), "x": np.concatenate([n.ravel(), t.ravel()])})

    sums = train.select(v).mapInPandas(sides, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(2 * k * (dims + 1))
    flat[sums["i"]] = sums["x"]
    n, t = flat[: 2 * k].reshape(k, 2), flat[2 * k :].reshape(k, 2, dims)
    total, scatter, proposals = max(float(counts.sum()), 1.0), float(cov[:, :: dims + 1].sum()), []
    for u in wide:
        if n[u].min() < 2:
            continue
        halves = t[u] / n[u][:, None]
        # the variance is what the halves' means leave of the scatter about the units' means
        between = float(n[u] @ ((halves - m.means[u]) ** 2).sum(1))
        means = np.concatenate([m.means, halves[1:]])
        means[u] = halves[0]
        share = m.proportions[u] * n[u] / n[u].sum()
        pi = np.concatenate([m.proportions[:-1], share[1:], m.proportions[-1:]])
        pi[u] = share[0]
        proposals.append(([u], Model(means, pi, max((scatter - between) / (total * dims), 1e-9), m.noise)))
    kept = [g[0] for g in _greedy(held, v, m, proposals, alpha)]
    if not kept:
        return m
    cut = {g[0]: p for g, p in proposals}
    start = np.concatenate([np.stack([cut[u].means[u] if u in kept else m.means[u] for u in range(k)]), np.stack([cut[u].means[-1] for u in kept])])
    mu, pi, var, _ = mixture(train, v, dims, start, m.noise, steps, variance=m.variance)
    fitted = Model(mu, pi, var, m.noise)
    score = criteria(held, v, [m, fitted], alpha)
    return fitted if score[1] > score[0] else m


def refine(train: DataFrame, held: DataFrame, v: str, m: Model, most: float, rounds: int = 3, alpha: float = 1.0, steps: int = 10) -> Model:
    """Rounds of fit, split, merge and removal, until a round changes no unit."""
    for _ in range(rounds):
        mu, pi, var, _ = mixture(train, v, m.means.shape[1], m.means, m.noise, steps, variance=m.variance, proportions=m.proportions)
        m = Model(mu, pi, var, m.noise)
        before = m
        m = split_step(train, held, v, m, alpha)
        m = merge_step(held, v, m, most, alpha)
        m = remove_step(held, v, m, alpha)
        if len(m.means) == len(before.means):
            break
    return m
