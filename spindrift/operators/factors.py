"""A mixture of low-rank Gaussians over known noise, on rows that each see only some entries (a neighbourhood's channels).

A unit's rows are mean + basis z + noise, z standard normal; what a row doesn't see is integrated out. Each row keeps its best `top` units of those that its neighbourhood
allows (truncation), all of which are scored, so no state is stored between passes and a lost executor's part comes out the same. Models are unit-level tables on the driver
and go along with the functions; a pass gives one row of sums a unit and task, added in two levels.

Rows have the columns v (array, entries as the neighbourhood lists them) and hood (int). Rows without v, or of another length than their neighbourhood's, or with entries that
are null or not finite, are not learnt from and get unit -1 with null scores.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.bundles import load_arrays, save_arrays
from . import merging

SCORES = "unit int, score double, cand array<struct<unit:int,ll:double,r:double>>, noise_ll double, noise_r double"


@dataclass(frozen=True)
class Factors:
    """means (units, entries), bases (units, entries, rank), proportions (units + 1, the noise's last), noise covariance, entries each neighbourhood sees, units it allows."""

    means: np.ndarray
    bases: np.ndarray
    proportions: np.ndarray
    noise: np.ndarray
    seen: list[np.ndarray]
    allowed: list[np.ndarray]

    def view(self, hood: int) -> View:
        return View(self, hood)


class View:
    """A model as one neighbourhood sees it: all that doesn't depend on rows."""

    def __init__(self, m: Factors, hood: int) -> None:
        at, self.units = m.seen[hood], m.allowed[hood]
        self.at, self.rank = at, m.bases.shape[2]
        root = np.linalg.cholesky(m.noise[np.ix_(at, at)])
        self.white = np.linalg.inv(root)
        self.const = 2 * np.log(np.diag(root)).sum() + len(at) * np.log(2 * np.pi)
        self.mu = m.means[self.units][:, at] @ self.white.T
        self.w = np.einsum("ij,kjr->kir", self.white, m.bases[self.units][:, at])
        inner = np.eye(self.rank) + np.einsum("kir,kis->krs", self.w, self.w)
        self.post = np.linalg.inv(inner)
        self.logdet = np.linalg.slogdet(inner)[1]
        with np.errstate(divide="ignore"):
            self.log_pi, self.noise_pi = np.log(m.proportions[self.units]), np.log(m.proportions[-1])

    def log_likelihoods(self, x: np.ndarray) -> np.ndarray:
        """(rows, allowed units + 1), the noise last, proportions included."""
        y = x @ self.white.T
        out = np.empty((len(x), len(self.units) + 1))
        for k in range(len(self.units)):
            d = y - self.mu[k]
            b = d @ self.w[k]
            out[:, k] = self.log_pi[k] - 0.5 * ((d * d).sum(1) - ((b @ self.post[k]) * b).sum(1) + self.const + self.logdet[k])
        out[:, -1] = self.noise_pi - 0.5 * ((y * y).sum(1) + self.const)
        return out

    def latents(self, x: np.ndarray, k: int) -> np.ndarray:
        """Posterior means of the k-th allowed unit's z."""
        return (x @ self.white.T - self.mu[k]) @ self.w[k] @ self.post[k]


def allowed_units(means: np.ndarray, seen: list[np.ndarray], least: float = 0.5) -> list[np.ndarray]:
    """For each neighbourhood the units of whose squared mean it sees at least a share; where there's none, the one of which it sees most."""
    square = means**2
    total = np.maximum(square.sum(1), 1e-300)
    out = []
    for at in seen:
        share = square[:, at].sum(1) / total
        own = np.flatnonzero(share >= least)
        out.append(own if len(own) or not len(means) else np.array([int(share.argmax())]))
    return out


def truncated(ll: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities over a row's best `top` units and the noise, and its log-evidence over them. Of equal units the first stays."""
    if ll.shape[1] - 1 > top:
        ll = ll.copy()
        rank = np.argsort(np.argsort(-ll[:, :-1], axis=1, kind="stable"), axis=1, kind="stable")
        ll[:, :-1][rank >= top] = -np.inf
    best = ll.max(1, keepdims=True)
    best = np.where(np.isfinite(best), best, 0.0)
    e = np.exp(ll - best)
    total = e.sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        return e / np.maximum(total, 1e-300), best[:, 0] + np.log(total[:, 0])


def _usable(pdf: pd.DataFrame, sizes: list[int]) -> np.ndarray:
    ok = np.zeros(len(pdf), bool)
    for i, (v, h) in enumerate(zip(pdf["v"], pdf["hood"])):
        if v is not None and h == h and 0 <= h < len(sizes) and len(v) == sizes[int(h)]:
            ok[i] = np.isfinite(np.asarray(v, float)).all()
    return ok


def _groups(pdf: pd.DataFrame, sizes: list[int]):
    """(neighbourhood, row numbers, rows) of a batch's usable rows."""
    ok = np.flatnonzero(_usable(pdf, sizes))
    hoods = pdf["hood"].to_numpy()[ok]
    for h in np.unique(hoods):
        at = ok[hoods == h]
        yield int(h), at, np.stack([np.asarray(v, float) for v in pdf["v"].iloc[at]])


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Arrays (unit, salt, s) summed by unit, in two levels so that no group holds an array for each task."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"unit": pdf["unit"].iloc[:1], "s": [np.sum(np.stack(pdf["s"].to_numpy()), axis=0)]})

    once = parts.groupBy("unit", "salt").applyInPandas(total, "unit int, s array<double>")
    got = once.groupBy("unit").applyInPandas(total, "unit int, s array<double>").toPandas()
    return {int(u): np.asarray(s, float) for u, s in zip(got["unit"], got["s"])}


def sums(rows: DataFrame, m: Factors, top: int = 3, label: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass: by unit the sums of r x z~' (units, entries, rank + 1) and r z~ z~' with z~ = (z, 1), the noise's weight and (log-evidence, entropy, rows).

    With a label column responsibilities are fixed: 1 for the labelled unit; labels that the model doesn't have are noise. Unseen entries of x are taken as their posterior means.
    """
    ship(rows.sparkSession)
    units, dims, rank = m.bases.shape
    sizes = [len(s) for s in m.seen]

    def part(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        salt, views, acc, extra = (context.partitionId() if context else 0) % 64, {}, {}, np.zeros(4)
        for pdf in batches:
            for h, at, x in _groups(pdf, sizes):
                if h not in views:
                    v = m.view(h)
                    miss = np.setdiff1d(np.arange(dims), v.at)
                    views[h] = v, miss, m.noise[np.ix_(miss, v.at)] @ v.white.T @ v.white
                v, miss, fill = views[h]
                names = v.units
                if label is None:
                    ll = v.log_likelihoods(x)
                    r, lse = truncated(ll, top)
                    extra[:3] += lse.sum(), (lse - (r * np.where(r > 0, ll, 0)).sum(1)).sum(), len(x)
                else:
                    given = pdf[label].to_numpy()[at]
                    own = np.array([u for u in np.unique(given[~pd.isna(given)]).astype(int) if 0 <= u < units], int)
                    names = own
                    r = np.concatenate([given[:, None] == own[None], np.zeros((len(x), 1))], 1).astype(float)
                    r[:, -1] = 1 - r[:, :-1].sum(1)
                    extra[2] += len(x)
                    v = View(replace(m, allowed=[own if i == h else a for i, a in enumerate(m.allowed)]), h)
                extra[3] += r[:, -1].sum()
                for k, u in enumerate(names):
                    on = r[:, k] > 0
                    if not on.any():
                        continue
                    w, y = r[on, k], x[on]
                    z = np.concatenate([v.latents(y, k), np.ones((len(y), 1))], 1)
                    zz = (z * w[:, None]).T @ z
                    zz[:rank, :rank] += w.sum() * v.post[k]
                    xz = np.zeros((dims, rank + 1))
                    xz[v.at] = (y * w[:, None]).T @ z
                    # a missing entry is mean + basis z + what its noise shares with the noise seen
                    mu, b = m.means[u], m.bases[u]
                    base = mu[miss] - fill @ mu[v.at]
                    slope = b[miss] - fill @ b[v.at]
                    xz[miss] = fill @ xz[v.at] + np.outer(base, zz[rank]) + slope @ zz[:rank]
                    old = acc.setdefault(int(u), np.zeros(xz.size + zz.size))
                    old += np.concatenate([xz.ravel(), zz.ravel()])
        yield pd.DataFrame({"unit": [*acc, -1], "salt": salt, "s": [a.tolist() for a in (*acc.values(), extra)]})

    got = _added(rows.select("v", "hood", *([label] if label else [])).mapInPandas(part, "unit int, salt int, s array<double>"))
    extra, xz, zz = got.pop(-1, np.zeros(4)), np.zeros((units, dims, rank + 1)), np.zeros((units, rank + 1, rank + 1))
    for u, s in got.items():
        xz[u], zz[u] = s[: dims * (rank + 1)].reshape(dims, rank + 1), s[dims * (rank + 1) :].reshape(rank + 1, rank + 1)
    return xz, zz, extra[3], extra[:3]


def updated(m: Factors, xz: np.ndarray, zz: np.ndarray, noise_weight: float, prior: float = 0.0, least: float = 0.0, keep_proportions: bool = False) -> Factors:
    """The model that the sums ask for. prior adds that many rows' worth of zeros to means and bases; units of a weight below `least` (or without any) go, the others keep their order."""
    rank = m.bases.shape[2]
    n = zz[:, rank, rank]
    keep = np.flatnonzero((n > 0) & (n >= least))
    solved = np.stack([np.linalg.solve(zz[u] + prior * np.eye(rank + 1), xz[u].T).T for u in keep]) if len(keep) else np.zeros((0, m.means.shape[1], rank + 1))
    if keep_proportions:
        pi = m.proportions[[*keep, -1]]
    else:
        pi = np.append(n[keep], noise_weight)
    pi = pi / max(pi.sum(), 1e-300)
    return Factors(solved[:, :, rank], solved[:, :, :rank], pi, m.noise, m.seen, _renamed(m.allowed, keep))


def _renamed(allowed: list[np.ndarray], keep: np.ndarray) -> list[np.ndarray]:
    new = {int(u): i for i, u in enumerate(keep)}
    return [np.array([new[int(u)] for u in a if int(u) in new], int) for a in allowed]


def start(rows: DataFrame, units: int, rank: int, noise: np.ndarray, seen: list[np.ndarray], label: str = "label", steps: int = 5, least: float = 0.5, prior: float = 0.0, few: float = 2.0, seed: int = 0, relabel: bool = False) -> Factors:
    """A model from labels: means and bases fitted with the labels as fixed responsibilities, bases from a small random start. Units of fewer than `few` rows go.

    With relabel the labels only give the first means, and bases are fitted to rows by their responsibilities under these: for labels of which many are wrong, as a basis would otherwise point at the unit they come from.
    """
    dims = len(noise)
    r = np.random.default_rng(seed)
    bases = r.normal(size=(units, dims, rank)) * np.sqrt(np.trace(noise) / dims / max(dims, 1))
    m = Factors(np.zeros((units, dims)), bases, np.full(units + 1, 1 / (units + 1)), noise, seen, [np.arange(units)] * len(seen))
    # means alone first, until entries that few rows see are filled; then bases beside them
    for phase in range(2 if rank else 1):
        now = replace(m, bases=m.bases[:, :, :0]) if phase == 0 else m
        for _ in range(steps):
            xz, zz, weight, _ = sums(rows, now, max(units, 1), None if relabel and phase else label)
            got, n = updated(now, xz, zz, weight, prior), zz[:, -1, -1]
            # labels keep their numbers until the last step
            means, new, pi, on = now.means.copy(), now.bases.copy(), np.zeros(units + 1), n > 0
            means[on], new[on] = got.means, got.bases
            pi[:-1], pi[-1] = n, max(weight, 1e-3 * n.sum())
            now = replace(now, means=means, bases=new, proportions=pi / max(pi.sum(), 1e-300))
        m = replace(now, bases=m.bases) if phase == 0 else now
    keep = np.flatnonzero(n >= max(few, 1e-9)) if units and steps else np.arange(units)
    m = _subset(m, keep)
    # a little noise, so that rows far from all units have somewhere to go
    pi = np.append(m.proportions[:-1], max(m.proportions[-1], 1e-3))
    return replace(m, proportions=pi / pi.sum(), allowed=allowed_units(m.means, seen, least))


def _subset(m: Factors, keep: np.ndarray) -> Factors:
    pi = m.proportions[[*keep, len(m.means)]]
    return Factors(m.means[keep], m.bases[keep], pi / max(pi.sum(), 1e-300), m.noise, m.seen, _renamed(m.allowed, keep))


def fit(rows: DataFrame, m: Factors, top: int = 3, steps: int = 20, tolerance: float = 1e-4, prior: float = 0.0, few: float = 0.0) -> tuple[Factors, list[float]]:
    """EM, and the mean log-evidence before each step. It never falls while no unit is dropped and prior is 0; it ends when it rises by less than tolerance."""
    seen: list[float] = []
    for _ in range(steps):
        xz, zz, weight, (evidence, _, n) = sums(rows, m, top)
        seen.append(evidence / n if n else float("nan"))
        if not n or (len(seen) > 1 and abs(seen[-1] - seen[-2]) < tolerance):
            break
        m = updated(m, xz, zz, weight, prior, few)
    return m, seen


def score(rows: DataFrame, m: Factors, top: int = 3) -> DataFrame:
    """rows with unit (the best one, -1 if the noise is likelier), score (its log-likelihood), cand (the best units, likeliest first, with responsibilities) and the noise's own. Works on streams too."""
    ship(rows.sparkSession)
    sizes = [len(s) for s in m.seen]
    names = [c for c in rows.columns]

    def part(batches):
        views: dict[int, View] = {}
        for pdf in batches:
            n = len(pdf)
            unit, best, cand, noise, share = np.full(n, -1, np.int32), [None] * n, [None] * n, [None] * n, [None] * n
            for h, at, x in _groups(pdf, sizes):
                v = views.setdefault(h, m.view(h))
                ll = v.log_likelihoods(x)
                r, _ = truncated(ll, top)
                order = np.argsort(-ll[:, :-1], axis=1, kind="stable")[:, :top]
                for i, row in enumerate(at):
                    cand[row] = [{"unit": int(v.units[k]), "ll": float(ll[i, k]), "r": float(r[i, k])} for k in order[i]]
                    noise[row], share[row] = float(ll[i, -1]), float(r[i, -1])
                    k = order[i, 0] if order.shape[1] else -1
                    best[row] = float(ll[i, k])
                    if order.shape[1] and ll[i, k] >= ll[i, -1]:
                        unit[row] = v.units[k]
                    else:
                        best[row] = noise[row]
            yield pdf.assign(unit=unit, score=pd.Series(best, pdf.index, dtype=object), cand=cand, noise_ll=pd.Series(noise, pdf.index, dtype=object), noise_r=pd.Series(share, pdf.index, dtype=object))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    clash = {"unit", "score", "cand", "noise_ll", "noise_r"} & set(names)
    if clash:
        raise ValueError(f"columns that score adds are there already: {sorted(clash)}")
    return rows.mapInPandas(part, f"{types}, {SCORES}")


def gains(rows: DataFrame, bank: Factors, base: list[int], proposals: list[tuple[list[int], list[int]]], alpha: float = 1.0) -> tuple[float, np.ndarray]:
    """The criterion of the model of base units, and what each proposal (units removed, units of the bank added) changes it by: mean log-evidence less alpha times mean entropy, from one pass.

    A neighbourhood only looks at the proposals that touch units it allows. Proportions are the bank's, and are not scaled anew within a proposal.
    """
    ship(rows.sparkSession)
    sizes, is_base = [len(s) for s in bank.seen], set(base)

    def part(batches):
        views, out, total, n = {}, np.zeros(len(proposals)), 0.0, 0
        for pdf in batches:
            for h, _, x in _groups(pdf, sizes):
                if h not in views:
                    v = bank.view(h)
                    at = {int(u): k for k, u in enumerate(v.units)}
                    own = [at[u] for u in at if u in is_base] + [len(v.units)]
                    todo = []
                    for p, (less, more) in enumerate(proposals):
                        if any(u in at for u in (*less, *more)):
                            gone = {at[u] for u in less if u in at}
                            todo.append((p, [k for k in own if k not in gone] + [at[u] for u in more if u in at]))
                    views[h] = v, own, todo
                v, own, todo = views[h]
                ll = v.log_likelihoods(x)

                def criterion(cols):
                    r, lse = truncated(ll[:, cols], len(cols))
                    return float((lse - alpha * (lse - (r * np.where(r > 0, ll[:, cols], 0)).sum(1))).sum())

                now = criterion(own)
                total, n = total + now, n + len(x)
                for p, cols in todo:
                    out[p] += criterion(cols) - now
        yield pd.DataFrame({"k": [*range(len(proposals)), -1, -2], "s": [*out, total, n]})

    got = rows.select("v", "hood").mapInPandas(part, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas().set_index("k")["s"]
    n = max(got.get(-2, 0.0), 1.0)
    return got.get(-1, 0.0) / n, np.array([got.get(p, 0.0) for p in range(len(proposals))]) / n


def _bank(m: Factors, more: list[tuple[np.ndarray, np.ndarray, float]], least: float) -> Factors:
    """The model with further units behind its own."""
    if not more:
        return m
    means = np.concatenate([m.means, np.stack([a for a, _, _ in more])])
    bases = np.concatenate([m.bases, np.stack([b for _, b, _ in more])])
    pi = np.concatenate([m.proportions[:-1], [p for _, _, p in more], m.proportions[-1:]])
    extra = allowed_units(means[len(m.means) :], m.seen, least)
    return Factors(means, bases, pi, m.noise, m.seen, [np.concatenate([a, len(m.means) + e]) for a, e in zip(m.allowed, extra)])


def _chosen(bank: Factors, base: int, accepted: list[tuple[list[int], list[int]]], least: float) -> Factors:
    gone = {u for less, _ in accepted for u in less}
    keep = np.array([u for u in range(base) if u not in gone] + [u for _, more in accepted for u in more], int)
    m = _subset(bank, keep)
    return replace(m, allowed=allowed_units(m.means, m.seen, least))


def pooled(m: Factors, group: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, basis and proportion of one unit with the group's moments: the leading axes of their spread, within units and between."""
    pi = m.proportions[group]
    w = pi / max(pi.sum(), 1e-300)
    mean = w @ m.means[group]
    parts = [np.sqrt(a) * m.bases[u] for a, u in zip(w, group)] + [np.sqrt(a) * (m.means[u] - mean)[:, None] for a, u in zip(w, group)]
    left, s, _ = np.linalg.svd(np.concatenate(parts, 1), full_matrices=False)
    rank = m.bases.shape[2]
    basis = np.zeros_like(m.bases[0])
    basis[:, : min(rank, len(s))] = left[:, :rank] * s[:rank]
    return mean, basis, float(pi.sum())


def unit_distances(m: Factors, kind: str = "scaled") -> np.ndarray:
    """Between units: 1 - cosine of means, their whitened distance ('noise'), or that over the root of the product of their norms ('scaled')."""
    y = np.linalg.solve(np.linalg.cholesky(m.noise), m.means.T).T
    norm = np.linalg.norm(y, axis=1)
    if kind == "cosine":
        return 1 - y @ y.T / np.maximum(np.outer(norm, norm), 1e-300)
    d = np.sqrt(np.maximum((norm**2)[:, None] + norm**2 - 2 * y @ y.T, 0))
    return d if kind == "noise" else d / np.maximum(np.sqrt(np.outer(norm, norm)), 1e-300)


def split(train: DataFrame, held: DataFrame, m: Factors, top: int = 3, alpha: float = 1.0, steps: int = 5, least: float = 0.5, few: float = 4.0) -> Factors:
    """Every unit with a basis is proposed as two, apart along its widest axis and fitted to the training rows beside all others; those that raise the held-out criterion stay."""
    units, rank = len(m.means), m.bases.shape[2]
    if not units or not rank:
        return m
    means, bases = [], []
    for u in range(units):
        left, s, _ = np.linalg.svd(m.bases[u], full_matrices=False)
        axis = left[:, 0] * s[0]
        for sign in (-1, 1):
            means.append(m.means[u] + sign * 0.8 * axis)
            bases.append(m.bases[u] * 0.6)
    pi = np.append(np.repeat(m.proportions[:-1] / 2, 2), m.proportions[-1])
    two = Factors(np.stack(means), np.stack(bases), pi, m.noise, m.seen, [np.sort(np.concatenate([2 * a, 2 * a + 1])) for a in m.allowed])
    for _ in range(steps):
        xz, zz, weight, _ = sums(train, two, 2 * top)
        n = zz[:, rank, rank]
        got, on = updated(two, xz, zz, weight), n > 0
        means_, bases_, pi_ = two.means.copy(), two.bases.copy(), np.zeros(2 * units + 1)
        means_[on], bases_[on] = got.means, got.bases
        pi_[:-1], pi_[-1] = n, weight
        two = replace(two, means=means_, bases=bases_, proportions=pi_ / max(pi_.sum(), 1e-300))
    bank = _bank(m, [(two.means[k], two.bases[k], two.proportions[k] / max(two.proportions[k - k % 2 : k - k % 2 + 2].sum(), 1e-300) * m.proportions[k // 2]) for k in range(2 * units)], least)
    big = [u for u in range(units) if min(n[2 * u], n[2 * u + 1]) >= few]
    proposals = [([u], [units + 2 * u, units + 2 * u + 1]) for u in big]
    return _accepted(held, m, bank, proposals, alpha, least)


def _accepted(held: DataFrame, m: Factors, bank: Factors, proposals: list[tuple[list[int], list[int]]], alpha: float, least: float) -> Factors:
    """The proposals that help by themselves, best first and no unit in two; all of them if that's better than the best alone."""
    units = len(m.means)
    if not proposals:
        return m
    _, gain = gains(held, bank, list(range(units)), proposals, alpha)
    used, kept = set(), []
    for p in np.argsort(-gain, kind="stable"):
        if gain[p] > 0 and not used & set(proposals[p][0]):
            used |= set(proposals[p][0])
            kept.append(proposals[p])
    if len(kept) > 1:
        together = ([u for less, _ in kept for u in less], [u for _, more in kept for u in more])
        _, (all_, one) = gains(held, bank, list(range(units)), [together, kept[0]], alpha)
        if one > all_:
            kept = kept[:1]
    return _chosen(bank, units, kept, least) if kept else m


def merge(held: DataFrame, m: Factors, most: float, alpha: float = 1.0, size: int = 4, kind: str = "scaled", least: float = 0.5) -> Factors:
    """Groups of up to `size` units no further apart than `most` (complete linkage); of all partitions of a group whose parts hold such units, the one with the highest held-out criterion is taken if it gains."""
    units = len(m.means)
    d = unit_distances(m, kind)
    groups = [g for g in merging.leaf_groups(merging.tree(d), units, size, most) if len(g) > 1] if units > 1 else []
    more, proposals, at = [], [], {}
    for g in groups:
        for parts in merging.partitions(list(g)):
            big = [sorted(p) for p in parts if len(p) > 1]
            if not big or any(d[i, j] > most for p in big for i in p for j in p):
                continue
            added = []
            for p in big:
                if tuple(p) not in at:
                    at[tuple(p)] = units + len(more)
                    more.append(pooled(m, p))
                added.append(at[tuple(p)])
            proposals.append(([u for p in big for u in p], added))
    return _accepted(held, m, _bank(m, more, least), proposals, alpha, least)


def remove(held: DataFrame, m: Factors, alpha: float = 1.0, least: float = 0.5) -> Factors:
    """Units without which the held-out criterion is higher go; one stays at least."""
    if len(m.means) < 2:
        return m
    out = _accepted(held, m, m, [([u], []) for u in range(len(m.means))], alpha, least)
    return out if len(out.means) else m


def demix(train: DataFrame, held: DataFrame, m: Factors, most: float, rounds: int = 3, top: int = 3, alpha: float = 1.0, steps: int = 20, folder: str | None = None) -> Factors:
    """Rounds of EM, splits, merges and removals until a round keeps the number of units; then EM once more. With a folder each step's model is saved there."""

    def keep(name: str, model: Factors) -> Factors:
        if folder:
            save(train.sparkSession, f"{folder}/{name}.npz", model)
        return model

    for k in range(rounds):
        m = keep(f"{k}-fit", fit(train, m, top, steps)[0])
        before = len(m.means)
        m = keep(f"{k}-split", split(train, held, m, top, alpha))
        m = keep(f"{k}-merge", merge(held, m, most, alpha))
        m = keep(f"{k}-remove", remove(held, m, alpha))
        if len(m.means) == before:
            break
    return keep("last", fit(train, m, top, steps)[0])


def save(spark: SparkSession, path: str, m: Factors) -> None:
    save_arrays(spark, path, means=m.means, bases=m.bases, proportions=m.proportions, noise=m.noise, hoods=np.array([len(m.seen)]), **{f"seen{i}": s for i, s in enumerate(m.seen)}, **{f"allowed{i}": a for i, a in enumerate(m.allowed)})


def load(spark: SparkSession, path: str) -> Factors:
    a = load_arrays(spark, path)
    n = int(a["hoods"][0])
    return Factors(a["means"], a["bases"], a["proportions"], a["noise"], [a[f"seen{i}"] for i in range(n)], [a[f"allowed{i}"] for i in range(n)])
