"""HDBSCAN of groups that a task can hold, as arrays: the same definitions, weights and order of edges as in hdbscan.py, without any job.

Points are in order of their node, so an edge's ends are compared by their places. Pairs are made in chunks of at most CHUNK candidates from grid cells whose width doubles, and from the second width on only from points outside the largest component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd

from .hdbscan import TINY, Tree

CHUNK = 1 << 19


def _codes(x: np.ndarray, width: float) -> tuple[np.ndarray, list[int]]:
    """Each point's cell as one number, and the numbers' distances of the cells about it but for the last axis, along which cells are in a row. Empty stretches are cut short, so numbers fit; more than three axes aren't needed to find candidates."""
    axes = []
    for c in np.floor(x[:, :3] / width).T:
        u, at = np.unique(c, return_inverse=True)
        axes.append(np.concatenate([[1], 1 + np.cumsum(np.minimum(np.diff(u), 2)).astype(np.int64)])[at])
    code, steps = axes[0], [1]
    for a in axes[1:]:
        wide = int(a.max()) + 2
        code, steps = code * wide + a, [s * wide for s in steps] + [1]
    return code, [sum(s * o for s, o in zip(steps, off)) for off in product((-1, 0, 1), repeat=len(steps) - 1)]


def _candidates(x: np.ndarray, width: float, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (i, place, j, d) with all points j beside each i of left, itself included, at least those within width; place numbers those of one i. Chunks hold points of like numbers of them."""
    code, offsets = _codes(x, width * (1 + 1e-9))  # a quotient may be rounded up
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    low = np.stack([np.searchsorted(sorted_, code[left] + o - 1, "left") for o in offsets], 1)
    many = np.stack([np.searchsorted(sorted_, code[left] + o + 1, "right") for o in offsets], 1) - low
    total = many.sum(1)
    by = np.argsort(total, kind="stable")
    ends = np.cumsum(total[by])
    at = 0
    while at < len(by):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        some = by[at:to]
        runs, first = many[some].ravel(), low[some].ravel()
        start = np.cumsum(runs) - runs
        j = order[np.arange(runs.sum()) + np.repeat(first - start, runs)]
        i = np.repeat(left[some], total[some])
        own = np.cumsum(total[some]) - total[some]
        d = np.zeros(len(i))
        for c in x.T:
            d += (c[i] - c[j]) ** 2
        yield i, np.arange(len(i)) - np.repeat(own, total[some]), j, np.sqrt(d)
        at = to


def _widths(x: np.ndarray, k: int) -> tuple[float, float]:
    """A width at which a point meets about k others in the mean, and the widest that can matter."""
    widest = 1.001 * float(np.sqrt((np.ptp(x, axis=0) ** 2).sum())) or 1.0
    width = widest * (max(k, 1) / len(x)) ** (1 / x.shape[1])
    for _ in range(40):
        many = np.unique(_codes(x, width)[0], return_counts=True)[1].astype(float)
        if (many * many).sum() <= max(k, 1) * len(x) or width < widest * 1e-9:
            break
        width /= 2
    return width, widest


def core_distances(x: np.ndarray, n: np.ndarray, k: int, width: float, widest: float) -> np.ndarray:
    """The distance of the k-th nearest other point, n being copies, or of the farthest where there are fewer."""
    core, left = np.where(n > k, 0.0, np.nan), np.flatnonzero(n <= k)
    single = int(n.max()) == 1
    while len(left):
        last = width >= widest
        for i, place, j, d in _candidates(x, width, left):
            near = (d <= width) & (i != j)
            rows = np.cumsum(place == 0) - 1
            points = i[place == 0]
            row, far = rows[near], np.full((len(points), max(int(place.max()) + 1, k)), np.inf)
            far[row, place[near]] = d[near]
            if single:
                kth = np.partition(far, k - 1, axis=1)[:, k - 1]
            else:
                copies = np.zeros(far.shape)
                copies[row, place[near]] = n[j[near]]
                by = np.argsort(far, axis=1, kind="stable")
                enough = np.cumsum(np.take_along_axis(copies, by, 1), 1) + n[points][:, None] - 1 >= k
                kth = np.where(enough.any(1), np.take_along_axis(far, np.take_along_axis(by, enough.argmax(1)[:, None], 1), 1)[:, 0], np.inf)
            if last:
                most = np.where(np.isfinite(far), far, 0.0).max(1)
                kth = np.where(np.isfinite(kth), kth, most)
            core[points] = np.where(np.isfinite(kth), kth, np.nan)
        left = left[np.isnan(core[left])]
        width = min(2 * width, widest)
    return core


def _joined(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after links between them: each point's least."""
    while True:
        ca, cb = comp[a], comp[b]
        apart = ca != cb
        if not apart.any():
            return comp
        a, b, ca, cb = a[apart], b[apart], ca[apart], cb[apart]
        up = np.arange(len(comp))
        np.minimum.at(up, np.maximum(ca, cb), np.minimum(ca, cb))
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further
        comp = up[comp]


def spanning_forest(x: np.ndarray, core: np.ndarray, width: float, widest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges (a, b, w) of the minimum spanning tree under mutual reachability, in order of w, a, b."""
    m = len(x)
    comp, out = np.arange(m), []
    while True:
        last = width >= widest
        names, sizes = np.unique(comp, return_counts=True)
        if len(names) < 2:
            break
        first = len(names) == m
        left = np.arange(m) if first else np.flatnonzero(comp != names[sizes.argmax()])
        parts = []
        for i, _, j, d in _candidates(x, width, left):
            keep = (comp[i] != comp[j]) & (d <= width)
            if first:
                keep &= i < j
            i, j = i[keep], j[keep]
            w = np.maximum(np.maximum(d[keep], core[i]), core[j])
            a, b = np.minimum(i, j), np.maximum(i, j)
            if not last:
                within = w <= width
                a, b, w = a[within], b[within], w[within]
            if not first:
                # of each two components the least edge only
                pair = np.minimum(comp[a], comp[b]) * m + np.maximum(comp[a], comp[b])
                by = np.lexsort((a * m + b, w, pair))
                by = by[np.r_[True, np.diff(pair[by]) != 0]] if len(by) else by
                a, b, w = a[by], b[by], w[by]
            parts.append((a, b, w))
        a, b, w = (np.concatenate(z) for z in zip(*parts))
        by = np.lexsort((a * m + b, w))
        a, b, w = a[by], b[by], w[by]
        while True:
            ca, cb = comp[a], comp[b]
            apart = ca != cb
            a, b, w, ca, cb = a[apart], b[apart], w[apart], ca[apart], cb[apart]
            if not len(a):
                break
            # in reverse the first edge of a component is written last
            first_a, first_b, k = np.full(m, len(a)), np.full(m, len(a)), np.arange(len(a))[::-1]
            first_a[ca[::-1]], first_b[cb[::-1]] = k, k
            least = np.minimum(first_a, first_b)
            some = np.unique(least[least < len(a)])
            out.append((a[some], b[some], w[some]))
            comp = _joined(comp, a[some], b[some])
        if last:
            break
        width = min(2 * width, widest)
    a, b, w = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    by = np.lexsort((b, a, w))
    return a[by], b[by], w[by]


def labels(x: np.ndarray, n: np.ndarray, size: int, samples: int, epsilon: float) -> np.ndarray:
    """Each point's cluster, a number of the tree's, or -1."""
    m = len(x)
    none = np.full(m, -1)
    if n.sum() < 2 * size:
        return none
    width, widest = _widths(x, samples)
    core = core_distances(x, n, samples, width, widest)
    a, b, w = spanning_forest(x, core, width, widest)
    top, many = list(range(m)), n.tolist()
    waiting: list[list[int] | None] = [None if c >= size else [i] for i, c in enumerate(many)]
    enter, split = np.where(n >= size, core, np.nan), np.zeros(len(w), bool)

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k, (p, q, v) in enumerate(zip(a.tolist(), b.tolist(), w.tolist())):
        p, q = root(p), root(q)
        if many[p] < many[q]:
            p, q = q, p
        wp, wq = waiting[p], waiting[q]
        top[q] = p
        many[p] += many[q]
        if wp is None and wq is None:
            split[k] = True
            continue
        if wp is None:
            enter[wq] = v
        else:
            wp += wq
            if many[p] >= size:
                enter[wp] = v
                waiting[p] = None
    if not split.any():
        return none
    leaf = _joined(np.arange(m), a[~split], b[~split])
    tree = Tree(np.unique(np.concatenate([leaf[a[split]], leaf[b[split]]])), pd.DataFrame({"la": leaf[a[split]], "lb": leaf[b[split]], "w": w[split]}))
    enter = np.maximum(enter, TINY)
    owner = tree.owner(np.searchsorted(tree.leaves, leaf), enter)
    count, lam = (np.bincount(owner, z, len(tree.parent)) for z in (n, n / enter))
    return tree.select(count, lam, epsilon)[owner]


def recursive(x: np.ndarray, n: np.ndarray, size: int, samples: int, epsilon: float, part: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each point's cluster, named by the first place in it, or -1: clusters are clustered again by themselves until none falls into two. And whether that is yet to be done, as it is for parts of up to `part` points."""
    out, live, todo = np.full(len(x), -1), np.zeros(len(x), bool), [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= part:
            out[at], live[at] = at[0], True
            continue
        found = labels(x[at], n[at], size, samples, epsilon)
        parts = np.unique(found[found >= 0])
        if len(parts) < 2:
            out[at] = at[0]
        else:
            todo += [at[found == c] for c in parts]
    return out, live
