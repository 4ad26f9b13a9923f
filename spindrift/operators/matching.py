"""Template matching: greedy pursuit of templates in each chunk's residual, with a dead time for each unit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship
from .detect import with_halo

SCHEMA = "chunk long, t long, unit int, objective double, scaling double"


def pursuit(templates: np.ndarray, units: list[int], threshold: float, trough: int, refractory: int = 10, scale_sd: float = 0.0, boundary: float = 0.5) -> Callable[[np.ndarray], list[tuple[int, int, float, float]]]:
    """A function of a trace (times, channels) that gives (time, unit, objective, scaling) of each template found.

    templates is (units, length, channels). A template's objective at a time is the drop of the residual's square when it is subtracted, twice the product
    less the square; with scale_sd its scaling is free under a normal prior about 1 within [1 / (1 + boundary), 1 + boundary]. Each step takes all times that
    exceed threshold squared and every other within a template's length, subtracts them together, and masks their units within the dead time. It ends when none is left.
    """
    k, length, _ = templates.shape
    square = (templates**2).sum((1, 2))
    inv = 1 / scale_sd**2 if scale_sd else 0.0

    def products(x: np.ndarray) -> np.ndarray:
        n = len(x) - length + 1
        out = np.zeros((k, n))
        for i in range(length):
            out += templates[:, i] @ x[i : i + n].T
        return out

    def score(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not scale_sd:
            return 2 * conv - square[:, None], np.ones_like(conv)
        s = np.clip((conv + inv) / (square[:, None] + inv), 1 / (1 + boundary), 1 + boundary)
        return 2 * s * conv - s**2 * square[:, None] - inv * (s - 1) ** 2, s

    def run(x: np.ndarray) -> list[tuple[int, int, float, float]]:
        x = x.astype(float).copy()
        if len(x) < length or not k:
            return []
        conv = products(x)
        n = conv.shape[1]
        barred, found = np.zeros((k, n), bool), []
        # each step bars a time at least, so this ends
        while True:
            obj, scales = score(conv)
            obj[barred] = -np.inf
            best = obj.argmax(0)
            top = obj[best, np.arange(n)]
            taken, last = [], -length
            # left to right, a time is taken if it is the highest of the template's length about it
            for at in np.flatnonzero(top > threshold**2):
                if at - last >= length and top[at] >= top[max(0, at - length + 1) : at + length].max():
                    taken.append(int(at))
                    last = at
            if not taken:
                break
            for at in taken:
                u = int(best[at])
                found.append((at + trough, units[u], float(top[at]), float(scales[u, at])))
                x[at : at + length] -= scales[u, at] * templates[u]
                barred[u, max(0, at - refractory) : at + refractory + 1] = True
                a, b = max(0, at - length + 1), min(n, at + length)
                conv[:, a:b] = products(x[a : b + length - 1])
        return sorted(found)

    return run


def match(samples: DataFrame, templates: np.ndarray, units: list[int], threshold: float, trough: int, chunk: int = 30_000, refractory: int = 10, scale_sd: float = 0.0, channels: list[int] | None = None) -> DataFrame:
    """Spikes (chunk, t, unit, objective, scaling) of samples (t, channel, v): each chunk with margins of two templates is searched by itself, and spikes in margins are left to the chunks they belong to.

    Templates are a unit table and go along with the function; a group is one chunk. Samples that are missing count as 0.
    """
    ship(samples.sparkSession)
    find = pursuit(templates, units, threshold, trough, refractory, scale_sd)
    names = list(range(templates.shape[2])) if channels is None else channels
    margin = 2 * templates.shape[1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["chunk"].iloc[0])
        start = number * chunk - margin
        at = pd.Series(range(len(names)), index=names)
        x = np.zeros((chunk + 2 * margin, len(names)))
        col = pdf["channel"].map(at)
        ok = col.notna().to_numpy()
        x[(pdf["t"].to_numpy() - start)[ok], col[ok].astype(int)] = pdf["v"].to_numpy(float)[ok]
        got = [(number, start + t, u, o, s) for t, u, o, s in find(x) if 0 <= t - margin < chunk]
        return pd.DataFrame(got, columns=["chunk", "t", "unit", "objective", "scaling"])

    return with_halo(samples.select("t", "channel", "v"), chunk, margin).groupBy("chunk").applyInPandas(run, SCHEMA)
