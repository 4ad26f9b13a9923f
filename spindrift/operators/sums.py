"""Sums of arrays over a table, added up in the executors: the driver gets one number an entry, however many tasks there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(rows: DataFrame, part: Callable[[Iterator[pd.DataFrame]], np.ndarray | None]) -> np.ndarray:
    """The sum of what `part` makes of each task's rows, flat arrays of one length or None; empty if all are None. Entries of 0 aren't sent."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (flat := part(batches)) is not None:
            at = np.unique(np.append(np.flatnonzero(flat), len(flat) - 1))
            yield pd.DataFrame({"i": at, "x": flat[at].astype(float)})

    got = rows.mapInPandas(over, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(int(got["i"].max()) + 1 if len(got) else 0)
    out[got["i"]] = got["x"]
    return out
