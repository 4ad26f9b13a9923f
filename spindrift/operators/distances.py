"""Distances between unit-level vectors. Pair tables are made of unit tables (one row a unit), never of spikes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, norm, square
from ..session import ship


def pairs(units: DataFrame, label: str = "label", v: str = "v", ordered: bool = True) -> DataFrame:
    """(i, j, vi, vj) for i < j, or for all i and j. A theta join of the unit table with itself."""
    a = units.select(F.col(label).alias("i"), F.col(v).alias("vi"))
    b = units.select(F.col(label).alias("j"), F.col(v).alias("vj"))
    return a.join(b, F.col("i") < F.col("j") if ordered else F.col("i") != F.col("j"))


def cosine(true_distance: bool = True) -> Column:
    """sqrt(2 (1 - cos)), or 1 - cos; null for a blank vector."""
    c = F.try_divide(dot(F.col("vi"), F.col("vj")), norm(F.col("vi")) * norm(F.col("vj")))
    gap = F.greatest(F.lit(1.0) - c, F.lit(0.0))
    return F.sqrt(gap * 2) if true_distance else gap


def normeuc() -> Column:
    """|a - b| / sqrt(|a| |b|)."""
    gap = F.sqrt(square(F.zip_with("vi", "vj", lambda x, y: x.cast("double") - y.cast("double"))))
    return F.try_divide(gap, F.sqrt(norm(F.col("vi")) * norm(F.col("vj"))))


def scaled_normeuc(scale_var: float = 0.01**2, boundary: float = 1 / 3) -> Column:
    """Normalised distance after the best scaling of one vector to the other, penalised and clamped to [1/(1+b), 1+b]; the lesser of both directions."""
    ab, aa, bb = dot(F.col("vi"), F.col("vj")), square(F.col("vi")), square(F.col("vj"))

    def one(num: Column, den: Column, to: Column) -> Column:
        s = F.greatest(F.least((num + 1 / scale_var) / (den + 1 / scale_var), F.lit(1 + boundary)), F.lit(1 / (1 + boundary)))
        gap = F.greatest(to - s * num * 2 + s * s * den, F.lit(0.0))
        return F.try_divide(F.sqrt(gap), F.sqrt(F.sqrt(to) * s * F.sqrt(den)))

    return F.least(one(ab, aa, bb), one(ab, bb, aa))


def hellinger(sigma: float) -> Column:
    """Between isotropic normal distributions of one sigma: sqrt(1 - exp(-d^2 / (8 sigma^2)))."""
    d2 = square(F.zip_with("vi", "vj", lambda x, y: x.cast("double") - y.cast("double")))
    return F.sqrt(F.lit(1.0) - F.exp(-d2 / (8 * sigma * sigma)))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, key: str, v: str = "v", label: str = "label") -> DataFrame:
    """The centroid of the least distance for each row; centroids are a unit table and are broadcast, equal distances go to the smaller label."""
    c = centroids.select(F.col(label).alias("centroid"), F.col(v).alias("_c"))
    both = rows.join(F.broadcast(c.agg(F.collect_list(F.struct("centroid", "_c")).alias("_all"))))
    scored = F.transform("_all", lambda s: F.struct(square(F.zip_with(F.col(v), s["_c"], lambda x, y: x.cast("double") - y.cast("double"))).alias("d2"), s["centroid"].alias("centroid")))
    best = both.withColumn("_best", F.array_min(scored))
    return best.select(key, F.col("_best.centroid").alias("centroid"), F.sqrt("_best.d2").alias("d"))


def top_cosine(rows: DataFrame, queries: DataFrame, key: str, k: int, v: str = "v", block_bytes: int = 16 << 20) -> DataFrame:
    """(query, key, sim, rank): the k rows most like each query, itself left out; equal ones, after rounding to 6 digits, by key, blank vectors last.

    Rows and queries are dealt by hash over blocks of about block_bytes, whose number follows from their count and length. A group holds a block of each as matrices, so all similarities are products of matrices, and keeps k for each query."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    sides, blocks = [], []
    for df in (rows, queries):
        n, width = df.agg(F.count(F.lit(1)), F.max(F.size(v))).first()
        blocks.append(max(1, -(-n * (8 * max(width or 0, 0) + 64) // block_bytes)))
    for s, df in enumerate((rows, queries)):
        mine = F.pmod(F.xxhash64(key), F.lit(blocks[s])).cast("int")
        dealt = df.select(F.col(key).alias("k"), F.col(v).cast("array<double>").alias("v"), mine.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - s] - 1))).alias("_far"))
        sides.append(dealt.select("k", "v", F.col("_far" if s else "_own").alias("_r"), F.col("_own" if s else "_far").alias("_q")))

    def unit(col: pd.Series, width: int) -> np.ndarray:
        # vectors that are null, of another length or blank have no likeness to any
        x = np.full((len(col), width), np.nan)
        for i, a in enumerate(col):
            if a is not None and len(a) == width:
                x[i] = a
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, size, out=np.full_like(x, np.nan), where=size > 0)

    def best(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(q):
            width = max((len(x) for x in (*a["v"], *q["v"]) if x is not None), default=0)
            a = a.sort_values("k")
            names, x, asked, y = a["k"].to_numpy(), unit(a["v"], width), q["k"].to_numpy(), unit(q["v"], width)
            for at in range(0, len(asked), 256):
                sims = np.round(y[at : at + 256] @ x.T, 6)
                order = np.where(np.isnan(sims), -np.inf, sims)
                order[asked[at : at + 256, None] == names[None, :]] = np.nan
                for row, sim, name in zip(order, sims, asked[at : at + 256]):
                    some = np.flatnonzero(~np.isnan(row))
                    if len(some) > k:
                        some = some[row[some] >= np.partition(row[some], len(some) - k)[len(some) - k]]
                    # names are sorted, so a stable sort leaves equal ones in order
                    out += [(name, names[i], sim[i]) for i in some[np.argsort(-row[some], kind="stable")[:k]]]
        return pd.DataFrame(out, columns=["query", key, "sim"])

    keys = ["_r", "_q"]
    tasks = max(1, min(blocks[0] * blocks[1], 4096))
    left, right = (x.repartition(tasks, *keys).groupBy(*keys) for x in sides)
    found = left.cogroup(right).applyInPandas(best, f"query {kind}, {key} {kind}, sim double")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def combined(tables: list[tuple[DataFrame, float]]) -> DataFrame:
    """(i, j, d): the greatest of pair distances (i, j, d) over their thresholds, so 1 is the limit of all; pairs missing from a table are infinitely far in it, hence left out."""
    out = None
    for n, (t, threshold) in enumerate(tables):
        one = t.select("i", "j", (F.col("d") / threshold).alias(f"_d{n}"))
        out = one if out is None else out.join(one, ["i", "j"])
    parts = [F.col(f"_d{n}") for n in range(len(tables))]
    return out.select("i", "j", (F.greatest(*parts) if len(parts) > 1 else parts[0]).alias("d"))


def lagged(units: DataFrame, most: int, label: str = "label", v: str = "v") -> DataFrame:
    """(i, j, lag, dot): for i < j the shift of j's vector by at most `most` samples of the greatest dot product with i's, of equals the shift nearest 0, then the lower one; zeros enter at the edges."""
    p = pairs(units, label, v).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    n = F.size("vi")
    # vi[s] * vj[s - lag] over the samples both have
    over = F.greatest(n - F.abs("lag"), F.lit(0))
    a = F.slice("vi", F.greatest(F.col("lag"), F.lit(0)) + 1, over)
    b = F.slice("vj", F.greatest(-F.col("lag"), F.lit(0)) + 1, over)
    best = p.select("i", "j", "lag", dot(a, b).alias("dot")).groupBy("i", "j").agg(F.max(F.struct("dot", (-F.abs("lag")).alias("near"), (-F.col("lag")).alias("low"))).alias("m"))
    return best.select("i", "j", (-F.col("m.low")).alias("lag"), F.col("m.dot").alias("dot"))


def max_z(std_floor: float = 1e-9) -> Column:
    """The greatest standardised difference |a - b| / (2 min(sa, sb)) of pairs that also carry standard errors si and sj."""
    err = F.zip_with("si", "sj", lambda x, y: F.greatest(F.least(x, y).cast("double"), F.lit(std_floor)))
    gap = F.zip_with("vi", "vj", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.array_max(F.zip_with(gap, err, lambda g, e: g / (e * 2)))


def relabel(spikes: DataFrame, names: DataFrame, t: str = "t", label: str = "label", to: str = "merged") -> DataFrame:
    """Labels under the names (label, new[, shift]) of their units, times moved by the shift if there is one; units without a name stay."""
    shift = F.coalesce("shift", F.lit(0)) if "shift" in names.columns else F.lit(0)
    out = spikes.join(names.withColumnRenamed("new", "_new"), label, "left").withColumn(t, F.col(t) + shift).withColumn(to, F.coalesce("_new", F.col(label)))
    return out.drop("_new", "shift")


def temporal_products(basis: np.ndarray) -> np.ndarray:
    """(rank, rank, 2 length - 1): products of the components of a temporal basis (rank, length), r's samples at t + lag with s's at t, for lags from 1 - length up."""
    n = basis.shape[1]
    return np.stack([np.stack([np.correlate(r, s, "full") for s in basis]) for r in basis]).reshape(len(basis), len(basis), 2 * n - 1)


def weighted_lagged(spark: SparkSession, spatial: np.ndarray, products: np.ndarray, weights: np.ndarray, units: list[int], scale_var: float = 0.01**2, boundary: float = 1 / 3, block: int = 128) -> DataFrame:
    """(i, j, d, lag, iou) of pairs of units in order, whose templates are spatial (units, rank, channels) in a shared temporal basis; products are temporal_products of it, weights (units, channels).

    A pair's channels count by the lesser of both weights over these weights' sum. The lag is that of the greatest product, i's samples at t + lag meeting j's at t, of equals the lowest. The distance is the normalised one after the best scaling of
    one template to the other within [1 / (1 + boundary), 1 + boundary], whose deviation from 1 costs 1 / scale_var; of both directions the lesser. iou: sum of the lesser over sum of the greater weights.
    Units without any weight have no pairs. Blocks of units meet in tasks, so work and rows are dealt evenly; only the templates' factors go to the tasks.
    """
    ship(spark)
    some = np.flatnonzero(weights.sum(1) > 0)
    blocks = -(-len(some) // block)
    inv, top = 1 / scale_var, 1 + boundary
    lag0 = products.shape[2] // 2

    def near(ii: np.ndarray, jj: np.ndarray) -> pd.DataFrame:
        low = np.minimum(weights[ii], weights[jj])
        total = low.sum(1)
        share = np.divide(low, total[:, None], out=np.zeros_like(low), where=total[:, None] > 0)
        a, b = spatial[ii] * share[:, None], spatial[jj] * share[:, None]
        by_lag = np.einsum("nrc,nsc->nrs", a, b).reshape(len(ii), -1) @ products.reshape(-1, products.shape[2])
        lag, dots = by_lag.argmax(1) - lag0, by_lag.max(1)
        sa, sb = (a * a).sum((1, 2)), (b * b).sum((1, 2))

        def one(template: np.ndarray, target: np.ndarray) -> np.ndarray:
            s = np.clip((dots + inv) / (template + inv), 1 / top, top)
            gap = np.maximum(s * s * template + target - 2 * s * dots, 0)
            size = np.sqrt(target * s * s * template)
            return np.sqrt(np.divide(gap, size, out=np.full(len(gap), np.inf), where=size > 0))

        return pd.DataFrame({"i": np.array(units)[ii], "j": np.array(units)[jj], "d": np.minimum(one(sa, sb), one(sb, sa)), "lag": lag, "iou": total / np.maximum(weights[ii], weights[jj]).sum(1)})

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                p, q = divmod(int(k), blocks)
                if p <= q:
                    a, b = some[p * block : (p + 1) * block], some[q * block : (q + 1) * block]
                    ii, jj = (g.ravel() for g in np.meshgrid(a, b, indexing="ij"))
                    for at in range(0, len(ii), 2048):
                        x, y = ii[at : at + 2048], jj[at : at + 2048]
                        yield near(x[x < y], y[x < y])

    return spark.range(blocks * blocks).mapInPandas(run, "i int, j int, d double, lag int, iou double")
