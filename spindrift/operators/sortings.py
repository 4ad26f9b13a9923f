"""A sorting as a table of spikes: subsets, features as columns, units, unions and what is told of a unit."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .labels import flatten

#: Rows of a step of time that one group of cross_correlogram takes from a side.
PART = 1 << 19


def mask(spikes: DataFrame, keep: Column | str) -> DataFrame:
    """The spikes that meet a condition, under their own ids; tables of units or channels stay as they are."""
    return spikes.where(keep)


def only(spikes: DataFrame, ids: DataFrame, key: str = "spike_id") -> DataFrame:
    """The spikes whose ids are listed."""
    return spikes.join(ids.select(key).distinct(), key, "left_semi")


def drop_missing(spikes: DataFrame, label: str = "label") -> DataFrame:
    """Spikes of a unit: labels of 0 and more."""
    return spikes.where(F.col(label) >= 0)


def with_features(spikes: DataFrame, overwrite: bool = False, **features: Column) -> DataFrame:
    """Features as further columns; one that exists is replaced only if that is asked for."""
    if not overwrite and (known := set(features) & set(spikes.columns)):
        raise ValueError(f"there already: {sorted(known)}")
    return spikes.withColumns(features)


def joined_features(spikes: DataFrame, features: DataFrame, key: str = "spike_id") -> DataFrame:
    """Features of a table of their own, which must have one row for each spike (left join; a spike without one has nulls)."""
    return spikes.join(features, key, "left")


def without_features(spikes: DataFrame, *names: str) -> DataFrame:
    """Features that aren't there are an error, as a misspelt name would otherwise pass."""
    if lost := set(names) - set(spikes.columns):
        raise ValueError(f"not there: {sorted(lost)}")
    return spikes.drop(*names)


def features_matching(spikes: DataFrame, part: str, key: str = "spike_id") -> DataFrame:
    """The id and the columns whose names hold `part`."""
    return spikes.select(key, *(c for c in spikes.columns if part in c and c != key))


def unit_ids(spikes: DataFrame, label: str = "label") -> DataFrame:
    return drop_missing(spikes, label).select(label).distinct()


def n_units(spikes: DataFrame, label: str = "label") -> DataFrame:
    return drop_missing(spikes, label).agg(F.count_distinct(label).alias("n_units"), F.count(F.lit(1)).alias("n_spikes"))


def structured_locations(spikes: DataFrame, x: str = "x", y: str = "y", z: str = "z", alpha: str = "alpha", to: str = "location") -> DataFrame:
    return spikes.withColumn(to, F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"), F.col(alpha).alias("alpha")))


def inverted(spikes: DataFrame, part: int = 4096, label: str = "label", key: str = "spike_id") -> DataFrame:
    """(label, part, ids): an inverted index from units to ids, in lists of the ids of `part` consecutive numbers, so that no list grows with its unit."""
    by = drop_missing(spikes, label).groupBy(label, F.floor(F.col(key) / part).alias("part"))
    return by.agg(F.sort_array(F.collect_list(key)).alias("ids"))


def keep_units(spikes: DataFrame, units: DataFrame, label: str = "label", to: str = "flat") -> DataFrame:
    """Spikes of units that aren't listed get -1, and the labels left are numbered without gaps."""
    marked = units.select(F.col(label)).distinct().withColumn("_in", F.lit(True))
    kept = spikes.join(marked, label, "left").withColumn("_label", F.when(F.col("_in"), F.col(label)).otherwise(F.lit(-1)))
    return flatten(kept.drop("_in"), "_label", to).drop("_label")


def perturb(spikes: DataFrame, neighbours: DataFrame, thinning: float = 0.0, jitter: int = 0, seed: int = 0, key: str = "spike_id") -> DataFrame:
    """Each spike is lost with a probability, all are moved in time by one number drawn from -jitter to jitter, and each goes to a channel drawn among its channel's neighbours (channel, slot, neighbor). Draws follow from the id and the seed."""
    unit = lambda what: F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(what)), F.lit(1 << 30)) / float(1 << 30)
    sizes = neighbours.groupBy("channel").agg(F.count(F.lit(1)).alias("_n"))
    kept = spikes.where(unit("thin") >= thinning).withColumn("t", F.col("t") + random.Random(seed).randint(-jitter, jitter)).join(F.broadcast(sizes), "channel")
    drawn = kept.withColumn("slot", F.floor(unit("move") * F.col("_n")).cast("int")).drop("_n")
    return drawn.join(F.broadcast(neighbours.withColumn("slot", F.col("slot").cast("int"))), ["channel", "slot"]).drop("slot", "channel").withColumnRenamed("neighbor", "channel")


def between(peaks: DataFrame, first: int, last: int, offset: int = 0, t: str = "t") -> DataFrame:
    """Peaks of [first, last], with `offset` added to their times."""
    return peaks.where(F.col(t).between(first, last)).withColumn(t, F.col(t) + offset)


def time_parts(spikes: DataFrame, parts: DataFrame, t: str = "t") -> DataFrame:
    """part: the time range (part, start, stop) that a spike lies in; ranges may overlap, a spike is then in several. The ranges are a small table, and the join is by its size."""
    return spikes.join(parts, (F.col(t) >= F.col("start")) & (F.col(t) < F.col("stop"))).drop("start", "stop")


def stacked(*tables: DataFrame) -> DataFrame:
    """Tables of spikes, scores or peaks one after another, whatever columns each has."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def versus(tables: dict[str, DataFrame], name: str = "sorter") -> DataFrame:
    """Unit tables of several sorters, with the sorter's name."""
    return stacked(*(df.withColumn(name, F.lit(k)) for k, df in tables.items()))


def rescaled(rows: DataFrame, column: str, to: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Between 0 and 1 over its group's range; the range is aggregated and joined back, so no group is in one task."""
    ends = rows.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    both = rows.join(ends, by) if by else rows.join(F.broadcast(ends))
    return both.withColumn(to, F.try_divide((F.col(column) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double"))).drop("_lo", "_hi")


def scattered(dest: DataFrame, source: DataFrame, index: list[str], value: str = "v", reduce: str = "sum", include_self: bool = True, sign: int = 1) -> DataFrame:
    """dest (index, value) with the source rows of the same index reduced into it: sum, min, max or mean; an index the source lacks keeps its value."""
    rows = source.select(*index, (F.col(value) * sign).alias(value))
    if include_self:
        rows = rows.unionByName(dest.join(rows.select(*index).distinct(), index, "left_semi").select(*index, value))
    got = rows.groupBy(*index).agg(getattr(F, {"mean": "avg"}.get(reduce, reduce))(value).alias("_new"))
    return dest.join(got, index, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def summary(rates: DataFrame, *tables: DataFrame, label: str = "label") -> DataFrame:
    """One row a unit: its rate and what the other unit tables tell of it (nulls where one doesn't)."""
    return reduce(lambda a, b: a.join(b, label, "left"), tables, rates)


def all_tested(tested: DataFrame, dropped: DataFrame, key: str = "spike_id", label: str = "label") -> DataFrame:
    """Labels of all spikes that were tested, those dropped since with -1."""
    return tested.select(key, label).unionByName(dropped.join(tested, key, "left_anti").select(key, F.lit(-1).cast(tested.schema[label].dataType).alias(label)))


def candidate_labels(rows: DataFrame, label: str = "label", candidate: str = "candidate") -> DataFrame:
    """The label of each candidate; a candidate under two labels is an error when the result is read."""
    by = rows.select(label, candidate).distinct().groupBy(candidate).agg(F.min(label).alias(label), F.count(F.lit(1)).alias("_n"))
    return by.withColumn(label, F.when(F.col("_n") == 1, F.col(label)).otherwise(F.raise_error(F.concat(F.lit("several labels of candidate "), F.col(candidate).cast("string"))))).drop("_n")


def vacuum(rows: DataFrame, cand: str = "cand", noise: str = "noise_r") -> DataFrame:
    """Arrays of candidates {unit, ll, r}: what invalid ones (unit below 0) had of the responsibility goes to the noise, and their log-likelihood becomes minus infinity."""
    lost = F.aggregate(F.filter(cand, lambda c: c["unit"] < 0), F.lit(0.0), lambda s, c: s + c["r"])
    clean = F.transform(cand, lambda c: F.struct(c["unit"].alias("unit"), F.when(c["unit"] < 0, F.lit(float("-inf"))).otherwise(c["ll"]).alias("ll"), F.when(c["unit"] < 0, 0.0).otherwise(c["r"]).alias("r")))
    return rows.withColumn(noise, F.col(noise) + lost).withColumn(cand, clean)


def centered_bins(x: Column, width: float = 1.0) -> Column:
    """The bin's number, bin 0 being centred on 0."""
    return F.floor(x / width + 0.5).cast("long")


def cross_correlogram(a: DataFrame, b: DataFrame, bin_: int, lags: int, t: str = "t", label: str = "label") -> DataFrame:
    """(i, j, lag, n): for each pair of units, spikes of b so many whole steps of `bin_` (rounded to the nearest, halves up) after one of a, up to `lags` steps.

    The lag is the difference of whole steps, and one more or less by how the times within the steps compare; so a group of two steps and two parts of them (PART rows or so) sorts the times of each unit of b and
    counts, for all of a, how many lie before a bound. Equal times of a unit are one row with a number. No pairs of spikes are made.
    """
    ship(a.sparkSession)

    def stepped(df: DataFrame) -> DataFrame:
        q = F.floor(F.col(t) / bin_).cast("long")
        return df.where(F.col(t).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label).alias("u"), q.alias("q"), (F.col(t) - q * bin_).alias("r")).agg(F.count(F.lit(1)).alias("n"))

    kind = a.schema[label].dataType.simpleString(), b.schema[label].dataType.simpleString()
    left, right = stepped(a), stepped(b)
    parts = [-(-(df.groupBy("q").count().agg(F.max("count")).first()[0] or 1) // PART) for df in (left, right)]
    sides = []
    for df, sign, own, other in ((left, 1, 0, 1), (right, -1, 1, 0)):
        ranks = F.sequence(F.lit(0), F.lit(parts[other] - 1))
        far = df.withColumn("_far", F.explode(F.array(*(F.lit(k).cast("long") for k in range(-lags - 1, lags + 2)))))
        far = far.withColumns({"_p": F.pmod(F.xxhash64("u", "r"), F.lit(parts[own])).cast("int"), "_o": F.explode(ranks)})
        at = {"qa": F.col("q") if sign > 0 else F.col("q") - F.col("_far"), "far": F.col("_far")}
        sides.append(far.withColumns(at).select("qa", "far", F.col("_p" if sign > 0 else "_o").alias("pa"), F.col("_o" if sign > 0 else "_p").alias("pb"), "u", "r", "n"))

    def counted(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out, far = [], int(key[1])
        if len(x) and len(y):
            names, unit = np.unique(x["u"].to_numpy(), return_inverse=True)
            r, n = x["r"].to_numpy(), x["n"].to_numpy()
            for j, g in y.sort_values("r").groupby("u"):
                upto = np.concatenate([[0], np.cumsum(g["n"].to_numpy())])
                times = 2 * g["r"].to_numpy()
                low, high = (upto[np.searchsorted(times, 2 * r + d)] for d in (-bin_, bin_))
                # before half a step down: a lag less; from half a step up: a lag more
                for shift, found in ((-1, low), (0, high - low), (1, upto[-1] - high)):
                    if abs(far + shift) <= lags:
                        total = np.zeros(len(names), np.int64)
                        np.add.at(total, unit, n * found)
                        out += [(names[k], j, far + shift, total[k]) for k in np.flatnonzero(total)]
        return pd.DataFrame(out, columns=["i", "j", "lag", "n"])

    keys = ["qa", "far", "pa", "pb"]
    found = sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInPandas(counted, f"i {kind[0]}, j {kind[1]}, lag long, n long")
    return found.groupBy("i", "j", "lag").agg(F.sum("n").alias("n"))


def friends(pairs: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """(unit, entropy): how spread a unit's flagged partners are over units, in nats."""
    n = pairs.groupBy(F.col(a).alias("unit"), b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = n.groupBy("unit").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.log("n")).alias("e"))
    return total.select("unit", (F.log("s") - F.col("e") / F.col("s")).alias("entropy"))


def brier(rows: DataFrame, truth: str = "truth", label: str = "label", cand: str = "cand", by: list[str] | None = None) -> DataFrame:
    """Mean Brier score of soft assignments. A spike matched to its unit with responsibility p has (1 - p)^2 and the squares of all others; a false or a missed one has 2."""
    own = F.aggregate(cand, F.lit(0.0), lambda s, c: s + F.when(c["unit"] == F.col(label), c["r"]).otherwise(0.0))
    squares = F.aggregate(cand, F.lit(0.0), lambda s, c: s + F.when(c["unit"] == F.col(label), 0.0).otherwise(c["r"] * c["r"]))
    score = F.when(F.col(truth).isNull() | F.col(label).isNull(), F.lit(2.0)).otherwise((1 - own) * (1 - own) + squares)
    return rows.groupBy(*(by or [])).agg(F.avg(score).alias("brier"), F.count(F.lit(1)).alias("n"))


def unit_brier(true: DataFrame, best: DataFrame, false: DataFrame | None = None, unit: str = "truth", matched: str = "matched", cand: str = "cand", noise: str = "noise_r") -> DataFrame:
    """(unit, match, n, n_false, hard, soft, own): Brier scores of each true unit, 0 to 2, from its spikes and those that its match has without cause.

    best (unit, match) names the tested unit that stands for a true one; without a match a unit has 2. A spike of `true` that was found has (1 - p)^2 for its match's
    responsibility p, and the squares of the other candidates' and of noise; in the hard score it has 0. One that was missed (`matched` false or null, or without candidates) has 2, and so has each spike of
    `false` (unit, the tested one), which are those that no true spike accounts for. `own` is the mean of p over all true spikes. Sums are partial before the shuffle; only tables of units are broadcast.
    """
    rows = true.join(F.broadcast(best.select(F.col("unit").alias(unit), F.col("match").alias("_match"))), unit, "left")
    own = F.aggregate(cand, F.lit(0.0), lambda s, c: s + F.when(c["unit"] == F.col("_match"), c["r"]).otherwise(0.0))
    others = F.aggregate(cand, F.lit(0.0), lambda s, c: s + F.when(c["unit"] == F.col("_match"), 0.0).otherwise(c["r"] * c["r"]))
    lost = F.col("_match").isNull() | ~F.coalesce(F.col(matched), F.lit(False)) | F.col(cand).isNull()
    kept = F.coalesce(F.col(noise), F.lit(0.0))
    sums = rows.groupBy(F.col(unit).alias("unit")).agg(
        F.first("_match").alias("match"),
        F.count(F.lit(1)).alias("_true"),
        F.sum(F.when(lost, 2).otherwise(0)).alias("_hard"),
        F.sum(F.when(lost, 2.0).otherwise((1 - own) * (1 - own) + others + kept * kept)).alias("_soft"),
        F.sum(F.when(lost, 0.0).otherwise(own)).alias("_own"),
    )
    extra = F.lit(0).cast("long")
    if false is not None:
        sums = sums.join(false.groupBy(F.col("unit").alias("match")).agg(F.count(F.lit(1)).alias("_false")), "match", "left")
        extra = F.coalesce(F.col("_false"), extra)
    n = F.col("_true") + extra
    return sums.select("unit", "match", n.alias("n"), extra.alias("n_false"), ((F.col("_hard") + 2 * extra) / n).alias("hard"), ((F.col("_soft") + 2 * extra) / n).alias("soft"), (F.col("_own") / F.col("_true")).alias("own"))


def merge_mask(pairs: DataFrame, least: float, coverage: float, iou: float) -> DataFrame:
    """Which pairs of units may merge: alike enough in coentropy, and by coverage or overlap."""
    return pairs.withColumn("may_merge", ((F.col("cov") >= coverage) | (F.col("iou") >= iou)) & (F.col("coentropy") >= least))


def false_positive_threshold(false: DataFrame, frames: float, units: DataFrame, total: float, most: float = 1.0, step: float = 1.0, least: float = 5.0) -> DataFrame:
    """(unit, threshold): the least score, in whole steps from `least`, above which a unit's false positives (unit, score), scaled from their own frames to the recording's, are below
    `most` times its count (unit, n). Counts above a score are a window over steps, of which there are few, not over rows."""
    binned = false.where(F.col("score") >= least).groupBy("unit", F.floor((F.col("score") - least) / step).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    above = binned.withColumn("above", F.sum("c").over(Window.partitionBy("unit").orderBy(F.desc("k"))))
    bad = above.join(units, "unit").where(F.col("above") * (total / frames) >= F.col("n") * most).groupBy("unit").agg((F.max("k") + 1).alias("k"))
    return units.join(bad, "unit", "left").select("unit", (F.coalesce("k", F.lit(0)) * step + least).alias("threshold"))
