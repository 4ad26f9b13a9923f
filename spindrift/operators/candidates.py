"""Which units may explain which rows: candidate sets of a mixture over neighbourhoods of channels, as pair tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seen_together(rows: DataFrame, overlapping: DataFrame, unit: str = "label", neighborhood: str = "neighborhood") -> DataFrame:
    """(unit, neighborhood): units allowed in a neighbourhood: those with rows in it, or in one that overlaps it (i, j)."""
    own = rows.where(F.col(unit) >= 0).select(F.col(unit).alias("unit"), F.col(neighborhood).alias("i")).distinct()
    return own.join(F.broadcast(overlapping), "i").select("unit", F.col("j").alias("neighborhood")).distinct()


def search_sets(distances: DataFrame, allowed: DataFrame, n: int) -> DataFrame:
    """(i, j, rank): the n nearest units of each (itself first, at distance 0) that share a neighbourhood with it; distances (i, j, d) in both directions, equal ones by number."""
    share = allowed.withColumnRenamed("unit", "i").join(allowed.withColumnRenamed("unit", "j"), "neighborhood").select("i", "j").distinct()
    own = share.where("i = j").withColumn("d", F.lit(-1.0))
    all_ = distances.where("i <> j").join(share, ["i", "j"]).select("i", "j", "d").unionByName(own)
    return all_.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j")) - 1).where(F.col("rank") < n).drop("d")


def by_neighborhood(allowed: DataFrame) -> DataFrame:
    """(neighborhood, units, n): the units proposed in each; a list of units, bounded by their number."""
    return allowed.groupBy("neighborhood").agg(F.sort_array(F.collect_set("unit")).alias("units"), F.count_distinct("unit").alias("n"))


def without_repeats(candidates: Column) -> Column:
    """Later repeats in an array of candidates become -1."""
    return F.transform(candidates, lambda c, i: F.when((c >= 0) & (F.array_position(candidates, c) == i + 1), c).otherwise(F.lit(-1)))


def counted(candidates: Column) -> Column:
    return F.size(F.filter(candidates, lambda c: c >= 0))


def explored(rows: DataFrame, allowed: DataFrame, n: int, seed: int = 0, key: str = "spike_id", neighborhood: str = "neighborhood") -> DataFrame:
    """(key, unit): n candidates drawn for each row among the units allowed in its neighbourhood; draws follow from key, place in the draw and seed."""
    lists = by_neighborhood(allowed).withColumnRenamed("neighborhood", neighborhood)
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at("units", (F.pmod(F.xxhash64(key, k, F.lit(seed)), F.col("n")) + 1).cast("int")))
    return rows.join(F.broadcast(lists), neighborhood).select(key, F.explode(F.array_distinct(picks)).alias("unit"))


def united(*tables: DataFrame) -> DataFrame:
    """The union of sets (unit, neighborhood)."""
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def search_size(units: int, most: int, share: float = 0.25) -> int:
    """How many neighbours of a unit to search: a share of all, one at least and `most` at most."""
    return max(1, min(most, units, round(share * units)))


def nearest_above(pairs: DataFrame, density: DataFrame) -> DataFrame:
    """(i, above): among the pairs (i, j, d) of a sparse distance table, the nearest j that is denser (key, density); i itself where none is."""
    di = density.select(F.col("key").alias("i"), F.col("density").alias("di"))
    dj = density.select(F.col("key").alias("j"), F.col("density").alias("dj"))
    higher = pairs.join(di, "i").join(dj, "j").where("dj > di").groupBy("i").agg(F.min(F.struct("d", "j")).alias("m"))
    return di.select("i").join(higher, "i", "left").select("i", F.coalesce("m.j", "i").alias("above"))


def likelihood(d2: Column, sigma2: float, log_proportion: Column) -> Column:
    """Log-likelihood of an isotropic unit from a squared distance."""
    return -d2 / (2 * sigma2) + log_proportion


def near_centroid_distances(rows: DataFrame, centroids: DataFrame, near: DataFrame, key: str = "spike_id", v: str = "v", label: str = "label") -> DataFrame:
    """(key, centroid, d2): squared distances of a row to the centroids (label, v) that are near its own label's (i, j), and to no others."""
    from ..functions.arrays import square

    there = near.join(centroids.select(F.col(label).alias("j"), F.col(v).alias("_c")), "j").withColumnRenamed("i", label)
    return rows.join(F.broadcast(there), label).select(key, F.col("j").alias("centroid"), square(F.zip_with(v, "_c", lambda a, b: a.cast("double") - b)).alias("d2"))


def unit_counts(rows: DataFrame, key: str = "spike_id", neighborhood: str | None = None) -> DataFrame:
    """Sums of responsibilities (key, unit, r) by unit, by unit and neighbourhood if that is named, and of squares; plain sums, so parts of a table can be added up."""
    return rows.groupBy("unit", *([neighborhood] if neighborhood else [])).agg(F.sum("r").alias("n"), F.sum(F.col("r") * F.col("r")).alias("n2"))


def combined_moments(parts: DataFrame) -> DataFrame:
    """(unit, sample, n, mean, m2) from parts of the same: the mean and the squares about it of the whole, by Chan's rule."""
    total = parts.groupBy("unit", "sample").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    about = parts.join(total, ["unit", "sample"]).groupBy("unit", "sample")
    return about.agg(F.max("_n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("m2"))


def explore_pool(allowed: DataFrame, search: DataFrame) -> DataFrame:
    """(unit, neighborhood, candidate): for each unit in a neighbourhood it's allowed in, the units allowed there too that its search set (i, j), itself included, doesn't hold."""
    both = allowed.join(allowed.withColumnRenamed("unit", "candidate"), "neighborhood").where("unit <> candidate")
    return both.join(search.select(F.col("i").alias("unit"), F.col("j").alias("candidate")), ["unit", "candidate"], "left_anti").select("unit", "neighborhood", "candidate")


def first_candidates(rows: DataFrame, allowed: DataFrame, n: int, seed: int = 0, key: str = "spike_id", label: str = "label", neighborhood: str = "neighborhood") -> DataFrame:
    """(key, cand): the label and n - 1 other units allowed in the neighbourhood, drawn without replacement, -1 where there are too few. Draws follow from key, unit and seed."""
    lists = by_neighborhood(allowed).select(F.col("neighborhood").alias(neighborhood), "units")
    drawn = F.array_sort(F.transform(F.array_except(F.coalesce("units", F.array().cast("array<long>")), F.array(F.col(label).cast("long"))), lambda u: F.struct(F.xxhash64(key, u, F.lit(seed)).alias("h"), u.alias("u"))))
    some = F.slice(F.transform(drawn, lambda p: p["u"]), 1, n - 1) if n > 1 else F.array().cast("array<long>")
    padded = F.slice(F.concat(F.array(F.col(label).cast("long")), some, F.array_repeat(F.lit(-1).cast("long"), n)), 1, n)
    return rows.join(F.broadcast(lists), neighborhood, "left").select(key, padded.alias("cand"))
