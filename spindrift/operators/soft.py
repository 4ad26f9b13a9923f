"""Soft assignments: a row for each (spike, candidate unit) with log-likelihood ll and responsibility r."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_sum_exp(rows: DataFrame, by: list[str], ll: str = "ll", to: str = "lse") -> DataFrame:
    """Stable: the greatest is taken out first; one aggregation with an array would hold a group, so two passes share one shuffle key."""
    m = rows.groupBy(*by).agg(F.max(ll).alias("_m"))
    return rows.join(m, by).groupBy(*by).agg((F.first("_m") + F.ln(F.sum(F.exp(F.col(ll) - F.col("_m"))))).alias(to))


def soft_assign(rows: DataFrame, spike: str, ll: str = "ll", noise: float | None = None, k: int = 3, unit: str = "unit") -> DataFrame:
    """Each spike's k likeliest candidates with responsibilities; the noise component, if any, takes its share but gets no row."""
    w = Window.partitionBy(spike).orderBy(F.desc(ll), unit)
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    own = Window.partitionBy(spike)
    best = F.greatest(F.max(ll).over(own), F.lit(noise)) if noise is not None else F.max(ll).over(own)
    e = F.exp(F.col(ll) - F.col("_m"))
    extra = F.exp(F.lit(noise) - F.col("_m")) if noise is not None else F.lit(0.0)
    return top.withColumn("_m", best).withColumn("r", e / (F.sum(e).over(own) + extra)).drop("_m")


def to_arrays(rows: DataFrame, spike: str, unit: str = "unit") -> DataFrame:
    """cand: array of (unit, ll, r), best first; a spike has a fixed number of candidates."""
    return rows.groupBy(spike).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(unit).alias("unit"), "ll", "r"))), lambda s: F.struct(s["unit"].alias("unit"), s["ll"].alias("ll"), s["r"].alias("r"))).alias("cand"))


def explode_soft(soft: DataFrame, spike: str, cand: str = "cand") -> DataFrame:
    """A row for each candidate with a positive responsibility, and the spike's entropy."""
    e = F.aggregate(F.filter(cand, lambda c: c["r"] > 0), F.lit(0.0), lambda s, c: s - c["r"] * F.ln(c["r"]))
    return soft.select(spike, e.alias("entropy"), F.posexplode(cand).alias("slot", "c")).where("c.r > 0 and c.unit >= 0").select(spike, "entropy", "slot", "c.unit", "c.r")


def entropy(rows: DataFrame, spike: str, r: str = "r") -> DataFrame:
    return rows.groupBy(spike).agg(F.sum(F.when(F.col(r) > 0, -F.col(r) * F.ln(r)).otherwise(0.0)).alias("entropy"))


def coentropy(rows: DataFrame, spike: str, unit: str = "unit", r: str = "r") -> DataFrame:
    """Unit pairs (i < j) of a spike's best candidate with each other one: co-occurrences, and mean decrease of entropy if the two were one."""
    best = rows.where("rank = 1").select(spike, F.col(unit).alias("u"), F.col(r).alias("ru"))
    other = rows.where("rank > 1").select(spike, F.col(unit).alias("v"), F.col(r).alias("rv"))
    p = best.join(other, spike)
    h = lambda c: F.when(F.col(c) > 0, -F.col(c) * F.ln(F.col(c))).otherwise(0.0)
    p = p.withColumn("rs", F.col("ru") + F.col("rv")).withColumn("drop", h("ru") + h("rv") - h("rs"))
    return p.groupBy(F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.avg("drop").alias("coentropy"))


def iou_and_coverage(rows: DataFrame, spike: str, unit: str = "unit") -> DataFrame:
    """Overlap of units in spikes' candidates: iou = spikes with both / with either; cov = with both / with the rarer one."""
    n = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n"))
    a, b = rows.select(spike, F.col(unit).alias("i")), rows.select(spike, F.col(unit).alias("j"))
    both = a.join(b, spike).where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("both"))
    j = both.join(n.select(F.col(unit).alias("i"), F.col("n").alias("ni")), "i").join(n.select(F.col(unit).alias("j"), F.col("n").alias("nj")), "j")
    return j.select("i", "j", "both", (F.col("both") / (F.col("ni") + F.col("nj") - F.col("both"))).alias("iou"), (F.col("both") / F.least("ni", "nj")).alias("cov"))


def merge(rows: DataFrame, names: DataFrame, spike: str, unit: str = "unit") -> DataFrame:
    """Candidates under new names (unit, new): responsibilities added, log-likelihoods log-added, ranked anew by log-likelihood."""
    named = rows.join(F.broadcast(names), unit)
    m = named.groupBy(spike, "new").agg(F.max("ll").alias("_m"), F.sum("r").alias("r"), F.collect_list("ll").alias("_l"))
    out = m.withColumn("ll", F.col("_m") + F.ln(F.aggregate(F.transform("_l", lambda x: F.exp(x - F.col("_m"))), F.lit(0.0), lambda s, x: s + x))).drop("_m", "_l")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(spike).orderBy(F.desc("ll"), "new")))


def renormalize(rows: DataFrame, spike: str, unit: str = "unit", noise: str | None = None) -> DataFrame:
    """rank and r anew from ll; noise names a column with the spike's log-likelihood of noise, which takes its share. Candidates of ll null or -infinity get 0."""
    own = Window.partitionBy(spike)
    ll = F.coalesce("ll", F.lit(float("-inf")))
    top = F.max(ll).over(own)
    top = F.greatest(top, F.coalesce(noise, F.lit(float("-inf")))) if noise else top
    x = rows.withColumn("_m", F.when(top == float("-inf"), F.lit(0.0)).otherwise(top)).withColumn("_e", F.exp(ll - F.col("_m")))
    extra = F.exp(F.coalesce(noise, F.lit(float("-inf"))) - F.col("_m")) if noise else F.lit(0.0)
    x = x.withColumn("r", F.coalesce(F.try_divide("_e", F.sum("_e").over(own) + extra), F.lit(0.0)))
    return x.withColumn("rank", F.row_number().over(own.orderBy(F.desc(ll), unit))).drop("_m", "_e")


def remove_units(rows: DataFrame, units: DataFrame, spike: str, unit: str = "unit", noise: str | None = None) -> DataFrame:
    """Candidates without those of the given units, responsibilities anew; a spike left without any has no row."""
    return renormalize(rows.join(units.select(unit).distinct(), unit, "left_anti"), spike, unit, noise)


def adjust_proportions(rows: DataFrame, change: DataFrame, spike: str, unit: str = "unit", noise: str | None = None) -> DataFrame:
    """Log-likelihoods shifted by the change (unit, change) of their unit's log proportion, responsibilities anew."""
    moved = rows.join(change.select(unit, "change"), unit, "left").withColumn("ll", F.col("ll") + F.coalesce("change", F.lit(0.0))).drop("change")
    return renormalize(moved, spike, unit, noise)


def top_labels(rows: DataFrame, spike: str, unit: str = "unit", noise: str | None = None) -> DataFrame:
    """(spike, label): the likeliest candidate, of equals the smaller one; -1 where noise is strictly likelier."""
    lost = F.max(noise) if noise else F.lit(None).cast("double")
    best = rows.groupBy(spike).agg(F.max(F.struct("ll", (-F.col(unit)).alias("u"))).alias("m"), lost.alias("n"))
    return best.select(spike, F.when(F.col("n") > F.col("m.ll"), F.lit(-1)).otherwise(-F.col("m.u")).alias("label"))


def mean_responsibility(rows: DataFrame, spike: str, unit: str = "unit") -> DataFrame:
    """(unit, mean): a unit's responsibilities summed over all spikes of the table, over their number."""
    n = rows.select(spike).distinct().agg(F.count(F.lit(1)).alias("_n"))
    return rows.groupBy(unit).agg(F.sum("r").alias("_s")).join(F.broadcast(n)).select(unit, (F.col("_s") / F.col("_n")).alias("mean"))


def criterion(rows: DataFrame, spike: str, alpha: float = 1.0) -> DataFrame:
    """One row (ecl, elbo): mean log-evidence less alpha times the mean entropy, and the mean of sum r (ll - ln r)."""
    m = rows.groupBy(spike).agg(F.max("ll").alias("_m"))
    pos = F.col("r") > 0
    each = rows.join(m, spike).groupBy(spike).agg(
        (F.first("_m") + F.ln(F.sum(F.exp(F.col("ll") - F.col("_m"))))).alias("lse"),
        F.sum(F.when(pos, -F.col("r") * F.ln("r")).otherwise(0.0)).alias("h"),
        F.sum(F.when(pos, F.col("r") * (F.col("ll") - F.ln("r"))).otherwise(0.0)).alias("e"),
    )
    return each.agg((F.avg("lse") - alpha * F.avg("h")).alias("ecl"), F.avg("e").alias("elbo"))


def bimodality(rows: DataFrame, spike: str, dx: float = 1.0, reach: int = 50, unit: str = "unit") -> DataFrame:
    """(i, j, n, score, ratio) for pairs of units that share spikes as candidates: the smoothed histogram of ll differences at 0 over the lesser (score) and the greater (ratio) peak of its two sides.

    Low scores say that two units are apart. Differences beyond reach bins count in the outermost one; only the histograms, of bounded length, are brought together for a pair.
    """
    a, b = rows.select(spike, F.col(unit).alias("i"), F.col("ll").alias("li")), rows.select(spike, F.col(unit).alias("j"), F.col("ll").alias("lj"))
    gap = F.bround((F.col("li") - F.col("lj")) / dx, 0)
    bins = a.join(b, spike).where("i < j").groupBy("i", "j", F.greatest(F.least(gap, F.lit(float(reach))), F.lit(float(-reach))).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    taps = F.explode(F.array(*(F.struct((F.col("b") + k).alias("b"), (F.col("c") * w).alias("c")) for k, w in ((-1, 0.25), (0, 0.5), (1, 0.25))))).alias("p")
    n = bins.groupBy("i", "j").agg(F.sum("c").alias("n"))
    h = bins.select("i", "j", taps).groupBy("i", "j", "p.b").agg(F.sum("p.c").alias("h"))
    side = h.groupBy("i", "j").agg(*(F.coalesce(F.max(F.when(c, F.col("h"))), F.lit(0.0)).alias(name) for name, c in (("h0", F.col("b") == 0), ("l", F.col("b") < 0), ("r", F.col("b") > 0))))
    return side.join(n, ["i", "j"]).select("i", "j", "n", *(F.coalesce(F.try_divide("h0", f("l", "r")), F.lit(0.0)).alias(name) for name, f in (("score", F.least), ("ratio", F.greatest))))
