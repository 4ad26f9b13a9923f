"""Drift: registering positions with a displacement field on time bins, and geometry that covers the drift."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def displacement_at(spikes: DataFrame, motion: DataFrame, t: str, bin_: float, t0: float = 0.0) -> DataFrame:
    """disp: linear between the centres of time bins (t_bin, disp), constant beyond the ends. The bin's number is an equi-join key; a rigid field is a small table."""
    own = F.floor((F.col(t) - t0) / bin_ - 0.5)
    m = motion.select(F.floor((F.col("t_bin") - t0) / bin_).alias("_k"), F.col("disp").alias("_d"))
    ends = motion.agg(F.min(F.struct("t_bin", "disp"))["disp"].alias("_first"), F.max(F.struct("t_bin", "disp"))["disp"].alias("_last"), F.min("t_bin").alias("_lo"), F.max("t_bin").alias("_hi"))
    a, b = m.withColumnsRenamed({"_k": "_ka", "_d": "_da"}), m.withColumnsRenamed({"_k": "_kb", "_d": "_db"})
    j = spikes.withColumn("_ka", own).withColumn("_kb", own + 1).join(F.broadcast(a), "_ka", "left").join(F.broadcast(b), "_kb", "left").join(F.broadcast(ends))
    share = (F.col(t) - t0) / bin_ - 0.5 - F.col("_ka")
    mid = F.col("_da") + share * (F.col("_db") - F.col("_da"))
    disp = F.when(F.col(t) <= F.col("_lo"), F.col("_first")).when(F.col(t) >= F.col("_hi"), F.col("_last")).otherwise(mid)
    return j.withColumn("disp", disp).drop("_ka", "_kb", "_da", "_db", "_first", "_last", "_lo", "_hi")


def correct(spikes: DataFrame, motion: DataFrame, t: str, z: str, bin_: float, to: str = "z_reg") -> DataFrame:
    """z less the displacement of the spike's time bin, as a step function."""
    m = motion.select(F.col("t_bin").alias("_k"), "disp")
    return spikes.withColumn("_k", F.floor(F.col(t) / bin_)).join(m, "_k", "left").withColumn(to, F.col(z) - F.coalesce("disp", F.lit(0.0))).drop("_k")


def uncorrect(spikes: DataFrame, motion: DataFrame, t: str, z_reg: str, bin_: float, to: str = "z") -> DataFrame:
    """The inverse: the displacement is added."""
    m = motion.select(F.col("t_bin").alias("_k"), "disp")
    return spikes.withColumn("_k", F.floor(F.col(t) / bin_)).join(m, "_k", "left").withColumn(to, F.col(z_reg) + F.coalesce("disp", F.lit(0.0))).drop("_k")


def pitch_shift(displacement: Column, pitch: float, mode: str = "round") -> Column:
    """Whole pitches by which the probe has moved: it moves by -displacement. mode "round" takes the nearest number, halves to even; "floor" drops the fraction, towards 0."""
    moved = -displacement / pitch
    return F.bround(moved, 0).cast("long") if mode == "round" else moved.cast("long")


def registered_geometry(channels: DataFrame, pitch: float, up: int, down: int) -> DataFrame:
    """The probe and its copies shifted by -down to up pitches, each site once, numbered by depth and then by x."""
    shifted = channels.select("x", F.explode(F.sequence(F.lit(-down), F.lit(up))).alias("k"), "z").select("x", F.round(F.col("z") + F.col("k") * pitch, 6).alias("z")).distinct()
    return shifted.withColumn("reg_channel", (F.row_number().over(Window.orderBy("z", "x")) - 1).cast("int"))


def rigid_motion(spikes: DataFrame, t: str, z: str, weight: str, t_bin: float, z_bin: float, most: int = 20) -> DataFrame:
    """Displacement of each time bin against the first, as the depth lag of the greatest product of weighted depth histograms; ties to the smaller lag."""
    h = spikes.groupBy(F.floor(F.col(t) / t_bin).alias("tb"), F.floor(F.col(z) / z_bin).alias("zb")).agg(F.sum(weight).alias("w"))
    first = h.agg(F.min("tb").alias("t0"))
    ref = h.join(F.broadcast(first)).where("tb = t0").select(F.col("zb").alias("rz"), F.col("w").alias("rw"))
    lagged = h.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("rz", F.col("zb") - F.col("lag"))
    score = lagged.join(F.broadcast(ref), "rz").groupBy("tb", "lag").agg(F.sum(F.col("w") * F.col("rw")).alias("s"))
    best = score.groupBy("tb").agg(F.max(F.struct("s", (-F.abs("lag")).alias("near"), "lag")).alias("m"))
    return best.select(F.col("tb").alias("t_bin"), (F.col("m.lag") * z_bin).alias("disp"))


def field_at(spikes: DataFrame, motion: DataFrame, t: str, z: str, t_bin: float, z_bin: float, to: str = "disp") -> DataFrame:
    """Displacement of a field (t_bin, z_bin, disp) given at the centres of a full grid of bins numbered from 0: linear in time and depth, constant beyond the ends.

    The four corners are looked up in maps by bin numbers; the field is small beside the spikes, and joins by its size.
    """
    size = motion.agg(F.max("t_bin").alias("_nt"), F.max("z_bin").alias("_nz"))
    x = spikes.join(F.broadcast(size))
    place = lambda c, w, n: F.greatest(F.least(F.col(c) / w - 0.5, F.col(n).cast("double")), F.lit(0.0))
    x = x.withColumn("_pt", place(t, t_bin, "_nt")).withColumn("_pz", place(z, z_bin, "_nz"))
    x = x.withColumn("_it", F.floor("_pt")).withColumn("_iz", F.floor("_pz"))
    cells = motion.select(F.col("t_bin").cast("long").alias("_it"), F.col("z_bin").cast("long").alias("_iz"), F.col("disp").cast("double").alias("_d"))
    # each cell carries its own and its next corners, so one join by cell gives all four
    pieces = [cells.select((F.col("_it") - a).alias("_it"), (F.col("_iz") - b).alias("_iz"), F.lit(f"{a}{b}").alias("_c"), "_d") for a in (0, 1) for b in (0, 1)]
    corners = pieces[0].unionByName(pieces[1]).unionByName(pieces[2]).unionByName(pieces[3])
    wide = corners.groupBy("_it", "_iz").agg(*(F.max(F.when(F.col("_c") == c, F.col("_d"))).alias(f"_d{c}") for c in ("00", "01", "10", "11")))
    x = x.join(wide, ["_it", "_iz"], "left")
    st, sz = F.col("_pt") - F.col("_it"), F.col("_pz") - F.col("_iz")
    d00 = F.col("_d00")
    d01, d10 = F.coalesce("_d01", d00), F.coalesce("_d10", d00)
    d11 = F.coalesce("_d11", d10, d01)
    low, high = d00 + sz * (d01 - d00), d10 + sz * (d11 - d10)
    return x.withColumn(to, low + st * (high - low)).drop("_nt", "_nz", "_pt", "_pz", "_it", "_iz", "_d00", "_d01", "_d10", "_d11")


def correct_field(spikes: DataFrame, motion: DataFrame, t: str, z: str, t_bin: float, z_bin: float, to: str = "z_reg") -> DataFrame:
    """z less the field's displacement at the spike's time and depth."""
    return field_at(spikes, motion, t, z, t_bin, z_bin, "_disp").withColumn(to, F.col(z) - F.col("_disp")).drop("_disp")


def pitch(channels: DataFrame) -> DataFrame:
    """(pitch) in one row: the least vertical gap between sites of one x, or where no column has two, between any two depths; null for one depth."""
    gap = lambda w: F.col("z") - F.lag("z").over(w)
    own = channels.select("x", "z").distinct().withColumn("g", gap(Window.partitionBy("x").orderBy("z"))).where("g > 0").agg(F.min("g").alias("a"))
    # the table of channels is small, so one window over its depths is a small one
    any_ = channels.select("z").distinct().withColumn("g", gap(Window.orderBy("z"))).where("g > 0").agg(F.min("g").alias("b"))
    return own.join(any_).select(F.coalesce("a", "b").alias("pitch"))


def fill_holes(channels: DataFrame, step: float) -> DataFrame:
    """(x, z): the sites, and in each column those missing between its lowest and highest in steps of step."""
    ends = channels.groupBy("x").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return ends.select("x", F.explode(F.sequence(F.lit(0), F.round((F.col("hi") - F.col("lo")) / step).cast("int"))).alias("k"), "lo").select("x", F.round(F.col("lo") + F.col("k") * step, 6).alias("z")).unionByName(channels.select("x", F.round("z", 6).alias("z"))).distinct()


def speed_limit(motion: DataFrame, most: float) -> DataFrame:
    """Time bins whose displacement moved from the bin before by more than most keep their place but are null."""
    w = Window.partitionBy(*(c for c in motion.columns if c == "z_bin")).orderBy("t_bin")
    return motion.withColumn("disp", F.when(F.abs(F.col("disp") - F.lag("disp").over(w)) > most, F.lit(None)).otherwise(F.col("disp")))


def kernel(source: np.ndarray, target: np.ndarray, kind: str, sigma: float = 1.0, alpha: float = 1.0) -> np.ndarray:
    """(target, source) weights of a spatial kernel: nearest, idw, rbf, rq, multiquadric or thinplate; distances are in sigmas."""
    r2 = ((target[:, None] - source[None]) ** 2).sum(-1) / sigma**2
    if kind == "nearest":
        return np.eye(len(source))[r2.argmin(1)]
    if kind == "idw":
        w = 1 / np.maximum(np.sqrt(r2), 1e-10)
        return w / w.sum(1, keepdims=True)
    if kind == "rbf":
        return np.exp(-r2 / 2)
    if kind == "rq":
        return (1 + r2) ** -alpha
    if kind == "multiquadric":
        return -((1 + r2) ** -0.5)
    if kind == "thinplate":
        return np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1.0)), 0.0)
    raise ValueError(f"no such kernel: {kind}")


def interpolation(source: np.ndarray, target: np.ndarray, kind: str, sigma: float = 1.0, degree: int = -1, ridge: float = 0.0) -> np.ndarray:
    """(target, source) matrix that carries features from sites to sites. nearest and idw are weights as they are, the others solve for the features at the
    sources, with polynomial terms up to degree (-1: none, 0: constant, 1: linear) that are reproduced exactly. Apply it with noise.apply_matrix."""
    k = kernel(source, target, kind, sigma)
    if kind in ("nearest", "idw"):
        return k
    terms = lambda p: np.concatenate([np.ones((len(p), 1)), p / sigma], 1)[:, : 0 if degree < 0 else 1 if degree == 0 else None]
    a, b = terms(source), terms(target)
    n, m = len(source), a.shape[1]
    system = np.block([[kernel(source, source, kind, sigma) + ridge * np.eye(n), a], [a.T, np.zeros((m, m))]])
    return (np.concatenate([k, b], 1) @ np.linalg.pinv(system))[:, :n]
