"""Channels as tables: neighbour indexes (channel, slot, neighbor), snippets on them (spike_id, channel, slot, v), shifts of the probe and sets of channels.

A dense array of spikes by slots is here a row for each spike and slot, so taking a part of the slots, or laying them out anew, is a join with a small table of slots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import lists_by_place


def _slots(pairs: DataFrame, *order: str) -> DataFrame:
    """Slots from 0 in the order of the neighbour, or as said; a window over one channel's neighbours."""
    w = Window.partitionBy("channel").orderBy(*(order or ("neighbor",)))
    return pairs.select("channel", (F.row_number().over(w) - 1).cast("int").alias("slot"), "neighbor")


def single_index(channels: DataFrame) -> DataFrame:
    return channels.select("channel", F.lit(0).alias("slot"), F.col("channel").alias("neighbor"))


def full_index(channels: DataFrame) -> DataFrame:
    """Every channel of the probe beside every other; the probe is a small table."""
    return _slots(channels.select("channel").join(channels.select(F.col("channel").alias("neighbor"))))


def contiguous_index(channels: DataFrame, n: int = 40) -> DataFrame:
    """The n channels nearest by number, fewer at the ends: from channel - n / 2 on."""
    first = F.col("channel") - n // 2
    pairs = channels.select("channel", F.explode(F.sequence(first, first + n - 1)).alias("neighbor"))
    return _slots(pairs.join(channels.select(F.col("channel").alias("neighbor")), "neighbor", "left_semi"))


def regular_index(index: DataFrame, channels: DataFrame, step: float, of: DataFrame | None = None) -> DataFrame:
    """(channel, slot, neighbor) with the same slots for every channel, or those of `of`: a slot is a relative position, in order of z and x, and its neighbour is null where the probe has none."""
    at = channels.select("channel", F.round(F.col("x") / step).cast("long").alias("x"), F.round(F.col("z") / step).cast("long").alias("z"))
    near = at.select(F.col("channel").alias("neighbor"), F.col("x").alias("xn"), F.col("z").alias("zn"))
    placed = index.join(at, "channel").join(near, "neighbor").select("channel", "neighbor", (F.col("xn") - F.col("x")).alias("dx"), (F.col("zn") - F.col("z")).alias("dz"))
    offsets = placed.select("dx", "dz").distinct().withColumn("slot", (F.row_number().over(Window.orderBy("dz", "dx")) - 1).cast("int"))
    grid = (channels if of is None else of).select("channel").join(F.broadcast(offsets))
    return grid.join(placed, ["channel", "dx", "dz"], "left").select("channel", "slot", "neighbor")


def own_slots(index: DataFrame) -> DataFrame:
    """(channel, slot): where a channel stands among its own neighbours."""
    return index.where(F.col("channel") == F.col("neighbor")).select("channel", "slot")


def own_slots_of(channels: DataFrame, radius: float) -> DataFrame:
    """own_slots of the index of all channels within radius, which is not made: a channel's slot is the number of lesser ones there."""
    lists = lists_by_place(channels, radius, lambda own, near, d: (np.searchsorted(near[0], own[0]),), "_slots array<int>")
    return lists.select(F.explode(F.arrays_zip("copies", "_slots")).alias("_s")).select(F.col("_s.copies").alias("channel"), F.col("_s._slots").alias("slot"))


def slot_map_of(channels: DataFrame, old: float, new: float) -> DataFrame:
    """slot_map from the index of all channels within the radius `old` to that of those within the lesser one `new`; no pairs are joined."""
    lists = lists_by_place(channels, old, lambda own, near, d: (np.flatnonzero(d <= new),), "_old array<int>")
    return lists.select(F.explode("copies").alias("channel"), "_old").select("channel", F.posexplode("_old").alias("slot", "old_slot"))


def kept_slots_of(channels: DataFrame, old: float, new: float) -> DataFrame:
    """kept_slots of the index of all channels within the radius `old` and that within `new`; no pairs are joined."""
    lists = lists_by_place(channels, old, lambda own, near, d: (d <= new,), "_kept array<boolean>")
    return lists.select(F.explode("copies").alias("channel"), "_kept").select("channel", F.posexplode("_kept").alias("slot", "kept"))


def regular_index_of(channels: DataFrame, radius: float, step: float) -> DataFrame:
    """regular_index of the index of all channels within radius; no pairs are joined. The relative positions, as many as lie within the radius, come to the driver."""
    at = channels.select("*", F.round(F.col("x") / step).cast("long").alias("gx"), F.round(F.col("z") / step).cast("long").alias("gz"))
    more = ["gx", "gz"]

    def positions(own: list, near: list, d: np.ndarray) -> tuple:
        return tuple(np.unique(np.stack([near[2] - own[2], near[1] - own[1]], 1), axis=0).T.astype(np.int64)) if len(d) else ([], [])

    met = lists_by_place(at, radius, positions, "dz array<bigint>, dx array<bigint>", more=more)
    offsets = met.select(F.explode(F.arrays_zip("dz", "dx")).alias("o")).select("o.*").distinct().orderBy("dz", "dx").toPandas().to_numpy(np.int64)
    if not len(offsets):
        return channels.select("channel", F.lit(None).cast("int").alias("slot"), F.col("channel").alias("neighbor")).limit(0)
    low, wide = offsets.min(0), int(np.ptp(offsets[:, 1])) + 1
    known = (offsets[:, 0] - low[0]) * wide + offsets[:, 1] - low[1]

    def slots(own: list, near: list, d: np.ndarray) -> tuple:
        slot = np.searchsorted(known, (near[2] - own[2] - low[0]) * wide + near[1] - own[1] - low[1])
        empty = np.setdiff1d(np.arange(len(known)), slot)
        order = np.argsort(slot, kind="stable")
        return slot[order].astype(np.int32), near[0][order], empty.astype(np.int32)

    kind = channels.schema["channel"].dataType.simpleString()
    lists = lists_by_place(at, radius, slots, f"slots array<int>, near array<{kind}>, empty array<int>", more=more).select(F.explode("copies").alias("channel"), "slots", "near", "empty")
    met = lists.select("channel", F.explode(F.arrays_zip("slots", "near")).alias("s")).select("channel", F.col("s.slots").alias("slot"), F.col("s.near").alias("neighbor"))
    none = lists.select("channel", F.explode("empty").alias("slot")).withColumn("neighbor", F.lit(None).cast(kind))
    lost = channels.where("x is null or z is null").select("channel", F.explode(F.sequence(F.lit(0), F.lit(len(known) - 1))).alias("slot")).withColumn("neighbor", F.lit(None).cast(kind))
    return met.unionByName(none).unionByName(lost)


def within_radius(index: DataFrame, channels: DataFrame, radius: float | None = None, nearest: int | None = None) -> DataFrame:
    """The neighbours not beyond the radius, or the nearest so many (equal distances by number), under new slots."""
    pos = lambda c, s: channels.select(F.col("channel").alias(c), F.col("x").alias(f"x{s}"), F.col("z").alias(f"z{s}"))
    d = F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("za") - F.col("zb")) ** 2)
    far = index.join(pos("channel", "a"), "channel").join(pos("neighbor", "b"), "neighbor").withColumn("d", d)
    if radius is not None:
        far = far.where(F.col("d") <= radius)
    if nearest is not None:
        far = far.withColumn("_r", F.row_number().over(Window.partitionBy("channel").orderBy("d", "neighbor"))).where(F.col("_r") <= nearest)
    return _slots(far)


def slot_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """(channel, slot, old_slot): where each slot of the new index stands in the old one, null where it doesn't."""
    return new.join(old.withColumnRenamed("slot", "old_slot"), ["channel", "neighbor"], "left").select("channel", "slot", "old_slot")


def kept_slots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(channel, slot, kept): which slots of the old index the new one has too."""
    return old.join(new.select("channel", "neighbor", F.lit(True).alias("kept")), ["channel", "neighbor"], "left").select("channel", "slot", F.coalesce("kept", F.lit(False)).alias("kept"))


def reslotted(snippets: DataFrame, slots: DataFrame, fill: float | None = None) -> DataFrame:
    """Snippets (spike_id, channel, slot, v) laid out by a map of slots: a row for each slot of the new index, `fill` or null in those the old one lacks."""
    heads = snippets.select("spike_id", "channel").distinct()
    want = heads.join(F.broadcast(slots), "channel")
    got = want.join(snippets.withColumnRenamed("slot", "old_slot"), ["spike_id", "channel", "old_slot"], "left")
    return got.select("spike_id", "channel", "slot", F.coalesce("v", F.lit(fill)).alias("v") if fill is not None else "v")


def in_probe(snippets: DataFrame, index: DataFrame) -> DataFrame:
    """Rows whose slot is a channel of the probe, with that channel; null neighbours are padding."""
    return snippets.join(F.broadcast(index), ["channel", "slot"]).where(F.col("neighbor").isNotNull())


def filled_in(full: DataFrame, part: DataFrame) -> DataFrame:
    """The inverse of in_probe: rows of full with v from part where part has them."""
    return full.withColumnRenamed("v", "_old").join(part.select("spike_id", "slot", "v"), ["spike_id", "slot"], "left").withColumn("v", F.coalesce("v", "_old")).drop("_old")


def main_rows(snippets: DataFrame, index: DataFrame) -> DataFrame:
    """Each spike's row on its own channel."""
    return snippets.join(F.broadcast(own_slots(index)), ["channel", "slot"])


def shifted_channels(rows: DataFrame, channels: DataFrame, registered: DataFrame, pitch: float, digits: int = 3) -> DataFrame:
    """reg_channel: where a row's channel lands on the registered probe (reg_channel, x, z) when moved by `shift` whole pitches; null where it has no site. An equi-join on rounded places."""
    moved = rows.join(F.broadcast(channels.select("channel", F.col("x").alias("_x"), F.col("z").alias("_z"))), "channel")
    moved = moved.withColumn("_x", F.round("_x", digits)).withColumn("_z", F.round(F.col("_z") + F.col("shift") * pitch, digits))
    sites = registered.select("reg_channel", F.round("x", digits).alias("_x"), F.round("z", digits).alias("_z"))
    return moved.join(F.broadcast(sites), ["_x", "_z"], "left").drop("_x", "_z")


def on_static_channels(snippets: DataFrame, index: DataFrame, shifts: DataFrame, channels: DataFrame, registered: DataFrame, pitch: float) -> DataFrame:
    """(spike_id, reg_channel, v): snippets of spikes with shifts (spike_id, shift) on the registered probe's channels. There are few distinct neighbours and shifts, so places are looked up for these."""
    rows = in_probe(snippets, index).join(shifts.select("spike_id", "shift"), "spike_id")
    known = shifted_channels(index.where("neighbor is not null").select(F.col("neighbor").alias("channel")).distinct().join(shifts.select("shift").distinct()), channels, registered, pitch)
    return rows.join(F.broadcast(known.withColumnRenamed("channel", "neighbor")), ["neighbor", "shift"]).where("reg_channel is not null").select("spike_id", "reg_channel", "v")


def shift_index(pairs: DataFrame, template: str = "template", shift: str = "shift") -> DataFrame:
    """(template, shift, shifted_id): the distinct pairs, numbered by template and shift; a table of templates, so one window does."""
    return pairs.select(template, shift).distinct().withColumn("shifted_id", (F.row_number().over(Window.orderBy(template, shift)) - 1).cast("long"))


def static_shift_index(templates: DataFrame, template: str = "template") -> DataFrame:
    return shift_index(templates.select(template).withColumn("shift", F.lit(0)), template)


def shifted_ids(rows: DataFrame, index: DataFrame, template: str = "template", shift: str = "shift") -> DataFrame:
    return rows.join(F.broadcast(index), [template, shift], "left")


def distinct_rows(rows: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The distinct values with the first key that has each and their number, and the number of each row (key, id)."""
    first = rows.groupBy(*columns).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    numbered = first.withColumn("id", (F.row_number().over(Window.orderBy(*columns)) - 1).cast("long"))
    return numbered, rows.select(key, *columns).join(F.broadcast(numbered.select(*columns, "id")), columns).select(key, "id")


def co_occurring(shifts_a: DataFrame, shifts_b: DataFrame, time: str = "time") -> DataFrame:
    """Distinct (unit_a, shift_a, unit_b, shift_b) that are in force at one time; (time, unit, shift) are small tables over chunks."""
    a = shifts_a.select(time, F.col("unit").alias("unit_a"), F.col("shift").alias("shift_a"))
    b = shifts_b.select(time, F.col("unit").alias("unit_b"), F.col("shift").alias("shift_b"))
    return a.join(b, time).select("unit_a", "shift_a", "unit_b", "shift_b").distinct()


def neighbourhoods(rows: DataFrame, key: str = "spike_id", channel: str = "channel") -> tuple[DataFrame, DataFrame]:
    """(neighborhood, channels, n) for the distinct sets of channels that spikes are seen on, numbered in their order, and (key, neighborhood)."""
    sets = rows.groupBy(key).agg(F.sort_array(F.collect_set(channel)).alias("channels"))
    known = sets.groupBy("channels").agg(F.count(F.lit(1)).alias("n")).withColumn("neighborhood", (F.row_number().over(Window.orderBy("channels")) - 1).cast("long"))
    return known, sets.join(known.select("channels", "neighborhood"), "channels").select(key, "neighborhood")


def overlaps(known: DataFrame) -> DataFrame:
    """(i, j, both, overlap, subset): channels that two neighbourhoods share, their share of the smaller one, and whether i is a part of j. Pairs without a common channel are left out."""
    long = known.select("neighborhood", F.size("channels").alias("size"), F.explode("channels").alias("channel"))
    other = long.select(F.col("neighborhood").alias("j"), F.col("size").alias("size_j"), "channel")
    both = long.withColumnRenamed("neighborhood", "i").join(other, "channel").groupBy("i", "j", "size", "size_j").agg(F.count(F.lit(1)).alias("common"))
    return both.select("i", "j", "common", (F.col("common") / F.least("size", "size_j")).alias("overlap"), (F.col("common") == F.col("size")).alias("subset"))


def adjacency(known: DataFrame, least: float = 0.5) -> DataFrame:
    return overlaps(known).where(F.col("overlap") >= least).select("i", "j")


def orders(channels: DataFrame) -> DataFrame:
    """(axis, sign): -1 if along an axis places only fall with the channel's number on every line of the other axis, else 1."""
    out = None
    for axis, other in (("x", "z"), ("z", "x")):
        w = Window.partitionBy(other).orderBy("channel")
        signs = channels.select(F.signum(F.col(axis) - F.lag(axis).over(w)).alias("s")).where("s is not null")
        one = signs.agg(F.lit(axis).alias("axis"), F.when((F.min("s") == -1) & (F.max("s") == -1), -1).otherwise(1).alias("sign"))
        out = one if out is None else out.unionByName(one)
    return out
