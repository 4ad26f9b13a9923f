"""Queries on sortings as tables, channels and their neighbourhoods, candidate sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, channels, compare, density, distances, joins, merging, sortings, trains
from ..sources.tables import event_spikes, table
from . import unit_queries as units
from .base import r6, registry
from .density_queries import channels as suppliers
from .score_queries import CH, by_place, neighbourhoods
from .spike_queries import SECOND, S

QUERIES, ORACLE, query = registry()

#: Spikes of a value below 20 belong to no unit.
V = S + ", v AS (SELECT spike_id, t, amplitude, CASE WHEN amplitude < 20 THEN -1 ELSE label END AS label FROM s)"


def partly(spark: SparkSession, d: str) -> DataFrame:
    return event_spikes(spark, d).withColumn("label", F.when(F.col("amplitude") < 20, F.lit(-1)).otherwise(F.col("label")).cast("long"))


@query(f"WITH {V} SELECT spike_id, label FROM v WHERE label >= 0")
def spikes_of_units(spark, d):
    return sortings.drop_missing(partly(spark, d)).select("spike_id", "label")


@query(f"WITH {V} SELECT count(DISTINCT label) AS n_units, count(*) AS n_spikes FROM v WHERE label >= 0")
def unit_totals(spark, d):
    return sortings.n_units(partly(spark, d))


@query(f"WITH {V} SELECT DISTINCT label FROM v WHERE label >= 0")
def unit_names(spark, d):
    return sortings.unit_ids(partly(spark, d))


@query(f"WITH {V} SELECT label, spike_id // 512 AS part, count(*) AS n, min(spike_id) AS first, max(spike_id) AS last FROM v WHERE label >= 0 GROUP BY 1, 2")
def inverted_index(spark, d):
    ids = sortings.inverted(partly(spark, d), 512)
    return ids.select("label", "part", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"), F.element_at("ids", -1).alias("last"))


@query(f"WITH {V}, k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS flat FROM (SELECT DISTINCT label FROM v WHERE label >= 0 AND label % 3 = 0)) SELECT spike_id, CAST(coalesce(flat, -1) AS BIGINT) AS flat FROM v LEFT JOIN k USING (label)")
def kept_units(spark, d):
    s = partly(spark, d)
    return sortings.keep_units(s, s.where("label % 3 = 0").select("label")).select("spike_id", F.col("flat").cast("long").alias("flat"))


@query(f"""WITH {S}, e AS (SELECT min(t) AS lo, max(t) AS hi FROM s), p AS (SELECT CAST(n_nationkey AS BIGINT) AS part, lo + n_nationkey * ((hi - lo) // 25) AS start, lo + (n_nationkey + 2) * ((hi - lo) // 25) AS stop FROM nation, e)
SELECT spike_id, part FROM s JOIN p ON t >= start AND t < stop""")
def spikes_by_ranges(spark, d):
    s = event_spikes(spark, d)
    ends = s.agg(F.min("t").alias("lo"), F.floor((F.max("t") - F.min("t")) / 25).alias("step"))
    parts = table(spark, d, "nation").join(F.broadcast(ends)).select(F.col("n_nationkey").cast("long").alias("part"), (F.col("lo") + F.col("n_nationkey") * F.col("step")).alias("start"), (F.col("lo") + (F.col("n_nationkey") + 2) * F.col("step")).alias("stop"))
    return sortings.time_parts(s, parts).select("spike_id", "part")


@query(f"WITH {S}, r AS (SELECT label, min(amplitude) AS lo, max(amplitude) AS hi FROM s GROUP BY label) SELECT spike_id, CASE WHEN hi > lo THEN round((amplitude - lo) / (hi - lo), 6) END AS share FROM s JOIN r USING (label)")
def rescaled_amplitudes(spark, d):
    return sortings.rescaled(event_spikes(spark, d), "amplitude", "share", ["label"]).select("spike_id", r6("share").alias("share"))


@query(f"WITH {S} SELECT label, round(1000 - sum(amplitude) FILTER (channel = 'click'), 4) AS v FROM s GROUP BY label HAVING count(*) FILTER (channel = 'click') > 0 UNION ALL SELECT label, 1000.0 FROM s GROUP BY label HAVING count(*) FILTER (channel = 'click') = 0")
def scattered_sums(spark, d):
    s = event_spikes(spark, d)
    dest = s.select("label").distinct().withColumn("v", F.lit(1000.0))
    got = sortings.scattered(dest, s.where("channel = 'click'").select("label", F.col("amplitude").alias("v")), ["label"], sign=-1)
    return got.select("label", F.round("v", 4).alias("v"))


@query(f"""WITH {S}, g AS (SELECT label, t - lag(t) OVER (PARTITION BY label ORDER BY t, spike_id) AS gap FROM s), v AS (SELECT label, coalesce(avg(CASE WHEN gap < 1000000 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0.0) AS viol_rate FROM g GROUP BY label)
SELECT label, count(*) AS n, round(any_value(viol_rate), 6) AS viol_rate, round(avg(amplitude), 9) AS amplitude, CASE WHEN max(t) > min(t) THEN round(count(*) / ((max(t) - min(t)) / 1e6), 6) END AS rate_hz FROM s JOIN v USING (label) GROUP BY label""")
def unit_summary(spark, d):
    s = event_spikes(spark, d)
    means = s.groupBy("label").agg(F.avg("amplitude").alias("amplitude"))
    got = sortings.summary(trains.unit_firing_rates(s), trains.violations(s, SECOND), means)
    return got.select("label", "n", r6("viol_rate").alias("viol_rate"), F.round("amplitude", 9).alias("amplitude"), r6("rate_hz").alias("rate_hz"))


@query("SELECT n_nationkey AS candidate, min(n_regionkey) AS label FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def candidate_parents(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return sortings.candidate_labels(rows.select(F.col("n_regionkey").alias("label"), F.col("n_nationkey").alias("candidate")))


@query(f"""WITH {S}, a AS (SELECT label % 10 AS i, t FROM s WHERE channel = 'click'), b AS (SELECT label % 10 AS j, t FROM s WHERE channel = 'purchase')
SELECT i, j, CAST(floor((b.t - a.t) / 60000000 + 0.5) AS BIGINT) AS lag, count(*) AS n FROM a JOIN b ON abs(b.t - a.t) <= 700000000 WHERE abs(floor((b.t - a.t) / 60000000 + 0.5)) <= 10 GROUP BY 1, 2, 3""")
def cross_correlogram(spark, d):
    s = event_spikes(spark, d).withColumn("label", F.col("label") % 10)
    return sortings.cross_correlogram(s.where("channel = 'click'"), s.where("channel = 'purchase'"), 60 * SECOND, 10)


@query("""WITH n AS (SELECT l_suppkey AS unit, l_linenumber AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2)
SELECT unit, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM n GROUP BY unit""")
def partner_entropy(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label_a"), F.col("l_linenumber").alias("label_b"))
    return sortings.friends(rows).select("unit", r6("entropy").alias("entropy"))


@query(f"""WITH {S}, u AS (SELECT label AS unit, count(*) AS n FROM s GROUP BY label), f AS (SELECT label AS unit, CAST(floor(amplitude - 5) AS BIGINT) AS k, count(*) AS c FROM s WHERE channel = 'click' AND amplitude >= 5 GROUP BY 1, 2),
a AS (SELECT unit, k, sum(c) OVER (PARTITION BY unit ORDER BY k DESC) AS above FROM f), m AS (SELECT unit, max(k) + 1 AS k FROM a JOIN u USING (unit) WHERE above * 2.0 >= n * 0.5 GROUP BY unit)
SELECT unit, coalesce(k, 0) * 1.0 + 5.0 AS threshold FROM u LEFT JOIN m USING (unit)""")
def controlled_thresholds(spark, d):
    s = event_spikes(spark, d)
    counts = s.groupBy(F.col("label").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return sortings.false_positive_threshold(s.where("channel = 'click'").select(F.col("label").alias("unit"), F.col("amplitude").alias("score")), 1.0, counts, 2.0, 0.5)


@query(f"WITH c AS ({units.ORACLE['coentropy']}), p AS ({units.ORACLE['pair_iou_cov']}) SELECT i, j, (cov >= 0.2 OR iou >= 0.1) AND coentropy >= 0.01 AS may_merge FROM c JOIN p USING (i, j)")
def coentropy_mask(spark, d):
    pairs = units.QUERIES["coentropy"](spark, d).join(units.QUERIES["pair_iou_cov"](spark, d), ["i", "j"])
    return sortings.merge_mask(pairs, 0.01, 0.2, 0.1).select("i", "j", "may_merge")


# channels

#: Neighbours of a channel within 10, numbered in their order.
N = CH + ", nb AS (SELECT a.channel, b.channel AS neighbor, sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) AS d, row_number() OVER (PARTITION BY a.channel ORDER BY b.channel) - 1 AS slot FROM ch a JOIN ch b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) <= 10)"
#: Those within 5 of them, and the three nearest.
N5 = N + ", n5 AS (SELECT channel, neighbor, row_number() OVER (PARTITION BY channel ORDER BY neighbor) - 1 AS slot FROM nb WHERE d <= 5)"


@query(f"WITH {CH} SELECT a.channel, CAST(row_number() OVER (PARTITION BY a.channel ORDER BY b.channel) - 1 AS INT) AS slot, b.channel AS neighbor FROM ch a JOIN ch b ON b.channel BETWEEN a.channel - 3 AND a.channel + 2")
def contiguous_channels(spark, d):
    return channels.contiguous_index(neighbourhoods(spark, d)[0], 6)


@query(f"WITH {N} SELECT channel, CAST(slot AS BIGINT) AS slot FROM nb WHERE channel = neighbor")
def own_slots(spark, d):
    return channels.own_slots_of(suppliers(spark, d), 10.0).select("channel", F.col("slot").cast("long").alias("slot"))


@query(f"WITH {N5} SELECT channel, CAST(slot AS INT) AS slot, neighbor FROM n5")
def channels_within(spark, d):
    ch, near, members = by_place(spark, d)
    return joins.for_copies(channels.within_radius(near, ch, 5.0), members)


@query(f"WITH {N}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY d, neighbor) AS k FROM nb) SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY neighbor) - 1 AS INT) AS slot, neighbor FROM r WHERE k <= 3")
def nearest_channels(spark, d):
    ch, near, members = by_place(spark, d)
    return joins.for_copies(channels.within_radius(near, ch, nearest=3), members)


@query(f"WITH {N5} SELECT n5.channel, CAST(n5.slot AS BIGINT) AS slot, CAST(nb.slot AS BIGINT) AS old_slot FROM n5 LEFT JOIN nb ON nb.channel = n5.channel AND nb.neighbor = n5.neighbor")
def slot_map(spark, d):
    return channels.slot_map_of(suppliers(spark, d), 10.0, 5.0).select("channel", F.col("slot").cast("long").alias("slot"), F.col("old_slot").cast("long").alias("old_slot"))


@query(f"WITH {N5} SELECT nb.channel, CAST(nb.slot AS BIGINT) AS slot, n5.neighbor IS NOT NULL AS kept FROM nb LEFT JOIN n5 ON nb.channel = n5.channel AND nb.neighbor = n5.neighbor")
def kept_slots(spark, d):
    return channels.kept_slots_of(suppliers(spark, d), 10.0, 5.0).select("channel", F.col("slot").cast("long").alias("slot"), "kept")


@query(f"""WITH {N}, g AS (SELECT channel, CAST(round(x / 5) AS BIGINT) AS gx, CAST(round(z / 5) AS BIGINT) AS gz FROM ch), p AS (SELECT nb.channel, nb.neighbor, b.gx - a.gx AS dx, b.gz - a.gz AS dz FROM nb JOIN g a ON a.channel = nb.channel JOIN g b ON b.channel = nb.neighbor),
o AS (SELECT dx, dz, row_number() OVER (ORDER BY dz, dx) - 1 AS slot FROM (SELECT DISTINCT dx, dz FROM p))
SELECT g.channel, CAST(slot AS INT) AS slot, p.neighbor FROM g CROSS JOIN o LEFT JOIN p ON p.channel = g.channel AND p.dx = o.dx AND p.dz = o.dz""")
def regular_slots(spark, d):
    return channels.regular_index_of(suppliers(spark, d), 10.0, 5.0)


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS template, l_linenumber AS shift FROM lineitem) SELECT template, shift, row_number() OVER (ORDER BY template, shift) - 1 AS shifted_id FROM p""")
def shifted_templates(spark, d):
    return channels.shift_index(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("template"), F.col("l_linenumber").alias("shift")))


@query("""WITH k AS (SELECT l_returnflag, l_linestatus, min(l_orderkey) AS first, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY l_returnflag, l_linestatus) - 1 AS id FROM k""")
def distinct_with_first(spark, d):
    return channels.distinct_rows(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")[0]


#: Sets of line numbers of an order, as the channels a spike is seen on.
B = "b AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT CAST(l_linenumber AS INT))) AS c FROM lineitem GROUP BY 1), h AS (SELECT c, count(*) AS n, row_number() OVER (ORDER BY c) - 1 AS neighborhood FROM b GROUP BY c), x AS (SELECT neighborhood, len(c) AS size, unnest(c) AS channel FROM h), o AS (SELECT a.neighborhood AS i, b.neighborhood AS j, a.size, b.size AS size_j, count(*) AS common FROM x a JOIN x b USING (channel) GROUP BY 1, 2, 3, 4)"


def sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return channels.neighbourhoods(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("channel")), "l_orderkey")


@query(f"WITH {B} SELECT neighborhood, n, len(c) AS size, array_to_string(c, ' ') AS channels FROM h")
def channel_sets(spark, d):
    return sets(spark, d)[0].select("neighborhood", "n", F.size("channels").cast("long").alias("size"), F.array_join(F.col("channels").cast("array<string>"), " ").alias("channels"))


@query(f"WITH {B} SELECT i, j, common, round(common / least(size, size_j), 6) AS overlap, common = size AS subset FROM o")
def channel_set_overlaps(spark, d):
    return channels.overlaps(sets(spark, d)[0]).select("i", "j", "common", r6("overlap").alias("overlap"), "subset")


#: Units (priorities of orders) allowed in neighbourhoods that share half of the smaller one's channels.
A = B + ", r AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS unit, h.neighborhood FROM b JOIN h USING (c) JOIN orders ON o_orderkey = k), al AS (SELECT DISTINCT r.unit, o.j AS neighborhood FROM r JOIN o ON o.i = r.neighborhood WHERE common >= 0.9 * least(size, size_j) AND size >= size_j)"


def allowed(spark: SparkSession, d: str) -> DataFrame:
    known, rows = sets(spark, d)
    custom = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).cast("long").alias("label"))
    size = known.select("neighborhood", F.size("channels").alias("s"))
    near = channels.overlaps(known).where("overlap >= 0.9").join(size.withColumnsRenamed({"neighborhood": "i", "s": "si"}), "i").join(size.withColumnsRenamed({"neighborhood": "j", "s": "sj"}), "j").where("si >= sj").select("i", "j")
    return candidates.seen_together(rows.join(custom, "l_orderkey"), near)


@query(f"WITH {A} SELECT unit, neighborhood FROM al")
def allowed_units(spark, d):
    return allowed(spark, d)


@query(f"WITH {A} SELECT neighborhood, count(*) AS n, min(unit) AS first, max(unit) AS last FROM al GROUP BY 1")
def units_by_set(spark, d):
    return candidates.by_neighborhood(allowed(spark, d)).select("neighborhood", "n", F.col("units")[0].alias("first"), F.element_at("units", -1).alias("last"))


@query(f"""WITH {A}, sh AS (SELECT DISTINCT a.unit AS i, b.unit AS j FROM al a JOIN al b USING (neighborhood)), q AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY CASE WHEN i = j THEN -1.0 ELSE abs(i * 7 % 50 - j * 7 % 50) END, j) - 1 AS rank FROM sh)
SELECT i, j, rank FROM q WHERE rank < 6""")
def search_sets(spark, d):
    own = allowed(spark, d)
    u = own.select(F.col("unit").alias("i")).distinct()
    dist = u.join(u.withColumnRenamed("i", "j")).withColumn("d", F.abs(F.col("i") * 7 % 50 - F.col("j") * 7 % 50).cast("double"))
    return candidates.search_sets(dist, own, 6).select("i", "j", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CH}, pr AS (SELECT a.channel AS i, b.channel AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) AS d, a.z AS di, b.z AS dj FROM ch a JOIN ch b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) <= 10), h AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM pr WHERE dj > di) SELECT channel AS i, coalesce(j, channel) AS above FROM ch LEFT JOIN h ON h.i = channel AND k = 1")
def nearest_above(spark, d):
    """The nearest follow from the place, and of a place's copies the least id stands for all."""
    ch = by_place(spark, d)[0]
    spots = joins.places(ch, ["x", "z"], "channel")
    pairs = joins.near_places(spots, ["x", "z"], 10.0).select(F.col("a").alias("i"), F.col("b").alias("j"), "d")
    above = candidates.nearest_above(pairs, spots.select(F.col("_place").alias("key"), F.col("z").alias("density"))).where("above <> i")
    known = spots.join(above, F.col("_place") == F.col("i")).select("x", "z", "above")
    return ch.join(known, ["x", "z"], "left").select(F.col("channel").alias("i"), F.coalesce("above", "channel").alias("above"))


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, (p_retailprice - 900) / 4 AS z FROM part), d AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) AS d, b.id AS o FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 4 AND abs(a.z - b.z) <= 4),
r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d, o) AS k FROM d WHERE d <= 4), g AS (SELECT id, (count(*) + 1) / nullif(max(d) * max(d), 0) AS density FROM r WHERE k < 6 GROUP BY id) SELECT id, round(coalesce(density, 0.0), 4) AS density FROM p LEFT JOIN g USING (id)""")
def nearest_density(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), ((F.col("p_retailprice") - 900) / 4).alias("z"))
    return density.nearest_density(p, ["x", "z"], "id", 6, 4.0).select("id", F.round("density", 4).alias("density"))


_K = ", ".join(f"({i}, exp(-{i * i} / 8.0))" for i in range(-6, 7))


@query(f"""WITH k0(i, w) AS (VALUES {_K}), k AS (SELECT i, w / (SELECT sum(w) FROM k0) AS w FROM k0), h AS (SELECT CAST(floor(p_size / 1.0) AS BIGINT) AS x, CAST(floor((p_retailprice - 900) / 4) AS BIGINT) AS z, count(*) AS n FROM part GROUP BY 1, 2),
a AS (SELECT x + i AS x, z, sum(n * w) AS n FROM h, k GROUP BY 1, 2), b AS (SELECT x, z + i AS z, sum(n * w) AS n FROM a, k GROUP BY 1, 2) SELECT x, z, round(n, 6) AS density FROM b""")
def binned_density(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), ((F.col("p_retailprice") - 900) / 4).alias("z"))
    return density.binned_density(p, ["x", "z"], 1.0, 2.0).select("x", "z", r6("density").alias("density"))


@query(f"""WITH {units.L}, tops AS (SELECT t.vec_id, e.label AS truth, t.unit AS tested, t.r > 0.5 AS matched FROM t JOIN embeddings e USING (vec_id) WHERE t.rank = 1),
c AS (SELECT truth, tested, count(*) AS n FROM tops GROUP BY 1, 2),
iou AS (SELECT truth, tested, n / (sum(n) OVER (PARTITION BY truth) + sum(n) OVER (PARTITION BY tested) - n) AS iou FROM c),
best AS (SELECT truth, tested AS match FROM iou QUALIFY row_number() OVER (PARTITION BY truth ORDER BY iou DESC, tested) = 1),
fp AS (SELECT tested AS match, count(*) AS n_false FROM tops WHERE NOT matched GROUP BY 1),
sp AS (SELECT vec_id, any_value(truth) AS truth, any_value(match) AS match, bool_or(matched) AS matched,
  coalesce(sum(t.r) FILTER (t.unit = match), 0) AS p, coalesce(sum(t.r * t.r) FILTER (t.unit <> match), 0) AS q FROM t JOIN tops USING (vec_id) JOIN best USING (truth) GROUP BY vec_id),
u AS (SELECT truth AS unit, any_value(match) AS match, count(*) AS m, sum(CASE WHEN matched THEN 0 ELSE 2 END) AS h, sum(CASE WHEN matched THEN (1 - p) * (1 - p) + q ELSE 2 END) AS s, sum(CASE WHEN matched THEN p ELSE 0 END) AS o FROM sp GROUP BY 1)
SELECT unit, match, m + coalesce(n_false, 0) AS n, coalesce(n_false, 0) AS n_false, round((h + 2 * coalesce(n_false, 0)) / (m + coalesce(n_false, 0)), 5) AS hard,
  round((s + 2 * coalesce(n_false, 0)) / (m + coalesce(n_false, 0)), 5) AS soft, round(o / m, 5) AS own FROM u LEFT JOIN fp USING (match)""")
def unit_brier(spark, d):
    """Scores of true labels; what the model is not sure of counts as missed, and as a false spike of the unit it names."""
    soft = units.assigned(spark, d).groupBy("vec_id").agg(F.collect_list(F.struct("unit", "ll", "r")).alias("cand"), F.min(F.struct("rank", "unit", "r")).alias("top"))
    rows = soft.join(table(spark, d, "embeddings").select("vec_id", F.col("label").alias("truth")), "vec_id")
    rows = rows.select("truth", "cand", F.col("top.unit").alias("tested"), (F.col("top.r") > 0.5).alias("matched"), F.lit(0.0).alias("noise_r"))
    best = compare.best_matches(compare.agreement(rows, "truth", "tested"), "truth", "tested").select(F.col("truth").alias("unit"), F.col("tested").alias("match"))
    got = sortings.unit_brier(rows, best, rows.where(~F.col("matched")).select(F.col("tested").alias("unit")))
    return got.select("unit", "match", "n", "n_false", *(F.round(c, 5).alias(c) for c in ("hard", "soft", "own")))


@query(f"""WITH {units.M}, {units.P}, d AS (SELECT i, j, round(sqrt(d2) / sqrt(sqrt(aa) * sqrt(bb)), 6) AS d FROM p),
b AS (SELECT i, j, d FROM d UNION ALL SELECT j, i, d FROM d) SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM b QUALIFY rank <= 5""")
def nearest_templates(spark, d):
    pairs = distances.pairs(units.units(spark, d)).select("i", "j", r6(distances.normeuc()).alias("d"))
    return merging.nearest_templates(pairs).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {units.L}, two AS (SELECT vec_id, arg_min(unit, rank) AS unit, max(ll) - min(ll) AS g FROM k WHERE rank <= 2 GROUP BY vec_id),
b AS (SELECT unit, least(floor(g / 0.5), 100) AS b, count(*) AS c FROM two GROUP BY 1, 2),
s AS (SELECT unit, CASE WHEN b + o < 0 THEN -(b + o) - 1 ELSE b + o END AS b, sum(c * w) AS h FROM b, (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) x(o, w) GROUP BY 1, 2),
n AS (SELECT unit, CAST(sum(c) AS BIGINT) AS n FROM b GROUP BY 1)
SELECT unit, n, round(coalesce(max(h) FILTER (b = 0), 0) / max(h), 6) AS score FROM s JOIN n USING (unit) WHERE n >= 5 GROUP BY unit, n""")
def unit_isolation(spark, d):
    return merging.isolation(units.likelihoods(spark, d), "vec_id").select("unit", "n", r6("score").alias("score"))
