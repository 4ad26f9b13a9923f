"""Queries on soft assignments, merging, localisation and refinement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare, distances, joins, labels, locate, refine, soft
from ..sources.tables import event_spikes, table
from .unit_queries import L, assigned, emb, r6, units

QUERIES: dict = {}
ORACLE: dict = {}

S = "s AS (SELECT event_id AS spike_id, epoch_us(ts) // 3600 AS t, user_id AS label, event_type AS channel, value AS amplitude FROM events)"
CH = "ch AS (SELECT CAST(s_suppkey AS INT) AS channel, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal / 100 AS z FROM supplier)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r5(c: str):
    return F.round(c, 5).alias(c)


@query(f"WITH {L} SELECT vec_id, unit, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, unit) AS rank, round(exp(ll - top) / sum(exp(ll - top)) OVER (PARTITION BY vec_id), 5) AS r FROM t WHERE unit NOT IN (0, 3)")
def remove_units(spark, d):
    gone = spark.range(1).select(F.explode(F.array(F.lit(0), F.lit(3))).alias("unit"))
    return soft.remove_units(assigned(spark, d), gone, "vec_id").select("vec_id", "unit", F.col("rank").cast("long").alias("rank"), r5("r"))


@query(f"WITH {L}, a AS (SELECT vec_id, unit, ll - unit * 0.05 AS ll FROM t), am AS (SELECT *, max(ll) OVER (PARTITION BY vec_id) AS mx FROM a) SELECT vec_id, unit, round(exp(ll - mx) / sum(exp(ll - mx)) OVER (PARTITION BY vec_id), 5) AS r FROM am")
def proportion_adjust(spark, d):
    change = units(spark, d).select(F.col("label").alias("unit"), (F.col("label") * -0.05).alias("change"))
    return soft.adjust_proportions(assigned(spark, d), change, "vec_id").select("vec_id", "unit", r5("r"))


@query(f"WITH {L} SELECT vec_id, CASE WHEN max(-4.0) > max(ll) THEN -1 ELSE arg_min(unit, rank) END AS label FROM t GROUP BY vec_id")
def labels_from_scores(spark, d):
    return soft.top_labels(assigned(spark, d).withColumn("noise", F.lit(-4.0)), "vec_id", noise="noise").select("vec_id", "label")


@query(f"WITH {L} SELECT unit, round(sum(r) / (SELECT count(DISTINCT vec_id) FROM t), 5) AS mean FROM t GROUP BY unit")
def mean_responsibility(spark, d):
    return soft.mean_responsibility(assigned(spark, d), "vec_id").select("unit", r5("mean"))


@query(f"""WITH {L}, c AS (SELECT vec_id, any_value(top) + ln(sum(exp(ll - top))) AS lse, sum(CASE WHEN r > 0 THEN -r * ln(r) ELSE 0 END) AS h, sum(CASE WHEN r > 0 THEN r * (ll - ln(r)) ELSE 0 END) AS b FROM t GROUP BY vec_id)
SELECT round(avg(lse) - avg(h), 5) AS ecl, round(avg(b), 5) AS elbo FROM c""")
def soft_criterion(spark, d):
    return soft.criterion(assigned(spark, d), "vec_id").select(r5("ecl"), r5("elbo"))


@query(f"""WITH {L}, b AS (SELECT a.unit AS i, c.unit AS j, CAST(greatest(least(round_even((a.ll - c.ll) / 0.5, 0), 50), -50) AS INT) AS b FROM t a JOIN t c ON a.vec_id = c.vec_id AND a.unit < c.unit),
n AS (SELECT i, j, count(*) AS n FROM b GROUP BY 1, 2), h AS (SELECT i, j, b + k AS b, sum(CASE WHEN k = 0 THEN 0.5 ELSE 0.25 END) AS h FROM b, (VALUES (-1), (0), (1)) v(k) GROUP BY 1, 2, 3),
p AS (SELECT i, j, coalesce(max(h) FILTER (b = 0), 0) AS h0, coalesce(max(h) FILTER (b < 0), 0) AS l, coalesce(max(h) FILTER (b > 0), 0) AS r FROM h GROUP BY 1, 2)
SELECT i, j, n, round(CASE WHEN least(l, r) > 0 THEN CAST(h0 AS DOUBLE) / least(l, r) ELSE 0 END, 6) AS score, round(CASE WHEN greatest(l, r) > 0 THEN CAST(h0 AS DOUBLE) / greatest(l, r) ELSE 0 END, 6) AS ratio FROM p JOIN n USING (i, j)""")
def unit_bimodality(spark, d):
    return soft.bimodality(assigned(spark, d), "vec_id", 0.5).select("i", "j", "n", r6(F.col("score")).alias("score"), r6(F.col("ratio")).alias("ratio"))


@query(f"""WITH {S}, a AS (SELECT spike_id AS a_id, t AS ta, label % 5 AS label FROM s WHERE channel = 'click'), b AS (SELECT spike_id AS b_id, t AS tb, label % 5 AS label FROM s WHERE channel = 'purchase'),
p AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY abs(tb - ta), b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY abs(tb - ta), a_id) AS rb FROM (SELECT a_id, ta, b_id, tb FROM a JOIN b ON abs(tb - ta) <= 100000)),
m AS (SELECT a_id, b_id FROM p WHERE ra = 1 AND rb = 1),
c AS (SELECT label, 1 AS tp, 0 AS fn, 0 AS fp FROM m JOIN a USING (a_id) UNION ALL SELECT label, 0, 1, 0 FROM a WHERE a_id NOT IN (SELECT a_id FROM m) UNION ALL SELECT label, 0, 0, 1 FROM b WHERE b_id NOT IN (SELECT b_id FROM m)),
g AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp FROM c GROUP BY label)
SELECT label, tp, fn, fp, round(tp / (tp + fn + fp), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM g""")
def unit_performance(spark, d):
    s = event_spikes(spark, d).withColumn("label", F.col("label") % 5)
    a = s.where("channel = 'click'").select(F.col("spike_id").alias("a_id"), F.col("t").alias("ta"), "label")
    b = s.where("channel = 'purchase'").select(F.col("spike_id").alias("b_id"), F.col("t").alias("tb"), "label")
    out = compare.unit_performance(joins.categories(a.drop("label"), b.drop("label"), 100_000), a, b)
    return out.select("label", "tp", "fn", "fp", *(r6(F.col(c)).alias(c) for c in ("accuracy", "recall", "precision")))


@query(f"""WITH {L}, g AS (SELECT unnest(range(-4, 5)) AS lag), p AS (SELECT a.label AS i, b.label AS j, lag, round(sum(a.mean * b.mean), 9) AS dot FROM m a, m b, g WHERE a.label < b.label AND a.sample = b.sample + lag GROUP BY 1, 2, 3)
SELECT i, j, CAST(lag AS INT) AS lag, round(dot, 6) AS dot FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY dot DESC, abs(lag), lag) AS k FROM p) WHERE k = 1""")
def lagged_pairs(spark, d):
    return distances.lagged(units(spark, d), 4).select("i", "j", "lag", r6(F.col("dot")).alias("dot"))


def neighbourhoods(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ch = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("channel"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("z"))
    return ch, joins.channel_index(ch, 10.0)


def by_place(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Channels, the index of one channel for each place, and the place of each channel."""
    ch = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("channel"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("z"))
    return ch, *joins.place_index(ch, 10.0)


@query(f"""WITH {CH}, n AS (SELECT a.channel AS m, b.channel AS l, b.x - a.x AS dx, b.z - a.z AS dz, b.x, b.z FROM ch a JOIN ch b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) <= 10 AND a.channel <> b.channel)
SELECT f.m AS main, f.l AS channel, p.l AS parent FROM n f JOIN n p ON f.m = p.m AND f.l <> p.l
WHERE f.dx * p.dx + f.dz * p.dz > 0.7071067811865476 * sqrt(f.dx * f.dx + f.dz * f.dz) * sqrt(p.dx * p.dx + p.dz * p.dz) AND (f.x - p.x) * -p.dx + (f.z - p.z) * -p.dz < 0""")
def channel_parents(spark, d):
    return locate.parents_of_copies(*by_place(spark, d))


@query()
def point_sources(spark, d):
    v = F.transform("v", lambda x: F.abs(x))
    grid = F.sequence(F.lit(0), F.lit(63))
    rows = emb(spark, d).select("vec_id", v.alias("amp"), F.transform(grid, lambda k: (k % 4) * 16.0).alias("xs"), F.transform(grid, lambda k: F.floor(k / 4) * 20.0).alias("zs"))
    return locate.localize(rows, "vec_id")


@query()
def dipoles(spark, d):
    """The same amplitudes as of dipoles: place, moment, error."""
    v = F.transform("v", lambda x: F.abs(x))
    grid = F.sequence(F.lit(0), F.lit(63))
    rows = emb(spark, d).select("vec_id", v.alias("amp"), F.transform(grid, lambda k: (k % 4) * 16.0).alias("xs"), F.transform(grid, lambda k: F.floor(k / 4) * 20.0).alias("zs"))
    return locate.localize(rows, "vec_id", kind="dipole")


@query()
def refined_mixture(spark, d):
    """Five coarse units, refined on even ids and judged on odd ones; each row's unit and how likely it is."""
    rows = emb(spark, d).withColumn("v", F.col("v").cast("array<double>"))
    u = units(spark, d).orderBy("label").toPandas()
    means = np.stack(u["v"].to_numpy())
    start = refine.Model(np.stack([means[i::5].mean(0) for i in range(5)]), np.full(6, 1 / 6), 0.01, 1e-30)
    m = refine.refine(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), "v", start, 0.3, 2, 1.0, 5)
    return refine.assigned(rows, "v", m, "vec_id").withColumn("r", r6(F.col("r")))


@query(f"WITH {S}, n AS (SELECT label, count(*) AS n FROM s GROUP BY label), o AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) // 4 AS merged FROM n) SELECT spike_id, t + merged AS t, merged FROM s JOIN o USING (label)")
def relabel_units(spark, d):
    s = event_spikes(spark, d)
    names = s.groupBy("label").count().withColumn("new", F.floor((F.row_number().over(Window.orderBy(F.desc("count"), "label")) - 1) / 4).cast("int")).select("label", "new", F.col("new").cast("long").alias("shift"))
    return distances.relabel(s, names).select("spike_id", "t", F.col("merged").cast("int").alias("merged"))


@query("""WITH b AS (SELECT min(p_size) AS x0, max(p_size) AS x1, min((p_retailprice - 900) / 4) AS z0, max((p_retailprice - 900) / 4) AS z1 FROM part), n AS (SELECT *, floor((x1 - x0) / 7.0) AS nx, floor((z1 - z0) / 9.0) AS nz FROM b)
SELECT p_partkey AS id, CAST(greatest(least(floor(((p_retailprice - 900) / 4 - (z0 + z1 - nz * 9.0) / 2) / 9.0 + 0.5), nz), 0) * (nx + 1) + greatest(least(floor((p_size - (x0 + x1 - nx * 7.0) / 2) / 7.0 + 0.5), nx), 0) AS BIGINT) AS label FROM part, n""")
def grid_snap(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), ((F.col("p_retailprice") - 900) / 4).alias("z"))
    return joins.grid_snap(p, 7.0, 9.0).select("id", F.col("label").cast("long").alias("label"))


@query(f"WITH {S}, c AS (SELECT label, channel, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT DISTINCT channel FROM s), k AS (SELECT a.channel, b.channel AS neighbor FROM r a JOIN r b ON abs(length(a.channel) - length(b.channel)) <= 1), w AS (SELECT label, neighbor AS channel, sum(n) AS n FROM c JOIN k USING (channel) GROUP BY 1, 2) SELECT label, channel, round(n / max(n) OVER (PARTITION BY label), 6) AS weight FROM w")
def radial_weights(spark, d):
    s = event_spikes(spark, d)
    kinds = s.select("channel").distinct()
    near = kinds.join(kinds.withColumnRenamed("channel", "neighbor"), F.abs(F.length("channel") - F.length("neighbor")) <= 1)
    return labels.radial_weights(s, near).select("label", "channel", r6(F.col("weight")).alias("weight"))


@query(f"""WITH {S} SELECT label, count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.label = s.label AND b.spike_id <> s.spike_id AND abs(b.t - s.t) <= 400000 AND abs(b.t - s.t) > 10000 AND b.amplitude >= s.amplitude) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM s GROUP BY label""")
def collision_rates(spark, d):
    flagged = joins.possible_collisions(event_spikes(spark, d), 400_000, 10_000, by=["label"])
    return labels.collision_rates(flagged).select("label", "n", r6(F.col("rate")).alias("rate"))


@query("SELECT 'l_tax' AS \"column\", count(*) FILTER (l_tax IS NULL) AS nulls, count(*) FILTER (isnan(l_tax)) AS nans, count(*) FILTER (isinf(l_tax)) AS infinite FROM lineitem UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity IS NULL), count(*) FILTER (isnan(l_quantity)), count(*) FILTER (isinf(l_quantity)) FROM lineitem")
def number_problems(spark, d):
    return labels.problems(table(spark, d, "lineitem"), ["l_tax", "l_quantity"])


@query()
def greedy_time_match(spark, d):
    s = event_spikes(spark, d)
    a = s.where("channel = 'click'").select(F.col("spike_id").alias("a_id"), F.col("t").cast("double").alias("ta"))
    b = s.where("channel = 'purchase'").select(F.col("spike_id").alias("b_id"), F.col("t").cast("double").alias("tb"))
    return joins.greedy_match(a, b, ["ta"], ["tb"], 100_000.0, 1000.0).select("a_id", "b_id", "d")
