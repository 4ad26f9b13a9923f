"""Queries on low-rank mixtures, matching with phases, interpolation, recordings' reports and candidate pools."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, factors, interpolate, library, phases, recordings
from ..sources.tables import table
from .base import r6, registry
from .blend_queries import raw
from .noise_queries import X, mean_templates, samples
from .sorting_queries import A, B, allowed, search_sets, sets
from .unit_queries import E, M, emb

QUERIES, ORACLE, query = registry()

#: Embeddings as 8 channels of 8 components; neighbourhood vec_id % 3 sees all, the first six or the last six channels.
SEEN = [np.arange(64), np.arange(48), np.arange(16, 64)]


def partly_seen(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d).select("vec_id", F.col("label").cast("int").alias("label"), F.col("v").cast("array<double>").alias("v"))
    h = (F.col("vec_id") % 3).cast("int")
    return e.withColumn("hood", h).withColumn("v", F.when(h == 1, F.slice("v", 1, 48)).when(h == 2, F.slice("v", 17, 48)).otherwise(F.col("v")))


def mixture_of(spark: SparkSession, d: str) -> factors.Factors:
    """Rank 1, from the labels; vectors have norm 1, so the noise has 1 / 64 an entry."""
    rows = partly_seen(spark, d)
    units = int(rows.agg(F.max("label")).first()[0] or 0) + 1
    m = factors.start(rows, units, 1, np.eye(64) / 64, SEEN, steps=2)
    return factors.fit(rows, m, steps=4)[0]


@query()
def lowrank_mixture(spark, d):
    got = factors.score(partly_seen(spark, d).select("vec_id", "hood", "v"), mixture_of(spark, d))
    return got.select("vec_id", F.col("unit").cast("long").alias("unit"), r6("score").alias("score"), r6("noise_r").alias("noise_r"))


@query()
def phase_matches(spark, d):
    """All snippets as one recording, searched for the labels' mean templates at four phases with a second pass; the threshold is half their median norm."""
    shapes, units = mean_templates(spark, d)
    bank = phases.Bank.of(shapes, units, 8, 4, 4)
    return phases.match(samples(spark, d), bank, float(np.median(np.sqrt((shapes**2).sum((1, 2))))) / 2, 8000, passes=2)


@query(f"""WITH {M}, r AS (SELECT label AS unit, sample // 16 AS channel, sample % 16 AS s, mean AS v FROM m), p AS (SELECT a.unit AS a, b.unit AS b, 0 AS phase, b.s - a.s AS lag, sum(a.v * b.v) AS x FROM r a JOIN r b USING (channel) GROUP BY 1, 2, 4)
SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(phase AS INT) AS phase, CAST(lag AS INT) AS lag, round(x, 6) AS product FROM p WHERE abs(x) > 1e-9""")
def pair_products(spark, d):
    shapes, units = mean_templates(spark, d)
    return phases.pair_table(spark, phases.Bank.of(shapes, units, 8, 4, 1), 1e-9).withColumn("product", r6("product"))


def lags_of(spark: SparkSession, d: str) -> tuple[DataFrame, list[int]]:
    shapes, units = mean_templates(spark, d)
    return library.pair_lags(spark, shapes, 4, 0.0, -2.0), units


@query(f"""WITH {M}, r AS (SELECT label AS unit, dense_rank() OVER (ORDER BY label) - 1 AS k, sample // 16 AS channel, sample % 16 AS s, mean AS v FROM m), n AS (SELECT k, sqrt(sum(v * v)) AS norm FROM r GROUP BY k),
p AS (SELECT a.k AS i, b.k AS j, b.s - a.s AS lag, sum(a.v * b.v) AS x FROM r a JOIN r b ON a.channel = b.channel AND a.k < b.k AND abs(b.s - a.s) <= 4 GROUP BY 1, 2, 3), q AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY x DESC, abs(lag), lag) AS rank FROM p)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(lag AS INT) AS lag, round(x / (a.norm * b.norm), 6) AS corr FROM q JOIN n a ON a.k = i JOIN n b ON b.k = j WHERE rank = 1""")
def template_lags(spark, d):
    return lags_of(spark, d)[0].withColumn("corr", r6("corr"))


@query(f"""WITH {X}, c AS (SELECT t // 4096 AS chunk, median(abs(v)) AS mad, max(abs(v)) AS top, (max(t) - min(t) + 1) / 1000.0 AS s FROM x GROUP BY 1),
w AS (SELECT abs(v) AS v, max(abs(v)) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, max(abs(v)) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM x),
p AS (SELECT count(*) AS n FROM w WHERE v > 0.25 AND v > b AND v >= a)
SELECT round(n / sum(s), 6) AS detections, round(max(top), 6) AS largest, round(avg(mad) * 1.4826, 6) AS std, n / sum(s) < 10 AS too_few, n / sum(s) > 10000 AS too_many, max(top) > 10000 AS too_large, avg(mad) * 1.4826 < 0.1 OR avg(mad) * 1.4826 > 10 AS odd_std FROM c, p GROUP BY n""")
def recording_report(spark, d):
    got = recordings.report(samples(spark, d), 4096, 1000.0, 5, 0.25)
    return got.select(r6("detections").alias("detections"), r6("largest").alias("largest"), r6("std").alias("std"), "too_few", "too_many", "too_large", "odd_std")


@query(f"""WITH {M}, c AS (SELECT label AS unit, sample // 8 AS channel, max(mean) - min(mean) AS ptp, sum(mean * mean) AS sq FROM m GROUP BY 1, 2), k AS (SELECT label AS unit, count(*) AS n FROM embeddings GROUP BY 1)
SELECT unit, unit * 2.0 AS x, 0.0 AS y, unit * 10.0 AS z, round(max(ptp), 6) AS amplitude, round(sqrt(sum(sq)), 6) AS norm, any_value(n) AS n, round(any_value(n) / 60.0, 6) AS rate FROM c JOIN k USING (unit) GROUP BY unit""")
def unit_information(spark, d):
    e = emb(spark, d)
    places = e.select(F.col("label").alias("unit")).distinct().select("unit", (F.col("unit") * 2.0).alias("x"), F.lit(0.0).alias("y"), (F.col("unit") * 10.0).alias("z"))
    got = recordings.unit_information(e, raw(spark, d), places, 60.0)
    return got.withColumns({c: r6(c) for c in ("amplitude", "norm", "rate")})


@query("SELECT vec_id, round(CAST(embedding[(vec_id % 8) * 8 + 1] AS DOUBLE), 6) AS a, round(CAST(embedding[(vec_id % 8) * 8 + 2] AS DOUBLE), 6) AS b FROM embeddings")
def main_components(spark, d):
    got = recordings.main_components(emb(spark, d).withColumn("slot", F.col("vec_id") % 8), "slot", 8, 2)
    return got.select("vec_id", *(r6(F.col("main")[i].cast("double")).alias(n) for i, n in enumerate("ab")))


@query("""WITH s AS (SELECT event_id, user_id, epoch_us(ts) // 3600 AS t FROM events) SELECT event_id, (SELECT count(*) FROM s b WHERE abs(b.t - s.t) < 50) - 1 AS n_near FROM s""")
def collidedness(spark, d):
    s = table(spark, d, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600).alias("t"))
    return recordings.collidedness(s, 50).select("event_id", "n_near")


@query(f"""WITH {E}, w AS (SELECT t, s, 1 / greatest(abs(20.0 * s - (10.0 + 20.0 * t)), 1e-10) AS w FROM range(6) a(s), range(5) b(t)), n AS (SELECT t, s, w / sum(w) OVER (PARTITION BY t) AS w FROM w)
SELECT vec_id, t AS target, sample % 8 AS component, round(sum(w * x), 6) AS v FROM e JOIN n ON n.s = e.sample // 8 GROUP BY 1, 2, 3""")
def interpolated_features(spark, d):
    """The first six of eight channels, 20 apart, carried to the five places between them."""
    rows = emb(spark, d).select("vec_id", F.slice(F.col("v").cast("array<double>"), 1, 48).alias("v"), F.lit(0).alias("hood"))
    places = np.stack([np.zeros(8), 20.0 * np.arange(8)], 1)
    got = interpolate.interpolated(rows, places, [np.arange(6)], places + np.array([0.0, 10.0]), [np.arange(5)], 8, "idw", 1.0)
    return got.select("vec_id", F.posexplode("at").alias("k", "v")).select("vec_id", F.floor(F.col("k") / 8).alias("target"), (F.col("k") % 8).cast("long").alias("component"), r6("v").alias("v"))


@query(f"""WITH {A}, sh AS (SELECT DISTINCT a.unit AS i, b.unit AS j FROM al a JOIN al b USING (neighborhood)), q AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY CASE WHEN i = j THEN -1.0 ELSE abs(i * 7 % 50 - j * 7 % 50) END, j) - 1 AS rank FROM sh)
SELECT a.unit, a.neighborhood, b.unit AS candidate FROM al a JOIN al b USING (neighborhood) WHERE a.unit <> b.unit AND NOT EXISTS (SELECT 1 FROM q WHERE rank < 6 AND i = a.unit AND j = b.unit)""")
def explore_pool(spark, d):
    return candidates.explore_pool(allowed(spark, d), search_sets(spark, d))


@query(f"""WITH {B}, pl AS (SELECT CAST(i AS INT) AS channel, (i % 2) * 20.0 AS x, i * 15.0 AS z FROM range(1, 12) r(i)), nr AS (SELECT a.channel, b.channel AS near FROM pl a JOIN pl b ON (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 900),
u AS (SELECT neighborhood, near AS channel FROM x JOIN nr USING (channel) UNION SELECT neighborhood, channel FROM x) SELECT u.neighborhood AS hood, u.channel, x.channel IS NOT NULL AS seen FROM u LEFT JOIN x ON x.neighborhood = u.neighborhood AND x.channel = u.channel""")
def missing_near(spark, d):
    places = spark.range(1, 12).select(F.col("id").cast("int").alias("channel"), ((F.col("id") % 2) * 20.0).alias("x"), (F.col("id") * 15.0).alias("z"))
    return interpolate.missing_near(sets(spark, d)[0].select(F.col("neighborhood").alias("hood"), "channels"), places, 30.0)


#: Channels one below another, 10 apart; main channel p_size % 8 of a part, moved by p_partkey % 3 pitches, and its neighbours on either side.
STABLE = """p AS (SELECT p_partkey AS id, CAST(p_size % 8 AS INT) AS channel, CAST(p_partkey % 3 AS INT) AS shift FROM part), k AS (SELECT DISTINCT channel, shift FROM p),
s AS (SELECT channel, shift, list_sort(list(CAST(channel + o + shift AS INT))) AS channels FROM k, (SELECT unnest([-1, 0, 1]) AS o) WHERE channel + o BETWEEN 0 AND 7 GROUP BY 1, 2), h AS (SELECT channels, CAST(row_number() OVER (ORDER BY channels) - 1 AS INT) AS hood FROM (SELECT DISTINCT channels FROM s))"""


@query(f"WITH {STABLE} SELECT id, channel, shift, hood, array_to_string(channels, ' ') AS channels FROM p JOIN s USING (channel, shift) JOIN h USING (channels)")
def stable_sets(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 8).cast("int").alias("channel"), (F.col("p_partkey") % 3).cast("int").alias("shift"))
    line = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name), F.lit(0.0).alias("x"), (F.col("id") * 10.0).alias("z"))
    index = spark.range(8).select(F.col("id").cast("int").alias("channel"), F.posexplode(F.array(*((F.col("id") + o).cast("int") for o in (-1, 0, 1)))).alias("slot", "neighbor")).withColumn("neighbor", F.when(F.col("neighbor").between(0, 7), F.col("neighbor")))
    known, rows = interpolate.stable_sets(p, index, line(8, "channel"), line(10, "reg_channel"), 10.0)
    return rows.join(F.broadcast(known), "hood").select("id", "channel", "shift", "hood", F.array_join(F.col("channels").cast("array<string>"), " ").alias("channels"))
