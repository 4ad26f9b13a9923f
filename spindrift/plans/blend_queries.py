"""Queries on features of snippets, blended and registered templates, weighted distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blend, candidates, channels, distances, features, templates
from ..sources.tables import table
from .base import r6, registry
from .unit_queries import L, M, assigned, emb, units

QUERIES, ORACLE, query = registry()

#: Templates of 8 channels by 8 samples: means, lower medians as the smoothed ones, and ratios by channel.
T = M + """, raw AS (SELECT label AS unit, sample // 8 AS channel, sample % 8 AS s, mean AS v, n FROM m), low AS (SELECT label AS unit, sample // 8 AS channel, sample % 8 AS s, quantile_disc(x, 0.5) AS v FROM e GROUP BY label, sample),
snr AS (SELECT unit, channel, (max(v) - min(v)) * sqrt(max(n)) AS snr FROM raw GROUP BY 1, 2)"""


def _long(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.col("label").alias("unit"), F.floor(F.col("sample") / 8).alias("channel"), (F.col("sample") % 8).alias("sample"), F.col(value).alias("v"))


def raw(spark: SparkSession, d: str) -> DataFrame:
    return _long(templates.mean(emb(spark, d)), "mean")


def low(spark: SparkSession, d: str) -> DataFrame:
    return _long(templates.median(emb(spark, d)), "median")


def ratios(spark: SparkSession, d: str) -> DataFrame:
    return templates.snr_by_channel(templates.mean(emb(spark, d)), 8).withColumnRenamed("label", "unit")


@query(f"""WITH {T}, w AS (SELECT raw.unit, raw.channel, raw.s, raw.v, low.v AS l, 1 / (1 + exp(6.0 + 12.0 * (CASE WHEN raw.s >= 3 THEN (raw.s - 3) / 4.0 ELSE (3 - raw.s) / 3.0 END) - 12.0 * least(snr, 2.0) / 2.0)) AS w FROM raw JOIN low USING (unit, channel, s) JOIN snr USING (unit, channel))
SELECT unit, channel, s AS sample, round(w * v + (1 - w) * l, 6) AS v FROM w""")
def blended_templates(spark, d):
    got = blend.blended(raw(spark, d), low(spark, d), ratios(spark, d), 8, 3, 2.0)
    return got.select("unit", "channel", F.col("sample").cast("long").alias("sample"), r6("v").alias("v"))


#: Snippets moved by vec_id % 3 channels.
R = "r AS (SELECT label AS unit, vec_id, vec_id % 3 AS shift, sample // 8 + vec_id % 3 AS reg_channel, sample % 8 AS sample, x AS v FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS sample FROM embeddings))"


def moved(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d).select(F.col("label").alias("unit"), F.col("vec_id").alias("spike_id"), (F.col("vec_id") % 3).alias("shift"), F.posexplode("v").alias("k", "v"))
    return e.select("unit", "spike_id", "shift", (F.floor(F.col("k") / 8) + F.col("shift")).alias("reg_channel"), (F.col("k") % 8).cast("long").alias("sample"), F.col("v").cast("double").alias("v"))


@query(f"WITH {R} SELECT unit, reg_channel, sample, round(quantile_disc(v, 0.5), 6) AS v, count(*) AS n FROM r GROUP BY 1, 2, 3")
def registered_averages(spark, d):
    return blend.registered_average(moved(spark, d)).select("unit", "reg_channel", "sample", r6("v").alias("v"), "n")


@query(f"""WITH {R}, c AS (SELECT unit, shift, count(DISTINCT vec_id) AS c FROM r GROUP BY 1, 2), k AS (SELECT unit, shift FROM (SELECT *, sum(c) OVER (PARTITION BY unit) AS total FROM c) WHERE c >= 0.34 * total OR c >= 1000),
b AS (SELECT unit, shift, reg_channel, sample, quantile_disc(v, 0.5) AS v, count(*) AS n FROM r JOIN k USING (unit, shift) GROUP BY 1, 2, 3, 4) SELECT unit, reg_channel, sample, round(sum(v * n) / sum(n), 6) AS v, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1, 2, 3""")
def registered_templates(spark, d):
    return blend.registered_template(moved(spark, d), 0.34, 1000).select("unit", "reg_channel", "sample", r6("v").alias("v"), "n")


#: A probe of 4 by 4 sites and its copy one step down and up.
G = "g AS (SELECT CAST(range AS INT) AS channel, (range % 4) * 16.0 AS x, (range // 4) * 20.0 AS z FROM range(16)), rg AS (SELECT row_number() OVER (ORDER BY z, x) - 1 AS reg_channel, x, z FROM (SELECT DISTINCT x, z + k * 20.0 AS z FROM g, (SELECT unnest([-1, 0, 1]) AS k)))"


def probe(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    from ..operators import motion

    ch = spark.range(16).select(F.col("id").cast("int").alias("channel"), ((F.col("id") % 4) * 16.0).alias("x"), (F.floor(F.col("id") / 4) * 20.0).alias("z"))
    return ch, motion.registered_geometry(ch, 20.0, 1, 1)


@query(f"WITH {G}, v AS (SELECT vec_id, vec_id % 16 AS channel, label % 3 - 1 AS shift FROM embeddings) SELECT vec_id, reg_channel FROM v JOIN g USING (channel) LEFT JOIN rg ON rg.x = g.x AND rg.z = g.z + shift * 20.0")
def landed_channels(spark, d):
    ch, reg = probe(spark)
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 16).cast("int").alias("channel"), (F.col("label") % 3 - 1).alias("shift"))
    return channels.shifted_channels(rows, ch, reg, 20.0).select("vec_id", F.col("reg_channel").cast("long").alias("reg_channel"))


#: Weights over each unit's greatest, overlaps over all channels that either unit has, and the values of the pairs that overlap enough.
W = T + """, w AS (SELECT unit, channel, least(snr, 2.0) / max(least(snr, 2.0)) OVER (PARTITION BY unit) AS w FROM snr), u AS (SELECT DISTINCT unit FROM w), c AS (SELECT DISTINCT channel FROM w),
full_w AS (SELECT u.unit, c.channel, coalesce(w, 0) AS w FROM u CROSS JOIN c LEFT JOIN w ON w.unit = u.unit AND w.channel = c.channel),
o AS (SELECT a.unit AS i, b.unit AS j FROM full_w a JOIN full_w b ON a.channel = b.channel AND a.unit < b.unit GROUP BY 1, 2 HAVING sum(least(a.w, b.w)) / sum(greatest(a.w, b.w)) >= 0.75),
p AS (SELECT o.i, o.j, a.v AS a, b.v AS b, least(wa.w, wb.w) AS w FROM o JOIN raw a ON a.unit = o.i JOIN raw b ON b.unit = o.j AND a.channel = b.channel AND a.s = b.s
JOIN w wa ON wa.unit = o.i AND wa.channel = a.channel JOIN w wb ON wb.unit = o.j AND wb.channel = a.channel)"""


def weights(spark, d):
    return ratios(spark, d).select("unit", "channel", F.least("snr", F.lit(2.0)).alias("w"))


@query(f"WITH {W} SELECT i, j, round(sqrt(avg(w * (a - b) * (a - b)) / sqrt(avg(w * a * a)) / sqrt(avg(w * b * b))), 6) AS d FROM p GROUP BY 1, 2")
def weighted_normeuc(spark, d):
    return blend.weighted_distance(raw(spark, d), weights(spark, d)).select("i", "j", r6("d").alias("d"))


@query(f"WITH {W} SELECT i, j, round(max(w * abs(a - b)) / least(max(w * abs(a)), max(w * abs(b))), 6) AS d FROM p GROUP BY 1, 2")
def weighted_normsup(spark, d):
    return blend.weighted_distance(raw(spark, d), weights(spark, d), kind="normsup").select("i", "j", r6("d").alias("d"))


@query(f"""WITH {T}, w AS (SELECT unit, channel, least(snr, 2.0) AS w FROM snr), u AS (SELECT unit FROM w GROUP BY unit),
g AS (SELECT a.unit AS i, b.unit AS j, a.channel, least(a.w, b.w) AS low, greatest(a.w, b.w) AS high FROM w a JOIN w b ON a.channel = b.channel AND a.unit < b.unit),
o AS (SELECT i, j, sum(low) AS low, sum(high) AS high FROM g GROUP BY 1, 2),
k AS (SELECT g.i, g.j, g.channel, g.low / o.low AS w FROM g JOIN o ON g.i = o.i AND g.j = o.j),
na AS (SELECT k.i, k.j, sum(k.w * k.w * a.v * a.v) AS sa FROM k JOIN raw a ON a.unit = k.i AND a.channel = k.channel GROUP BY 1, 2),
nb AS (SELECT k.i, k.j, sum(k.w * k.w * b.v * b.v) AS sb FROM k JOIN raw b ON b.unit = k.j AND b.channel = k.channel GROUP BY 1, 2),
x AS (SELECT k.i, k.j, a.s - b.s AS lag, sum(k.w * k.w * a.v * b.v) AS dot FROM k JOIN raw a ON a.unit = k.i AND a.channel = k.channel JOIN raw b ON b.unit = k.j AND b.channel = k.channel GROUP BY 1, 2, 3),
y AS (SELECT i, j, max(dot) AS dot, arg_max(lag, dot) AS lag FROM x GROUP BY 1, 2),
c AS (SELECT y.i, y.j, y.dot, y.lag, sa, sb, least(greatest((dot + 10000) / (sa + 10000), 0.75), 1 + 1.0 / 3) AS ca, least(greatest((dot + 10000) / (sb + 10000), 0.75), 1 + 1.0 / 3) AS cb
  FROM y JOIN na ON y.i = na.i AND y.j = na.j JOIN nb ON y.i = nb.i AND y.j = nb.j)
SELECT c.i, c.j, round(sqrt(least(greatest(ca * ca * sa + sb - 2 * ca * dot, 0) / sqrt(sb * ca * ca * sa), greatest(cb * cb * sb + sa - 2 * cb * dot, 0) / sqrt(sa * cb * cb * sb))), 6) AS d,
  CAST(c.lag AS INT) AS lag, round(o.low / o.high, 6) AS iou FROM c JOIN o ON c.i = o.i AND c.j = o.j""")
def weighted_lagged(spark, d):
    """Units' mean templates in the basis of single samples, so that products by lag are plain ones."""
    t = raw(spark, d).toPandas()  # a unit table
    w = weights(spark, d).toPandas()
    names = sorted(t["unit"].unique())
    x, k = np.zeros((len(names), 8, 8)), np.zeros((len(names), 8))
    x[t["unit"].map(names.index), t["sample"], t["channel"]] = t["v"]
    k[w["unit"].map(names.index), w["channel"]] = w["w"]
    return distances.weighted_lagged(spark, x, distances.temporal_products(np.eye(8)), k, [int(n) for n in names], block=4).withColumns({"d": r6("d"), "iou": r6("iou")})


@query(f"WITH {T} SELECT unit, round(sqrt(sum((raw.v - low.v) * (raw.v - low.v))) / sqrt(sum(raw.v * raw.v)), 6) AS d FROM raw JOIN low USING (unit, channel, s) GROUP BY unit")
def mean_median_difference(spark, d):
    return blend.mean_median_difference(raw(spark, d), low(spark, d)).select("unit", r6("d").alias("d"))


@query("""WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, i AS sample, round(x * CASE WHEN i < 10 THEN (cos(-pi() + i * pi() / 9) + 1) / 2 WHEN i >= 44 THEN (cos((i - 44) * -pi() / 19) + 1) / 2 ELSE 1 END, 6) + 0.0 AS v FROM e""")
def tapered(spark, d):
    return emb(spark, d).select("vec_id", F.posexplode(features.tapered("v", 10, 20)).alias("sample", "v")).select("vec_id", F.col("sample").cast("long").alias("sample"), (r6("v") + 0.0).alias("v"))


@query(f"""WITH {M}, j AS (SELECT vec_id, sum(x * mean) AS wd, sum(mean * mean) AS dd, sum(x * x) AS ww, sum((x - mean) * (x - mean)) AS rr FROM e JOIN m USING (label, sample) GROUP BY vec_id)
SELECT vec_id, round(sqrt(abs(2 * wd - dd)), 6) AS score, 2 * wd - dd > 0.25 AS deconv, ww - rr > 0.25 AS normsq, sqrt(ww) - sqrt(rr) > 0.5 AS norm FROM j""")
def residual_tests(spark, d):
    rows = emb(spark, d).join(F.broadcast(units(spark, d).withColumnRenamed("v", "own")), "label")
    tests = {k: features.residual_decrease("v", "own", 0.5, k) for k in ("deconv", "normsq", "norm")}
    return rows.select("vec_id", r6(features.denoising_score("v", "own")).alias("score"), *(c.alias(k) for k, c in tests.items()))


@query(f"""WITH {M}, q AS (SELECT vec_id, m.label AS centroid, sum((e.x - m.mean) * (e.x - m.mean)) AS d2 FROM e JOIN m USING (sample) WHERE abs(e.label - m.label) <= 1 GROUP BY 1, 2) SELECT vec_id, centroid, round(d2, 6) AS d2 FROM q""")
def near_centroid_distances(spark, d):
    u = units(spark, d)
    near = u.select(F.col("label").alias("i")).join(u.select(F.col("label").alias("j"))).where("abs(i - j) <= 1")
    return candidates.near_centroid_distances(emb(spark, d), u, near, "vec_id").select("vec_id", "centroid", r6("d2").alias("d2"))


@query(f"WITH {L} SELECT unit, round(sum(r), 5) AS n, round(sum(r * r), 5) AS n2 FROM t GROUP BY unit")
def responsibility_counts(spark, d):
    return candidates.unit_counts(assigned(spark, d), "vec_id").select("unit", F.round("n", 5).alias("n"), F.round("n2", 5).alias("n2"))


@query(f"WITH {M} SELECT e.label AS unit, e.sample, CAST(count(*) AS DOUBLE) AS n, round(avg(x), 6) AS mean, round(sum((x - mean) * (x - mean)), 5) AS m2 FROM e JOIN m USING (label, sample) GROUP BY 1, 2")
def combined_moments(spark, d):
    x = emb(spark, d).select("label", (F.col("vec_id") % 4).alias("part"), F.posexplode("v").alias("sample", "x")).withColumn("x", F.col("x").cast("double"))
    parts = x.groupBy(F.col("label").alias("unit"), "part", "sample").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count(F.lit(1))).alias("m2"))
    got = candidates.combined_moments(parts)
    return got.select("unit", F.col("sample").cast("long").alias("sample"), "n", r6("mean").alias("mean"), F.round("m2", 5).alias("m2"))


@query()
def temporal_features(spark, d):
    """Five components of each snippet, the voltage at sample 3 and the range, through a fitted pipeline."""
    rows = emb(spark, d).withColumn("v", F.col("v").cast("array<double>"))
    pipe = features.Pipeline(features.basic_steps(5, 3)).fit(rows)
    return pipe.transform(rows).select("vec_id", r6("voltage").alias("voltage"), r6("ptp").alias("ptp"), F.transform("pcs", lambda x: F.round(x, 6)).alias("pcs"))
