"""Queries on noise, sampling, matching and simulation: embeddings as snippets of four channels, events as sparse samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, matching, motion, noise, sampling, simulate, subtract, templates
from ..sources.tables import event_spikes, table

QUERIES: dict = {}
ORACLE: dict = {}

E = "e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS sample FROM embeddings)"
M = E + ", m AS (SELECT label, sample, avg(x) AS mean FROM e GROUP BY label, sample)"
#: Each snippet's 64 entries are four channels of 16 samples; a time is a vector and a sample.
X = E + ", x AS (SELECT vec_id * 16 + sample % 16 AS t, sample // 16 AS channel, x AS v FROM e)"
S = "s AS (SELECT event_id AS spike_id, epoch_us(ts) // 3600 AS t, user_id AS label, event_type AS channel, value AS amplitude FROM events)"
CH = "ch AS (SELECT CAST(s_suppkey AS INT) AS channel, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal / 100 AS z FROM supplier)"
U = "(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':0'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496"
DAY = 24_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def samples(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return long.select((F.col("vec_id") * 16 + F.col("k") % 16).alias("t"), F.floor(F.col("k") / 16).alias("channel"), F.col("v").cast("double").alias("v"))


LEVELS = X + ", c AS (SELECT channel, median(v) AS centre FROM x GROUP BY channel), n AS (SELECT channel, any_value(centre) AS centre, median(abs(v - centre)) * 1.4826 AS level FROM x JOIN c USING (channel) GROUP BY channel)"


@query(f"WITH {LEVELS} SELECT channel, round(centre, 6) AS centre, round(level, 6) AS level FROM n")
def noise_levels(spark, d):
    return noise.levels(samples(spark, d)).select("channel", r6(F.col("centre")).alias("centre"), r6(F.col("level")).alias("level"))


@query(f"WITH {LEVELS} SELECT t, channel, round(v / level, 5) AS z FROM x JOIN n USING (channel)")
def standardize(spark, d):
    return noise.standardize(samples(spark, d)).select("t", "channel", F.round("z", 5).alias("z"))


@query(f"WITH {X} SELECT t, channel, round(v - median(v) OVER (PARTITION BY t), 6) AS ref FROM x")
def median_reference(spark, d):
    return noise.median_reference(samples(spark, d)).select("t", "channel", r6(F.col("ref")).alias("ref"))


@query(f"WITH {X} SELECT a.channel AS i, b.channel AS j, round(avg(a.v * b.v), 6) AS cov, count(*) AS n FROM x a JOIN x b ON a.t = b.t AND a.channel <= b.channel GROUP BY 1, 2")
def channel_covariance(spark, d):
    return noise.channel_covariance(samples(spark, d)).select("i", "j", r6(F.col("cov")).alias("cov"), "n")


@query()
def whitened(spark, d):
    names, cov = noise.matrix(noise.channel_covariance(samples(spark, d)))
    times = samples(spark, d).groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("channel", "v"))), lambda s: s["v"]).alias("v"))
    return noise.apply_matrix(times, noise.zca(cov)).select("t", "white")


@query()
def noise_spectrum(spark, d):
    return noise.spectrum(table(spark, d, "embeddings").select(F.col("embedding").alias("v")), 16)


@query(f"SELECT event_id AS spike_id FROM (SELECT event_id, -ln({U}) / value AS e FROM events WHERE value > 0) ORDER BY e, event_id LIMIT 200")
def weighted_sample(spark, d):
    return sampling.weighted_sample(event_spikes(spark, d), 200, "spike_id", "amplitude").select("spike_id")


@query(f"""WITH {S}, b AS (SELECT *, CAST(floor(amplitude / 5) AS BIGINT) AS b FROM s), c AS (SELECT b, count(*) AS n FROM b GROUP BY b),
h AS (SELECT c.b, c.n, (2 * c.n + coalesce(l.n, 0) + coalesce(r.n, 0)) / 4.0 AS s FROM c LEFT JOIN c l ON l.b = c.b - 1 LEFT JOIN c r ON r.b = c.b + 1)
SELECT spike_id, round(greatest(least((SELECT sum(n * s) / sum(n) FROM h) / s, 4.0), 0.25), 6) AS weight FROM b JOIN h USING (b)""")
def density_weights(spark, d):
    return sampling.density_weights(event_spikes(spark, d), "amplitude", 5.0).select("spike_id", r6(F.col("weight")).alias("weight"))


@query(f"""WITH {M}, c AS (SELECT label, sample // 16 AS channel, max(mean) - min(mean) AS w, -max((round(abs(mean), 9), -(sample % 16)))[2] AS k FROM (SELECT label, sample, mean FROM m) GROUP BY 1, 2),
r AS (SELECT *, w / max(w) OVER (PARTITION BY label) AS r FROM c) SELECT label, CAST(round_even(sum(r * (k - 8)) / sum(r), 0) AS BIGINT) AS shift FROM r WHERE r >= 0.75 GROUP BY label""")
def weighted_alignment(spark, d):
    m = templates.mean(table(spark, d, "embeddings"), "embedding").withColumn("mean", F.round("mean", 9))
    return templates.weighted_alignment(m, 16, 8)


@query(f"WITH {S} SELECT spike_id, CAST(greatest(least(power(4, least(floor(amplitude / 40), 31)), 8), 1) AS INT) AS phases FROM s")
def upsample_counts(spark, d):
    return event_spikes(spark, d).select("spike_id", templates.upsample_count(F.col("amplitude") / 20).alias("phases"))


@query(f"""WITH {CH}, u AS (SELECT DISTINCT x, z FROM ch), a AS (SELECT z - lag(z) OVER (PARTITION BY x ORDER BY z) AS g FROM u), b AS (SELECT z - lag(z) OVER (ORDER BY z) AS g FROM (SELECT DISTINCT z FROM u))
SELECT round(coalesce((SELECT min(g) FROM a), (SELECT min(g) FROM b)), 6) AS pitch""")
def probe_pitch(spark, d):
    ch = table(spark, d, "supplier").select(F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("z"))
    return motion.pitch(ch).select(r6(F.col("pitch")).alias("pitch"))


#: A field of 30 days by 10 depth bins of 50, made by a rule.
FIELD = "f AS (SELECT t AS it, z AS iz, 4 * sin(t + 3 * z) AS d FROM range(30) a(t), range(10) b(z))"


@query(f"""WITH {S}, {FIELD}, o AS (SELECT spike_id, amplitude, greatest(least((t - (SELECT min(t) FROM s)) / 24e6 - 0.5, 29.0), 0.0) AS pt, greatest(least(amplitude / 50 - 0.5, 9.0), 0.0) AS pz FROM s),
q AS (SELECT *, CAST(floor(pt) AS BIGINT) AS a, CAST(floor(pz) AS BIGINT) AS b FROM o)
SELECT spike_id, round(amplitude - ((1 - pt + a) * ((1 - pz + b) * f00.d + (pz - b) * f01.d) + (pt - a) * ((1 - pz + b) * f10.d + (pz - b) * f11.d)), 5) AS z_reg FROM q
JOIN f f00 ON f00.it = a AND f00.iz = b JOIN f f01 ON f01.it = a AND f01.iz = least(b + 1, 9) JOIN f f10 ON f10.it = least(a + 1, 29) AND f10.iz = b JOIN f f11 ON f11.it = least(a + 1, 29) AND f11.iz = least(b + 1, 9)""")
def field_correct(spark, d):
    s = event_spikes(spark, d)
    first = s.agg(F.min("t").alias("_t0"))
    field = spark.range(300).select((F.col("id") % 30).alias("t_bin"), F.floor(F.col("id") / 30).alias("z_bin")).withColumn("disp", F.sin((F.col("t_bin") + F.col("z_bin") * 3).cast("double")) * 4)
    rel = s.join(F.broadcast(first)).withColumn("t", F.col("t") - F.col("_t0"))
    return motion.correct_field(rel, field, "t", "amplitude", DAY, 50.0).select("spike_id", F.round("z_reg", 5).alias("z_reg"))


@query()
def nonrigid_motion(spark, d):
    """A field of displacements from all events: depth is the value, a bin six hours, windows of 100; tests hold the solver against one dense system."""
    s = event_spikes(spark, d)
    rel = s.join(F.broadcast(s.agg(F.min("t").alias("_t0")))).select((F.col("t") - F.col("_t0")).alias("t"), "amplitude")
    return drift.estimate(rel, "t", "amplitude", DAY / 4, 5.0, 100.0, band=8, most=40.0, chunk=48).withColumn("disp", F.round("disp", 6))


@query(f"""WITH {S} SELECT spike_id, round((0.25 - abs(((t / 1e6 / 48 + 0.25) - floor(t / 1e6 / 48 + 0.25)) - 0.5)) * 96, 4) AS disp FROM s""")
def drift_wave(spark, d):
    return event_spikes(spark, d).select("spike_id", F.round(simulate.drift(F.col("t") / 1e6, 2.0, 0.0, 48.0), 4).alias("disp"))


def simulated(spark: SparkSession, seconds: int = 2, units: int = 4, channels: int = 6) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(samples, spikes, templates): a small recording at 1000 samples a second."""
    rng = np.random.default_rng(3)
    shapes = np.stack([np.outer(simulate.waveform(21, 8, rng.uniform(0.1, 0.4), rng.uniform(0.2, 0.6), (3.0, 1.5, 4.0)), 12 * np.exp(-np.abs(np.arange(channels) - u * 1.5))) for u in range(units)])
    spikes = simulate.global_train(spark, units, 4.0, seconds * 1000 - 30, 25, 1000.0, 3).where("t >= 20")
    table_ = spark.createDataFrame([(u, c, [float(x) for x in shapes[u, :, c]]) for u in range(units) for c in range(channels)], "unit int, channel int, v array<float>")
    return simulate.inject(simulate.noise(spark, channels, 0, seconds * 1000, 3), spikes, table_, 8), spikes, shapes


@query()
def simulate_and_match(spark, d):
    x, _, shapes = simulated(spark)
    return matching.match(x, shapes, list(range(len(shapes))), 7.0, 8, 500)


def mean_templates(spark: SparkSession, d: str) -> tuple[np.ndarray, list[int]]:
    """(labels, 16, 4) means of the labelled snippets, and the labels."""
    means = templates.mean(table(spark, d, "embeddings").where("label IS NOT NULL"), "embedding").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("sample", "mean"))).alias("m")).orderBy("label").collect()
    shapes = np.array([[x["mean"] for x in r["m"]] for r in means], float).reshape(len(means), 4, 16)
    return shapes.transpose(0, 2, 1), [int(r["label"]) for r in means]


@query()
def match_embeddings(spark, d):
    """All snippets as one recording, searched for the labels' mean templates; the threshold is half their median norm."""
    shapes, units = mean_templates(spark, d)
    return matching.match(samples(spark, d), shapes, units, float(np.median(np.sqrt((shapes**2).sum((1, 2))))) / 2, 8, 8000)


@query()
def shaved_embeddings(spark, d):
    """All snippets as one recording, subtracted with a basis that is fitted to it: for each of its chunks the square of the samples before and after, and what the spikes' own decreases come to."""
    x = samples(spark, d)
    every = x.select("channel").distinct()
    index = every.join(every.withColumnRenamed("channel", "neighbor"), F.abs(F.col("channel") - F.col("neighbor")) <= 1)
    s = subtract.Settings(before=5, length=16, threshold=0.3, decrease=0.35, peak_radius=3, dedup_radius=4)
    denoise, _ = subtract.fit(x, index, 4, s, 1600, enough=2000, most=2)
    return subtract.balance(x, index, denoise, s, 1600)
