"""Queries on embeddings as snippets, templates and soft assignments, and on labels as two labelings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, compare, distances, refine, soft, templates
from ..session import ship
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}

#: Embeddings element by element, samples counted from 0; templates as means by label.
E = "e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS sample FROM embeddings)"
M = E + ", m AS (SELECT label, sample, avg(x) AS mean, count(*) AS n FROM e GROUP BY label, sample)"
#: Log-likelihoods of the ten centroids: minus half the squared distance, sharpened tenfold.
L = M + """, l AS (SELECT e.vec_id, m.label AS unit, round(-5 * sum((e.x - m.mean) * (e.x - m.mean)), 6) AS ll FROM e JOIN m USING (sample) GROUP BY e.vec_id, m.label),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, unit) AS rank FROM l),
t AS (SELECT *, exp(ll - max(ll) OVER p) / sum(exp(ll - top)) OVER p AS r FROM (SELECT *, max(ll) OVER (PARTITION BY vec_id) AS top FROM k WHERE rank <= 3) WINDOW p AS (PARTITION BY vec_id))"""
P = "p AS (SELECT a.label AS i, b.label AS j, sum(a.mean * b.mean) AS ab, sum(a.mean * a.mean) AS aa, sum(b.mean * b.mean) AS bb, sum((a.mean - b.mean) * (a.mean - b.mean)) AS d2 FROM m a JOIN m b ON a.sample = b.sample AND a.label < b.label GROUP BY 1, 2)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("embedding", "v")


def units(spark: SparkSession, d: str) -> DataFrame:
    return templates.to_arrays(templates.mean(emb(spark, d)))


def likelihoods(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, unit, ll): ten rows a vector, made by one array expression over the broadcast unit table."""
    from ..functions.arrays import square

    u = units(spark, d).select(F.col("label").alias("unit"), F.col("v").alias("c"))
    gap = square(F.zip_with("v", "c", lambda x, y: x.cast("double") - y))
    return emb(spark, d).join(F.broadcast(u)).select("vec_id", "unit", r6(gap * -5).alias("ll"))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return soft.soft_assign(likelihoods(spark, d), "vec_id", k=3)


@query(f"WITH {M} SELECT label, sample, round(mean, 6) AS mean, n FROM m")
def template_mean(spark, d):
    return templates.mean(emb(spark, d)).select("label", F.col("sample").cast("long").alias("sample"), r6(F.col("mean")).alias("mean"), "n")


@query(f"WITH {E} SELECT label, sample, quantile_disc(x, 0.5) AS median FROM e GROUP BY label, sample")
def template_median(spark, d):
    return templates.median(emb(spark, d)).select("label", F.col("sample").cast("long").alias("sample"), "median")


@query(f"WITH {E} SELECT label, sample, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM e GROUP BY label, sample")
def template_std(spark, d):
    return templates.spread(emb(spark, d)).select("label", F.col("sample").cast("long").alias("sample"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query(f"WITH {M} SELECT label % 3 AS unit, sample, round(sum(n * mean) / sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1, 2")
def template_coarsen(spark, d):
    t = templates.mean(emb(spark, d)).withColumn("unit", F.col("label") % 3)
    return templates.coarsen(t, "unit").select("unit", F.col("sample").cast("long").alias("sample"), r6(F.col("mean")).alias("mean"), "n")


@query(f"WITH {M} SELECT label, round(max(mean) - min(mean), 6) AS ptp FROM m GROUP BY label")
def unit_amplitudes(spark, d):
    return templates.amplitudes(templates.mean(emb(spark, d))).select("label", r6(F.col("ptp")).alias("ptp"))


_SNR = f"WITH {M}, c AS (SELECT label, sample // 8 AS channel, round((max(mean) - min(mean)) * sqrt(max(n)), 6) AS snr FROM m GROUP BY 1, 2) "


@query(_SNR + "SELECT * FROM c")
def snr_by_channel(spark, d):
    return templates.snr_by_channel(templates.mean(emb(spark, d)), 8).select("label", F.col("channel").cast("long").alias("channel"), r6(F.col("snr")).alias("snr"))


@query(_SNR + "SELECT label, channel, snr FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY snr DESC, channel) AS k FROM c) WHERE k = 1")
def main_channel(spark, d):
    return templates.main_channel(snr_by_channel(spark, d), "snr").select("label", "channel", "snr")


@query(f"""WITH {M}, w AS (SELECT label, sample, round(CASE WHEN mean < 0 THEN abs(mean) * 3 ELSE abs(mean) END, 9) AS w FROM m)
SELECT label, sample - 32 AS shift FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY w DESC, sample DESC) AS k FROM w) WHERE k = 1""")
def trough_alignment(spark, d):
    return templates.alignment(templates.mean(emb(spark, d)), 32).select("label", F.col("shift").cast("long").alias("shift"))


@query(f"""WITH {E} SELECT vec_id, round(max(x) - min(x), 6) AS ptp, round(greatest(max(x), -min(x)), 6) AS peak,
CASE WHEN max(x) > 0 AND min(x) < 0 THEN round(ln(max(x)) - ln(-min(x)), 6) END AS log_peak_to_trough FROM e GROUP BY vec_id""")
def amp_features(spark, d):
    out = templates.amplitude_features(emb(spark, d).withColumn("v", F.transform("v", lambda x: x.cast("double"))))
    return out.select("vec_id", *(r6(F.col(c)).alias(c) for c in ("ptp", "peak", "log_peak_to_trough")))


@query(f"WITH {E} SELECT vec_id, round(sum(abs(x) * sample) / sum(abs(x)), 6) AS com FROM e GROUP BY vec_id")
def center_of_mass(spark, d):
    return templates.center_of_mass(emb(spark, d)).select("vec_id", r6(F.col("com")).alias("com"))


@query(f"WITH {M}, {P} SELECT i, j, round(sqrt(2 * greatest(1 - ab / (sqrt(aa) * sqrt(bb)), 0)), 5) AS d FROM p")
def centroid_cosine(spark, d):
    return distances.pairs(units(spark, d)).select("i", "j", F.round(distances.cosine(), 5).alias("d"))


@query(f"WITH {M}, {P} SELECT i, j, round(sqrt(d2) / sqrt(sqrt(aa) * sqrt(bb)), 6) AS d FROM p")
def normeuc_pairs(spark, d):
    return distances.pairs(units(spark, d)).select("i", "j", r6(distances.normeuc()).alias("d"))


@query(f"""WITH {M}, {P}, s AS (SELECT *, greatest(least((ab + 10000.0) / (aa + 10000.0), 4.0 / 3), 0.75) AS u, greatest(least((ab + 10000.0) / (bb + 10000.0), 4.0 / 3), 0.75) AS w FROM p)
SELECT i, j, round(least(sqrt(greatest(bb - 2 * u * ab + u * u * aa, 0)) / sqrt(sqrt(bb) * u * sqrt(aa)), sqrt(greatest(aa - 2 * w * ab + w * w * bb, 0)) / sqrt(sqrt(aa) * w * sqrt(bb))), 6) AS d FROM s""")
def scaled_normeuc(spark, d):
    return distances.pairs(units(spark, d)).select("i", "j", r6(distances.scaled_normeuc()).alias("d"))


@query(f"WITH {M}, {P} SELECT i, j, round(sqrt(1 - exp(-d2 / 2)), 6) AS d FROM p WHERE sqrt(1 - exp(-d2 / 2)) <= 0.65")
def hellinger_pairs(spark, d):
    return distances.pairs(units(spark, d)).withColumn("d", distances.hellinger(0.5)).where("d <= 0.65").select("i", "j", r6(F.col("d")).alias("d"))


@query(f"""WITH {M}, g AS (SELECT e.vec_id, m.label AS centroid, sum((e.x - m.mean) * (e.x - m.mean)) AS d2 FROM e JOIN m USING (sample) GROUP BY 1, 2)
SELECT vec_id, centroid, round(sqrt(d2), 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 12), centroid) AS k FROM g) WHERE k = 1""")
def nearest_centroid(spark, d):
    return distances.nearest_centroid(emb(spark, d), units(spark, d), "vec_id").select("vec_id", "centroid", r6(F.col("d")).alias("d"))


@query(f"""WITH {E}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
c AS (SELECT q.vec_id AS query, e.vec_id, round(sum(q.x * e.x) / (any_value(a.n) * any_value(b.n)), 6) AS sim FROM e q JOIN e ON q.sample = e.sample AND q.vec_id <> e.vec_id JOIN n a ON a.vec_id = q.vec_id JOIN n b ON b.vec_id = e.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM c) WHERE rank <= 5""")
def cosine_topk(spark, d):
    e = emb(spark, d)
    return distances.top_cosine(e, e.where("vec_id % 50 = 0"), "vec_id", 5).select("query", "vec_id", "sim", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {L} SELECT vec_id, round(max(ll) + ln(sum(exp(ll - top))), 5) AS lse FROM (SELECT *, max(ll) OVER (PARTITION BY vec_id) AS top FROM l) GROUP BY vec_id")
def logsumexp(spark, d):
    return soft.log_sum_exp(likelihoods(spark, d), ["vec_id"]).select("vec_id", F.round("lse", 5).alias("lse"))


@query(f"WITH {L} SELECT vec_id, CAST(rank - 1 AS BIGINT) AS slot, unit, round(r, 5) AS r FROM t WHERE r > 0")
def soft_explode(spark, d):
    out = soft.explode_soft(soft.to_arrays(assigned(spark, d), "vec_id"), "vec_id")
    return out.select("vec_id", F.col("slot").cast("long").alias("slot"), "unit", F.round("r", 5).alias("r"))


@query(f"WITH {L} SELECT vec_id, round(sum(CASE WHEN r > 0 THEN -r * ln(r) ELSE 0 END), 5) AS entropy FROM t GROUP BY vec_id")
def soft_entropy(spark, d):
    return soft.entropy(assigned(spark, d), "vec_id").select("vec_id", F.round("entropy", 5).alias("entropy"))


@query(f"""WITH {L}, q AS (SELECT a.unit AS u, b.unit AS v, a.r AS ru, b.r AS rv, a.r + b.r AS rs FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.rank = 1 AND b.rank > 1)
SELECT least(u, v) AS i, greatest(u, v) AS j, count(*) AS n, round(avg(-ru * ln(ru) - (CASE WHEN rv > 0 THEN rv * ln(rv) ELSE 0 END) + rs * ln(rs)), 5) AS coentropy FROM q GROUP BY 1, 2""")
def coentropy(spark, d):
    return soft.coentropy(assigned(spark, d), "vec_id").select("i", "j", "n", F.round("coentropy", 5).alias("coentropy"))


@query(f"""WITH {L}, n AS (SELECT unit, count(*) AS n FROM t GROUP BY unit), b AS (SELECT a.unit AS i, c.unit AS j, count(*) AS both_ FROM t a JOIN t c ON a.vec_id = c.vec_id AND a.unit < c.unit GROUP BY 1, 2)
SELECT i, j, both_ AS "both", round(both_ / (x.n + y.n - both_), 6) AS iou, round(both_ / least(x.n, y.n), 6) AS cov FROM b JOIN n x ON x.unit = i JOIN n y ON y.unit = j""")
def pair_iou_cov(spark, d):
    return soft.iou_and_coverage(assigned(spark, d), "vec_id").select("i", "j", "both", r6(F.col("iou")).alias("iou"), r6(F.col("cov")).alias("cov"))


@query(f"""WITH {L}, g AS (SELECT vec_id, unit % 4 AS new, sum(r) AS r, max(ll) AS m FROM t GROUP BY 1, 2),
h AS (SELECT g.vec_id, new, any_value(g.r) AS r, any_value(m) + ln(sum(exp(t.ll - m))) AS ll FROM g JOIN t ON t.vec_id = g.vec_id AND t.unit % 4 = g.new GROUP BY 1, 2)
SELECT vec_id, new, round(r, 5) AS r, round(ll, 6) AS ll, row_number() OVER (PARTITION BY vec_id ORDER BY round(ll, 9) DESC, new) AS rank FROM h""")
def merge_scores(spark, d):
    names = units(spark, d).select(F.col("label").alias("unit"), (F.col("label") % 4).alias("new"))
    return soft.merge(assigned(spark, d), names, "vec_id").select("vec_id", "new", F.round("r", 5).alias("r"), F.round("ll", 6).alias("ll"), F.col("rank").cast("long").alias("rank"))


@query("SELECT quality, toxic, count(*) AS n FROM labels WHERE quality >= 0 AND toxic >= 0 GROUP BY 1, 2")
def confusion(spark, d):
    return compare.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels WHERE quality >= 0 AND toxic >= 0 GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY quality) AS nx, sum(n) OVER (PARTITION BY toxic) AS ny FROM c)
SELECT quality, toxic, n, round(n / greatest(nx + ny - n, 1), 6) AS iou, round(n / greatest(ny, 1), 6) AS precision, round(n / greatest(nx, 1), 6) AS recall FROM w""")
def agreement(spark, d):
    out = compare.agreement(table(spark, d, "labels"), "quality", "toxic")
    return out.select("quality", "toxic", "n", *(r6(F.col(c)).alias(c) for c in ("iou", "precision", "recall")))


@query(f"""WITH {M}, g AS (SELECT e.vec_id, any_value(e.label) AS x, m.label AS y, sum((e.x - m.mean) * (e.x - m.mean)) AS d2 FROM e JOIN m USING (sample) GROUP BY e.vec_id, m.label),
b AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 12), y) AS k FROM g) WHERE k = 1),
c AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS k, sum(n) AS t FROM c),
a1 AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY x)), b1 AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT round((t * (t - 1) / 2 + 2 * k - a - b) / (t * (t - 1) / 2), 6) AS rand, round((k - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS adjusted_rand FROM s, a1, b1""")
def rand_index(spark, d):
    e = emb(spark, d)
    got = distances.nearest_centroid(e, units(spark, d), "vec_id").join(e.select("vec_id", "label"), "vec_id")
    return compare.rand_index(got, "label", "centroid").select(r6(F.col("rand")).alias("rand"), r6(F.col("adjusted_rand")).alias("adjusted_rand"))


@query()
def gramian_pca(spark, d):
    e = emb(spark, d)
    axes = cluster.principal_axes(e, "v", 64, 3)
    return cluster.project(e, axes, "v").select("vec_id", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"))


@query()
def kmeans_labels(spark, d):
    return cluster.kmeans(emb(spark, d), "v", 10).select("vec_id", "label", "cluster")


@query()
def mixture_labels(spark, d):
    """The component of a fitted mixture that each row belongs to, and its responsibility."""
    import numpy as np

    ship(spark)
    u = units(spark, d).orderBy("label").toPandas()
    mu, pi, var, elbo = cluster.mixture(emb(spark, d), "v", 64, np.stack(u["v"].to_numpy()), noise=1e-30, steps=5)
    return refine.assigned(emb(spark, d), "v", refine.Model(mu, pi, var, 1e-30), "vec_id").withColumn("r", r6(F.col("r")))
