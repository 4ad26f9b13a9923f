"""Importance resampling towards a target distribution: the documents whose words look most like a target's are drawn, with Gumbel noise, by exact ranks.

A text's features are its runs of words, hashed into BUCKETS buckets. What is counted of the corpus and of the target is one number a bucket, added up in the tasks before it is shuffled;
the gains that follow are an array of BUCKETS integers, the only thing that tasks are given, and a document's weight is the sum of its features' entries. Scores are integers, so ranks are exact:

- a histogram counts the documents of each score. It is sorted by range into runs; the totals of the runs, one row a run, and the counts within each are summed from the highest score down,
  which gives every score its rank offset and the cutoff, the least score of which any document is drawn;
- the documents at or above the cutoff get their offset and their row_number by doc_id within their score. A score that very many documents share is cut into ranges of ids with offsets of their own,
  so no window grows with the largest score's share of the rows.

Defined cases: a null text, and one without words, has no features and weight 0; a null doc_id counts as the empty string in the noise and as larger than all others in ties; rows that share an id and a score are ranked by
their number of features; repeated rows are drawn row by row; without a target's texts or documents gains follow from the smoothing alone; an empty table gives no rows; texts of any length are counted whole; further columns are not read.
"""

from __future__ import annotations

import re
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, crc32_sql, small_batches, stage

#: Buckets of features, words of the longest feature, least features of a document that may be drawn, percent drawn of those, seed of the noise.
BUCKETS, LONGEST, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: A word of a lower-cased text: every byte of a character above U+007F belongs to one.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text: str | None, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The buckets of a text's features, with repeats. Only A-Z are lower-cased, which is what lower() of bytes does."""
    words = WORD.findall(text.encode().lower()) if text else []
    runs = chain(words, *(map(b" ".join, zip(*(words[i:] for i in range(n)))) for n in range(2, longest + 1)))
    return np.fromiter(map(crc32, runs), np.int64) % buckets


def counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts in each bucket: added up over a batch, then by Spark; at most `buckets` rows come to the driver."""
    small_batches(texts.sparkSession, 512)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(buckets, np.int64)
        for text in batch.column(0):
            total += np.bincount(features(text.as_py(), buckets, longest), minlength=buckets)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = arrow_map(texts.select(F.col("text").cast("string")), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: 1000 times its log likelihood ratio, one count added to each bucket, rounded down."""
    s, t, n = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(seed: str = SEED) -> Column:
    """1000 times a Gumbel draw that follows from the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score: a row for each row of docs; a weight is the sum of an array's entries at the document's buckets."""
    small_batches(docs.sparkSession, 512)
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(text.as_py(), len(table.value), longest) for text in batch.column(1)]
        sizes, weights = [len(f) for f in found], [int(table.value[f].sum()) for f in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], ["doc_id", "n_features", "weight"])

    out = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), weigh, "doc_id long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(seed))


def offsets(scores: DataFrame) -> DataFrame:
    """score, count, above: the documents of each score and how many have a higher one."""
    run = scores.groupBy("score").count().repartitionByRange("score").select("score", "count", F.spark_partition_id().alias("run"))
    runs, _ = stage(run, "histogram")
    higher = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    totals = runs.groupBy("run").agg(F.sum("count").alias("total")).select("run", F.coalesce(F.sum("total").over(higher), F.lit(0)).alias("before"))
    within = Window.partitionBy("run").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return runs.join(totals, "run").select("score", "count", (F.col("before") + F.coalesce(F.sum("count").over(within), F.lit(0))).alias("above"))


def draw(scores: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """scores (doc_id, n_features, weight, score; a table that can be read again) with rank, null where a document isn't drawn."""
    fit = F.col("n_features") >= least
    steps, _ = stage(offsets(scores.where(fit)), "offsets")
    n = scores.where(fit).count()
    wanted = n * percent // 100
    cutoff = steps.where(F.col("above") < wanted).agg(F.min("score")).first()[0]
    if cutoff is None:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    in_ = fit & (F.col("score") >= cutoff)
    order = [F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    above = scores.where(in_).withColumn("_even", F.monotonically_increasing_id() % 64).repartitionByRange(F.desc("score"), *order, "_even")
    part, _ = stage(above.drop("_even").withColumn("run", F.spark_partition_id()), "drawn")
    # a score's documents lie in one run, or in several that follow each other
    before = Window.partitionBy("score").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy("score", "run").agg(F.count(F.lit(1)).alias("size")).withColumn("earlier", F.coalesce(F.sum("size").over(before), F.lit(0)))
    starts = starts.join(steps.select("score", "above"), "score").select("score", "run", (F.col("above") + F.col("earlier")).alias("start"))
    ranked = part.withColumn("_at", F.row_number().over(Window.partitionBy("score", "run").orderBy(*order))).join(starts, ["score", "run"])
    rank = F.col("start") + F.col("_at")
    own = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*own, F.when(rank <= wanted, rank).cast("long").alias("rank"))
    return scores.where(~in_).select(*own, F.lit(None).cast("long").alias("rank")).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document; those with a rank are drawn, as many as `percent` of those with `least` features."""
    gain = gains(counts(docs, buckets, longest), counts(target, buckets, longest))
    return draw(stage(scored(docs, gain, longest, seed), "scores")[0], least, percent)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents
), o AS (
  SELECT row, unnest(words) AS w FROM d
), g AS (
  SELECT unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS w FROM benchmark
), v AS (
  SELECT w, {crc32_sql("w")} % {BUCKETS} AS b FROM (SELECT w FROM o UNION SELECT w FROM g)
), s AS (
  SELECT b, count(*) AS s FROM o JOIN v USING (w) GROUP BY b
), t AS (
  SELECT b, count(*) AS t FROM g JOIN v USING (w) GROUP BY b
), e AS (
  SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM o) + {BUCKETS} AS DOUBLE)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM g) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)
), w AS (
  SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM o JOIN v USING (w) JOIN e USING (b) GROUP BY row
), c AS (
  SELECT d.row, d.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM d LEFT JOIN w ON d.row = w.row
), r AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= {LEAST}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank FROM c LEFT JOIN r ON c.row = r.row
"""
