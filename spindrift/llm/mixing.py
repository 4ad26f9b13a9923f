"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's expected copies are its source's target over its source's size. Within a source, documents stand
in order of size; the prefix sum of expected copies plus one random offset of the source crosses some integers,
and a document is emitted once for each integer that its own step crosses. As neighbours have nearly equal
sizes, the words taken come near the target.

A few very long documents would leave a small source far from its target, so it is sampled in two runs. The large documents, those of the size classes
that lie above 1/LARGE of the target, come first with the source's own ratio; then the others, with the expected copies that are left of the target after what the first run took.

No window holds a source: documents are ranked within (source, size class, salt), at most a bounded
share of a source, and the counts of those groups, one row each, are prefix-summed over the source.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without
words has target 0 and none of its documents is taken; a null doc_id sorts first, and rows that share an id are told apart by their texts' digest; repeated rows are ranked one after
the other; an empty table gives no rows; further columns are kept by mix() and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stage

WEIGHTS, SHARE, MOST, SALTS, SEED, LARGE = (3, 1, 2), 1.5, 2, 64, "mix-1", 50
KEYS = ["_key", "_class", "_salt"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(text: Column) -> Column:
    """32 bits of the MD5 of a string, as a long; any engine has them."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def mark(text: Column) -> Column:
    """What tells rows of one id apart: 32 bits of the text's digest."""
    return _unit(F.coalesce(text, F.lit("")))


def _placed(docs: DataFrame, size: Column, mark: Column) -> DataFrame:
    """Adds size, the source's key, the size class (an eighth to a quarter of an octave) and the salt."""
    bits = F.length(F.bin(F.col("_size")))
    return (
        docs.withColumn("_size", size)
        .withColumn("_mark", mark)
        .withColumn("_key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))
        .withColumn("_class", (bits * 8 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 3, 0))")).cast("int"))
        .withColumn("_salt", ((F.coalesce(_unit(F.col("doc_id").cast("string")), F.lit(0)) + F.col("_mark")) % SALTS).cast("int"))
    )


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources: _key, source_size, one row a source. Adds target: shares by weight, none over most times its size.

    The excess that is reshared until none is above ends at one level L with target = min(most * size, weight * L).
    In ascending order of most * size / weight, a source is capped when that ratio lies below the level
    which the sources not yet capped would get.
    """
    order = Window.orderBy(F.when(F.col("_key") == "n", 1).otherwise(0), "_key")
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    held = F.col("source_size") * most
    out = (
        sources.withColumn("_rank", F.row_number().over(order))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_ratio", held.cast("double") / F.col("_weight").cast("double"))
        .withColumn("_goal", F.sum("source_size").over(everything).cast("double") * F.lit(share))
        .withColumn("_all", F.sum("_weight").over(everything))
        .withColumn("_level", (F.col("_goal") - F.coalesce(F.sum(held).over(before), F.lit(0)).cast("double")) / (F.col("_all") - F.coalesce(F.sum("_weight").over(before), F.lit(0))).cast("double"))
        .withColumn("_full", F.col("_ratio") < F.col("_level"))
        .withColumn("_held", F.sum(F.when(F.col("_full"), held).otherwise(0)).over(everything))
        .withColumn("_heavy", F.sum(F.when(F.col("_full"), F.col("_weight")).otherwise(0)).over(everything))
    )
    rest = (F.col("_goal") - F.col("_held").cast("double")) / F.nullif(F.col("_all") - F.col("_heavy"), F.lit(0)).cast("double")
    target = F.when(F.col("_full"), held.cast("double")).otherwise(F.least(F.col("_weight").cast("double") * rest, held.cast("double")))
    return out.select("_key", "source_size", target.alias("target"))


def allocate(docs: DataFrame, size: Column, mark: Column, **how) -> DataFrame:
    """docs with all its columns, and _size, _mark, source_size, target, copies."""
    placed = _placed(docs, size, mark)
    groups, _ = stage(placed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"), F.min("_size").alias("_least")), "mix")
    goals = targets(groups.groupBy("_key").agg(F.sum("_words").alias("source_size")), **how)
    offset = _unit(F.concat(F.lit(SEED), F.col("_key"))).cast("double") / F.lit(4294967296.0)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    # a class is large as a whole: by the least size of any of its documents
    least = F.min("_least").over(Window.partitionBy("_key", "_class"))
    run = Window.partitionBy("_key", "_large").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    started = groups.join(goals, "_key").withColumn("_offset", offset).withColumn("_ratio", ratio).withColumn("_large", least.cast("double") * LARGE > F.col("target"))
    started = started.withColumn("_start", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    crossed = lambda first, last: F.floor(last.cast("double") * F.col("_step") + F.col("_offset")) - F.floor(first.cast("double") * F.col("_step") + F.col("_offset"))
    # what the first run takes: of a group of several documents, as many as it takes at their mean size
    taken = started.where("_large").withColumn("_step", F.col("_ratio")).withColumn("_took", F.floor(crossed(F.col("_start"), F.col("_start") + F.col("_n")) * F.col("_words") / F.col("_n")))
    first = taken.groupBy("_key").agg(F.sum("_took").alias("_took"), F.sum("_words").alias("_given"))
    left = F.col("source_size") - F.coalesce("_given", F.lit(0))
    rest = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), (F.col("target") - F.coalesce("_took", F.lit(0)).cast("double")) / F.nullif(left, F.lit(0)).cast("double")))
    starts = started.join(first, "_key", "left").withColumn("_step", F.when(F.col("_large"), F.col("_ratio")).otherwise(F.coalesce(rest, F.lit(0.0))))
    starts = starts.select(*KEYS, "_start", "_step", "_offset", "source_size", "target")
    ranked = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*KEYS).orderBy("_size", "doc_id", "_mark")))
    last = F.col("_start") + F.col("_at")
    return (
        ranked.join(starts, KEYS)
        .withColumn("copies", F.least(crossed(last - 1, last).cast("long"), F.lit(MOST).cast("long")))
        .drop(*KEYS, "_start", "_at", "_step", "_offset")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    own = docs.columns
    inner = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")
    taken = allocate(inner, words(F.col("text")), mark(F.col("text")), **how)
    return taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(f"_row.`{c}`").alias(c) for c in own))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized, _ = stage(docs.select("doc_id", "source", words(F.col("text")).alias("size"), mark(F.col("text")).alias("mark")), "sizes")
    out = allocate(sized, F.col("size"), F.col("mark"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = rf"""
WITH p AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
    CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) AS mark
  FROM documents
), q AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS class,
    (coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT), 0) + mark) % {SALTS} AS salt FROM p
), s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY CASE WHEN k = 'n' THEN 1 ELSE 0 END, k) AS rank FROM q GROUP BY k
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), r AS (
  SELECT *, CAST(source_size * {MOST} AS DOUBLE) / weight AS ratio,
    CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} AS goal, CAST(sum(weight) OVER () AS BIGINT) AS every FROM w
), f AS (
  SELECT *, ratio < (goal - CAST(coalesce(sum(source_size * {MOST}) OVER b, 0) AS DOUBLE)) / CAST(every - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS capped
  FROM r WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT k, source_size, CASE WHEN capped THEN CAST(source_size * {MOST} AS DOUBLE) ELSE least(CAST(weight AS DOUBLE) *
    ((goal - CAST(sum(CASE WHEN capped THEN source_size * {MOST} ELSE 0 END) OVER () AS DOUBLE))
     / CAST(nullif(every - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER (), 0) AS DOUBLE)), CAST(source_size * {MOST} AS DOUBLE)) END AS target FROM f
), g AS (
  SELECT *, least * {LARGE}.0 > target AS large, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS ratio,
    CAST(CAST('0x' || substr(md5('{SEED}' || k), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM (SELECT k, class, CAST(min(size) AS DOUBLE) AS least FROM q GROUP BY k, class) JOIN t USING (k)
), h AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY k, large ORDER BY class, salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT k, class, salt, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS words FROM q GROUP BY k, class, salt) JOIN g USING (k, class)
), x AS (
  SELECT k, sum(floor(CAST(CAST(floor(CAST(start + n AS DOUBLE) * ratio + u) - floor(CAST(start AS DOUBLE) * ratio + u) AS BIGINT) * words AS DOUBLE) / n)) AS took, sum(words) AS given
  FROM h WHERE large GROUP BY k
), y AS (
  SELECT h.k, class, salt, start, u, source_size, target, CASE WHEN large THEN ratio ELSE coalesce(greatest(0.0, least({MOST}.0,
    (target - CAST(coalesce(took, 0) AS DOUBLE)) / CAST(nullif(source_size - coalesce(given, 0), 0) AS DOUBLE))), 0.0) END AS step
  FROM h LEFT JOIN x ON h.k = x.k
), a AS (
  SELECT q.doc_id, q.size, source_size, target, step, u, start + row_number() OVER (PARTITION BY q.k, q.class, q.salt ORDER BY q.size, q.doc_id NULLS FIRST, q.mark) AS pos
  FROM q JOIN y ON q.k = y.k AND q.class = y.class AND q.salt = y.salt
)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(CAST(pos AS DOUBLE) * step + u) - floor(CAST(pos - 1 AS DOUBLE) * step + u), {MOST}) AS BIGINT) * size AS taken
FROM a
"""
