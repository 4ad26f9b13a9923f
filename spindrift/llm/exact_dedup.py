"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a Parquet table with one row for each distinct normalised text, bucketed and sorted by
the text's SHA-256. New data is reduced to its own distinct digests first (with partial aggregation,
so a group of copies of any size shrinks before the shuffle), then a sort-merge anti-join on the
bucketed digest finds those that the index lacks, and these alone are appended. The index side of that
join is not shuffled; what was appended in several batches is sorted again, until compact() has made one file of each bucket.
The number of buckets follows from the rows of the first batch (PER_BUCKET of them in each, LEAST buckets at least) and is kept
with the index: whoever opens it takes that number, and compact() changes it when the index has grown.

A table may be taken in several parts, in order of doc_id: each part after the first meets an index that the earlier ones have filled.

Defined cases: a null text counts as the empty text; equal texts are those identical after replacing each
run of white space by one space (not trimmed); of equal texts the row with the smallest doc_id stays,
null ids being the largest; rows that repeat an id are rows of their own in group_size, and the id is kept;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, drop, shared_dir, stage


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))


#: Digests of a bucket when an index is made, fewest buckets, parts in which op4 takes its table.
PER_BUCKET, LEAST, PARTS = 2_000_000, 32, 2


class DigestIndex:
    """One row (digest, keep_id, batch) for each distinct text seen; lives at a path and outlasts sessions.

    The folder holds the table in gen<g> and an empty file _index_<g>_<buckets>, which is written last and says which table counts.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets, self.gen = spark, path.rstrip("/"), buckets, 0
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        marks = self._marks()
        self.made = bool(marks)
        if marks:
            self.gen, self.buckets = max(marks)
            self._register()
        elif self._fs.exists(self._path(self.path)) and self._fs.listStatus(self._path(self.path)):
            raise ValueError(f"{path} holds files, but no index that says how many buckets it has")

    def _marks(self) -> list[tuple[int, int]]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return [(int(g), int(n)) for x, y, g, n in (m.split("_") for m in names if m.startswith("_index_")) if (x, y) == ("", "index")]

    @property
    def table(self) -> str:
        return f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/gen{self.gen}').hex}"

    def _register(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/gen{self.gen}'"
        )

    def _mark(self) -> None:
        self._fs.create(self._path(f"{self.path}/_index_{self.gen}_{self.buckets}"), True).close()

    def make(self, rows: int) -> None:
        """Makes the table, if there is none yet, for a first batch of so many digests."""
        if not self.made:
            self.buckets = self.buckets or max(LEAST, 1 << max(0, -(-rows // PER_BUCKET) - 1).bit_length())
            self._register()
            self._mark()
            self.made = True

    def read(self) -> DataFrame:
        if not self.made:
            return self.spark.createDataFrame([], "digest binary, keep_id long, batch string")
        return self.spark.table(self.table)

    def missing(self, groups: DataFrame) -> DataFrame:
        """Those distinct digests the index lacks: a sort-merge anti-join on its buckets."""
        dealt = groups.repartition(self.buckets, "digest") if self.made else groups
        return dealt.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def _write(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "batch")
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table, path=f"{self.path}/gen{self.gen}")
        )
        self.spark.catalog.refreshTable(self.table)

    def add(self, groups: DataFrame, batch: str, rows: int | None = None) -> None:
        """Appends the digests that are new. To run it again adds nothing, so a failed job can be repeated."""
        self.make((groups.count() if rows is None else rows) if not self.made else 0)
        self._write(self.missing(groups).withColumn("batch", F.lit(batch)))

    def compact(self, buckets: int | None = None) -> None:
        """Writes the index anew, one sorted file a bucket, with as many buckets as its rows now ask for (or as said)."""
        if not self.made:
            return
        rows, old, old_gen, old_buckets = self.read(), self.table, self.gen, self.buckets
        total = rows.count()
        self.gen, self.buckets = self.gen + 1, buckets or max(LEAST, 1 << max(0, -(-total // PER_BUCKET) - 1).bit_length())
        self._register()
        self._write(rows)
        self._mark()
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        for name in (f"_index_{old_gen}_{old_buckets}", f"gen{old_gen}"):
            self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def remove(self) -> None:
        """Removes the index, its table in the catalog and its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._fs.delete(self._path(self.path), True)
        self.made = False


def decide(docs: DataFrame, index: DigestIndex, batch: str = "0", parts: int = 1, hot_share: int = 4096) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, digest.

    keep_id is what the index has: the smallest doc_id of the batch's equal texts, or that of an earlier batch.
    group_size counts the batch's own rows. With several parts, the index is filled part by part, in order of doc_id (null ids last). Digests with more than 1/hot_share of all rows are at most
    hot_share in number and are joined by broadcast; all others are joined by a shuffle in which no key is hot.
    """
    spark = docs.sparkSession
    digests, path = stage(docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("digest")), "digests")
    cuts = []
    if parts > 1:
        cuts = digests.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)])).first()[0] or []
    part = sum((F.when(F.col("doc_id") <= c, 0).otherwise(1) for c in cuts), F.lit(0))
    groups, path2 = stage(digests.groupBy(part.alias("part"), "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    distinct, rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    for i in range(len(cuts) + 1):
        index.add(groups.where(F.col("part") == i), batch, distinct)
    first = index.read().select(F.col("digest"), F.col("keep_id").alias("first_id"), "batch")
    known = (
        groups.groupBy("digest")
        .agg(F.sum("group_size").alias("group_size"))
        .repartition(index.buckets, "digest")
        .join(first.hint("merge"), "digest")
        .select("digest", F.col("first_id").alias("keep_id"), "group_size", (F.col("batch") == F.lit(batch)).alias("new"))
    )
    known, path3 = stage(known, "known")
    drop(spark, path2)
    hot = F.col("group_size") > F.lit(max(256, rows // hot_share))
    many, few = known.where(hot), known.where(~hot)
    by_hot = digests.join(F.broadcast(many), "digest")
    rest = digests.join(F.broadcast(many.select("digest")), "digest", "left_anti").join(few, "digest")
    return by_hot.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest",
    )


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    return DigestIndex(spark, f"{shared_dir(spark)}/spindrift-index-{uuid.uuid4().hex[:12]}", buckets)


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """Rows of docs whose text is new, with all their columns: one row for each distinct text."""
    spark = docs.sparkSession
    own = index or fresh_index(spark)
    found, _ = stage(decide(docs, own, batch).where("kept").select(F.col("doc_id").alias("_keep"), F.col("digest").alias("_digest")), "kept")
    if index is None:
        own.remove()
    repeats = found.groupBy("_keep", "_digest").count().where("count > 1").limit(1).count()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")) & (F.col("_own") == F.col("_digest"))
    out = docs.withColumn("_own", digest(F.col("text"))).join(found, same, "left_semi")
    # rows that repeat both an id and its text are told apart by nothing; where there are any, one of them stays
    return (out.dropDuplicates(["doc_id", "_own"]) if repeats else out).drop("_own")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = fresh_index(spark)
    out, _ = stage(decide(docs, index, parts=PARTS), "decided")
    index.remove()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
